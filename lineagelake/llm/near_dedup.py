"""MinHash near-duplicate detection by a signature-coordinate inverted join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, connected_components, free, mixed, shingle_set, stored, texts_of

#: Coordinates of a signature, and collisions that a pair needs to be looked at: a pair of
#: Jaccard 0.8 has fewer than 14 collisions of 32 with a probability of about 1e-6.
COORDINATES, COLLISIONS = 32, 14
#: 64-bit words of the parity sketch of a set; members of a part of a list; bits of the filter
#: of wanted ids.
WORDS, PART, MARKS = 16, 1000, 1 << 23
_rng = np.random.default_rng(20240601)
_XOR = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit name of each (coordinate, value) pair."""
    out = np.zeros(COORDINATES, np.uint64)
    if len(shingles):
        for k in range(COORDINATES):
            out[k] = ((shingles ^ _XOR[k]) * _MUL[k]).min()
    return mixed(out + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of shingles fell into bin i."""
    bins = np.bincount((mixed(shingles + np.uint64(1)) % np.uint64(WORDS * 64)).astype(np.int64), minlength=WORDS * 64) & 1
    return np.packbits(bins.astype(np.uint8)).view(np.int64)


def _print(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, fp, sig, parity)`` of every row: set size, 128-bit fingerprint
    of the whole set, named MinHash coordinates, parity sketch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(rows, 500):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            many = [np.concatenate([f(s) for s in sets]) if sets else np.empty(0, np.int64) for f in (_signature, _parity)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * n, pa.int32()), pa.array(v)) for v, n in zip(many, (COORDINATES, WORDS), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.binary()), *lists],
                names=["doc_id", "n_shingles", "fp", "sig", "parity"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, sig array<long>, parity array<long>")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _possible(percent: int) -> Column:
    """A similarity of rows a and b that their sizes and parity sketches allow.

    Every bit in which the sketches differ is due to a shingle of just one of the sets, so
    the number of those bits is at most that of such shingles; Jaccard p/100 allows at most
    (100 - p) * (|A| + |B|) / (100 + p) of them.  This bound never turns a link away.
    """
    differ = reduce(add, [F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k])) for k in range(WORDS)])
    return _sizes_fit("a.n", "b.n", percent) & (differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent))


def _colliding(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` with enough equal coordinates in their signatures."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}"))
    equal = F.size(F.array_intersect("sa", "sb"))  # names of different coordinates differ
    return pairs.join(side("a"), "a").join(side("b"), "b").where(equal >= COLLISIONS).select("a", "b").distinct()


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """``(token, part, parts, rep, n, weight)``: the lists under which a class is posted.

    Pairs with COLLISIONS equal coordinates share one of the first (held - COLLISIONS + 1)
    of the coordinate-value pairs that a class holds with any other, in one order for all,
    rarest first; so the long lists are merged only for classes that have nothing rarer.
    A list is cut by set size into bands, four times as wide as a link's sizes may differ; a
    class near the end of its band is posted in the next one too, so two classes of similar
    sizes share one, and sizes that no link allows are skipped without looking at them.
    ``weight`` sums the logarithms of how common all its pairs are: the middle of a group has
    the most, while one very common pair counts little.  The members of a long list are dealt
    over ``parts`` parts.
    """
    tokens = classes.select("rep", "n", F.explode("sig").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(common, "token").groupBy("rep", "n").agg(F.sum(F.log("df")).alias("weight"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    held = held.where(F.size("held") >= COLLISIONS)
    first = F.slice("held", F.lit(1), F.size("held") - (COLLISIONS - 1))
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    place = F.log("n") / width
    own = held.select("rep", "n", "weight", place.alias("place"), F.explode(first).alias("t"))
    parts = (F.col("t.df") / PART).cast("int") + 1
    band = F.floor(F.col("place") / 4)
    bands = F.when(F.pmod("place", F.lit(4.0)) < 3, F.array(band)).otherwise(F.array(band, band + 1))
    each = own.select(
        "rep", "n", "weight", parts.alias("parts"), F.pmod(F.xxhash64(F.lit(5), "rep"), parts).cast("int").alias("part"), "t.token", F.explode(bands).alias("band")
    ).withColumn("token", F.xxhash64("token", "band"))
    return each.select("token", "part", "parts", "rep", "n", "weight")


def _open(postings: DataFrame, comps: DataFrame | None, pick: Column) -> DataFrame:
    """The postings in lists whose members are not all in one component, with ``comp``, and of
    each list ``pivot, own, pn, main``: the member that comes first by ``pick``, its component
    and size, and the component most frequent in the list.  Lists never open again."""
    placed = postings.withColumn("comp", F.col("rep")) if comps is None else postings.join(comps, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    lists = placed.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("parts").alias("parts"), F.min(F.struct(pick.alias("o"), "rep", "comp", "n")).alias("p"), F.mode("comp").alias("main")
    ).where("lo < hi")
    # A long list's row is repeated for each of its parts, so no task gathers all its members.
    lists = lists.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("p.rep").alias("pivot"), F.col("p.comp").alias("own"), F.col("p.n").alias("pn"), "main")
    return stored(placed.join(lists, ["token", "part"]), "open")


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs(id, text)`` less most of those whose id is not ``wanted``: a filter of MARKS bits,
    as at most MARKS / 64 rows, spares them the shuffle.  It lets every wanted id through."""
    bit = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(MARKS))
    word = lambda: F.shiftright(bit, 6).cast("int").alias("word")
    mask = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = wanted.select(word(), bit.alias("at")).groupBy("word").agg(F.bit_or(mask).alias("bits"))
    looked = docs.withColumns({"word": word(), "at": bit}).join(F.broadcast(words), "word")
    return looked.where(F.col("bits").bitwiseAND(mask) != 0).select("id", "text")


def _texts(pairs: DataFrame, docs: DataFrame, known: DataFrame | None) -> DataFrame:
    """``(id, text)`` of the documents of ``pairs`` that are not among ``known``."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = stored(wanted if known is None else wanted.join(known.select("id"), "id", "left_anti"), "wanted")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    # An inner join: a semi-join would be moved before the filter of ``_marked``.
    more = stored(_marked(text, wanted).join(wanted.hint("merge"), "id").dropDuplicates(["id", "text"]), "texts")
    free(wanted)
    return more


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full shingle sets reach the similarity."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches_of(rows, 500):
            ta, tb = batch.column(1), batch.column(3)
            out = []
            for i in range(batch.num_rows):
                own = ta[i].as_py()
                if last[0] != own:
                    last = own, shingle_set(own, words)
                x, y = last[1], shingle_set(tb[i].as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(out, pa.int64())) for i in (0, 2)], names=["src", "dst"])

    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "ta", "b", "tb")
    )
    return both.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose word-shingle sets have a Jaccard similarity of
    ``percent``/100 or more, directly or through others.

    Returns per row of ``docs``: ``doc_id, n_shingles, component_id`` (smallest doc_id
    reachable) and ``kept`` (doc_id = component_id).

    Documents with equal sets are one class.  Each class is posted under the rarest of its
    (coordinate, value) pairs; collisions are counted on the whole signatures, and every
    link is confirmed on the full sets.  A first round tests each list's members against
    the one in its middle, a second against one by chance, which joins large groups without
    their inner pairs; a last round tests every pair of one list that is still apart.

    Null or blank texts have an empty set and link with nothing.  Rows without doc_id take
    no part: component_id null, kept true.  Rows that repeat a doc_id are one document.
    Other columns of ``docs`` are ignored.
    """
    docs = texts_of(docs.select("doc_id", "text"))
    sigs = stored(signatures(docs, words), "signatures")
    usable = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("parity").alias("parity")
    )
    classes = stored(classes, "classes")
    repeated = usable.join(classes.select("fp", "rep"), "fp").where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    repeated, sizes = stored(repeated, "repeated"), stored(sigs.select("doc_id", "n_shingles"), "sizes")
    free(sigs)
    lists = stored(_postings(classes, percent), "postings")
    columns = lists.columns
    sketches = classes.select("rep", "n", "parity")

    def confirmed(pairs: DataFrame) -> DataFrame:
        nonlocal texts
        pairs = stored(_colliding(pairs, classes), "pairs")
        more = _texts(pairs, docs, texts)
        texts = more if texts is None else texts.union(more)
        found = stored(_verified(pairs, texts, words, percent), "links")
        tested.append(pairs)
        return found

    tested: list[DataFrame] = []
    links = comps = groups = texts = None
    for order in (-F.col("weight"), F.xxhash64("rep").cast("double")):
        last, lists = lists, _open(lists.select(*columns), comps, order)
        free(last)
        star = lists.where((F.col("comp") != F.col("own")) & _sizes_fit("n", "pn", percent)).select("pivot", "rep").distinct()
        star = star.join(sketches.alias("a"), F.col("pivot") == F.col("a.rep")).join(sketches.alias("b"), star["rep"] == F.col("b.rep"))
        found = confirmed(star.where(_possible(percent)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")))
        links = found if links is None else links.union(found)
        if groups is not None:
            free(groups)
        groups = connected_components(links)
        comps = groups.withColumnRenamed("node", "rep")

    last, lists = lists, _open(lists.select(*columns), comps, F.lit(0))
    free(last, groups)
    held = lists.groupBy("rep").agg(F.collect_set("token").alias("tokens")).join(sketches.select("rep", "parity"), "rep")
    sketched = lists.select("token", "part", "parts", "rep", "n", "comp", "main").join(held, "rep")
    each = (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.comp") < F.col("b.comp")))
    # Of all lists that hold both.  Null-safe: for a plain equality Spark would first look, for
    # every two members of a list, whether the common lists are null.
    once = F.array_min(F.array_intersect("a.tokens", "b.tokens")).eqNullSafe(F.col("a.token"))
    theirs = sketched.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = sketched.where("comp <> main").alias("a").join(theirs.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & each & _possible(percent) & once)
    apart = apart.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
    seen = reduce(DataFrame.union, [t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for t in tested])
    links = links.union(confirmed(apart.join(seen, ["a", "b"], "left_anti")))
    free(lists, classes)
    groups = connected_components(links.union(repeated)).withColumnRenamed("node", "doc_id")

    return sizes.join(groups, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
