"""Audit of how the sources of a language differ: counts of terms by source as postings of an
inverted index, sums over pairs of sources as a baseline and its corrections, ranked terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, stored, texts_of

#: Documents of a language that a kept term needs, and how many terms of a group are reported.
MIN_DOCS, TOP_TERMS = 3, 200
#: A-Z become a-z, every other byte up to 7F a blank; a term is what stands between blanks.
_TERM_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Bytes of a text split at once, and terms that a task holds before it passes them on.
_PIECE, _HELD = 1 << 20, 200_000
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, a list for each piece of it."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + _PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by lang, source and term, combined within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])],
                    schema=_SCHEMA,
                )

    for batch in batches_of(batches, 100):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > _HELD:
            yield from out()
            held.clear()
    yield from out()


def _p(n: str, total: str, v: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + v)), exact for any long."""
    return F.expr(f"CAST(1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))) DIV CAST({total} + {v} AS DECIMAL(20,0)) AS BIGINT)")


def _f(p: str, q: str) -> str:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so the square fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV ({q}))"


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """How each source of a language differs from the language's other sources, and by which
    terms from the language as a whole.

    Returns ``lang, source, part, item, value, rank``.  Part ``pair``: a row for each other
    source (``item``) of the language; part ``term``: the up to ``top`` terms that are more
    frequent in the source than in the language.  With p and q the smoothed shares in 10^9ths
    (plus 1) of a term, a value is floor((p-q)^2/q), for pairs summed over all kept terms:
    those in ``min_docs`` or more documents (rows) of the language.  Ranks start at 1, larger
    values first, then items in the order of their UTF-8.

    A pair starts at (number of kept terms) times the value at no occurrences.  What the
    terms of one source change against a source without them depends on their counts alone
    and is summed over its histogram of counts; the postings of a term correct the pairs of
    sources that both have it, and rows of zero are not passed on.  Counts are combined in
    the tasks that read the texts, so a source with a third of all rows is a row for each
    task and term; a ranking keeps ``top`` rows of a group in each task before its exchange.

    Null text, lang and source are ''.  Empty texts have no term, groups of them still have
    pairs, with value 0 where the language keeps no term.  Repeated rows are documents of
    their own; an empty table gives no row; other columns are ignored.  Sums stay within a
    long as long as a language keeps under 5 * 10^8 terms; beyond that Spark raises.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    tallies = texts_of(rows).mapInArrow(_tallies, "lang string, source string, term binary, n long, docs long")
    counts = stored(tallies.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= min_docs).drop("docs")
    postings = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")

    # A row for each group: occurrences there and in its language, terms kept, share of none.
    langs = postings.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("v"), zero("n_lang"))
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0", "total", "v")).otherwise(F.lit(1).cast("long"))), "groups")

    placed = postings.join(groups, ["lang", "source"])
    placed = stored(placed.select("lang", "term", "source", "n", "p0", _p("n", "total", "v").alias("p"), _p("of_lang", "n_lang", "v").alias("q")), "shares")
    terms = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr(_f("p", "q")).alias("value"))

    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("p0").alias(f"p0{x}"), F.col("v").alias(f"v{x}"))
    pairs = side("a").join(side("b"), "lang").where("a <> b")
    none = _f("p0a", "p0b")
    base = pairs.select("lang", "a", "b", F.expr(f"va * {none}").alias("value"))
    histogram = placed.groupBy("lang", "source", "n").agg(F.count("*").alias("m"), F.first("p").alias("p")).drop("n")
    alone = [
        pairs.join(histogram.withColumnRenamed("source", x), ["lang", x]).select("lang", "a", "b", F.expr(f"m * ({_f(*pq)} - {none})").alias("value"))
        for x, pq in (("a", ("p", "p0b")), ("b", ("p0a", "p")))
    ]
    posting = lambda x: placed.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("p0").alias(f"p0{x}"))
    met = posting("a").join(posting("b"), ["lang", "term"]).where("a <> b")
    both = met.select("lang", "a", "b", F.expr(f"{_f('pa', 'pb')} - {_f('pa', 'p0b')} - {_f('p0a', 'pb')} + {none}").alias("value"))
    changes = base.union(alone[0]).union(alone[1]).union(both).where("value <> 0")
    sums = pairs.select("lang", "a", "b").join(changes.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), ["lang", "a", "b"], "left")
    sums = sums.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), zero("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(sums).union(ranked(terms).where(F.col("rank") <= top))
