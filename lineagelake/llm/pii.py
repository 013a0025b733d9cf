"""Personal data: fixed expressions find base entities; their contexts bootstrap patterns
that find identifiers of other forms.  DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The base expressions.  Written with possessive repeats and with starts only
#: where a match can begin, which finds the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OTHER = "id"
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_GROUP = r"[^\s\p{L}0-9@]*+[0-9][^\s\p{L}@]*+(?!\S)"
_GROUPS = rf"(?<!\S){_GROUP}(?:\x20{_GROUP})++"
_SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"

#: A pattern is trusted with so many distinct known entities among what it extracts, and such
#: a share of them; an instance is accepted from such a score on.
LEAST_KNOWN, LEAST_SHARE, LEAST_SCORE = 5, 0.9, 0.9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, less 9 if over 9; the sum ends in 0."""
    back = F.reverse(digits)
    value = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _doubled(F.substring(back, i, F.lit(1)).cast("int"), i))
    return F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("00"), F.ltrim(p, F.lit("0"))), -3, 3) <= "255")
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _may_hold(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]") if kind != "phone" else F.contains(text, F.lit("+"))


def _found(text: Column, rx: str) -> tuple[Column, Column]:
    """Leftmost non-overlapping matches, and what lies between them."""
    return F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)


#: Matches that are placed together; see ``_placed``.
CHUNK = 512


def _placed(matches: Column, gaps: Column, ord_: int, kind: str) -> Column:
    """Matches as structs start, ord, kind, end (code points).  An array that grows by one is
    copied each time, so matches are placed ``CHUNK`` at a time and the chunks put together."""
    part = lambda c, k: F.slice(c, k * CHUNK + 1, F.least(F.lit(CHUNK), F.size(matches) - k * CHUNK))
    after = lambda at, x: at + F.length(x["g"]) + F.length(x["m"])

    def chunk(k: Column, at: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(part(matches, k).alias("m"), part(gaps, k).alias("g")), F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")),
            lambda acc, x: F.struct(
                after(acc["at"], x).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["g"])).alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), after(acc["at"], x).alias("end"))).alias("out"),
            ),
        )

    def joined(acc: Column, k: Column) -> Column:
        # The chunk is an array of one, so that it is made once for both its uses.
        both = lambda c: F.struct(c["at"].alias("at"), F.array_append(acc["outs"], c["out"]).alias("outs"))
        return F.get(F.transform(F.array(chunk(k, acc["at"])), both), 0)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("outs"))
    all_ = F.aggregate(F.sequence(F.lit(0), F.floor((F.greatest(F.size(matches), F.lit(1)) - 1) / CHUNK).cast("int")), start, joined, lambda acc: F.flatten(acc["outs"]))
    return F.when(F.size(matches) > 0, all_).otherwise(F.array().cast(_SPANS))


def _good(kind: str) -> Column:
    return F.filter(F.col(f"__s_{kind}"), lambda s, i: _holds(kind, F.get(F.col(f"__m_{kind}"), i)))


def _around(span: Column, inst: Column, gaps: Column, i: Column, known: bool) -> Column:
    """A candidate: place, text, and the ends of the gaps on its left and right."""
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), inst.alias("inst"), F.right(F.get(gaps, i), F.lit(80)).alias("left"),
        F.left(F.get(gaps, i + 1), F.lit(40)).alias("right"), F.lit(known).alias("known"),
    )


def _seen(kind: str) -> Column:
    all_ = F.transform(F.col(f"__s_{kind}"), lambda s, i: _around(s, F.get(F.col(f"__m_{kind}"), i), F.col(f"__g_{kind}"), i, True))
    return F.filter(all_, lambda x: _holds(kind, x["inst"]))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def with_base(docs: DataFrame, contexts: bool = False) -> DataFrame:
    """``docs`` (with a column text) and ``base``: the base entities by start, then kind.
    ``contexts`` adds ``seen``: the entities with their text and what stands around them."""
    out = docs
    none = F.array().cast("array<string>")
    for kind in KINDS:
        matches, gaps = _found(F.col("text"), EXPRESSIONS[kind])
        may = _may_hold(F.col("text"), kind)
        out = out.withColumns({f"__m_{kind}": F.when(may, matches).otherwise(none), f"__g_{kind}": F.when(may, gaps).otherwise(none)})
    out = out.withColumns({f"__s_{kind}": _placed(F.col(f"__m_{kind}"), F.col(f"__g_{kind}"), i, kind) for i, kind in enumerate(KINDS)})
    out = out.withColumn("base", F.array_sort(F.concat(*[_good(kind) for kind in KINDS])))
    if contexts:
        out = out.withColumn("seen", F.concat(*[_seen(kind) for kind in KINDS]))
    return out.drop(*[f"__{x}_{kind}" for x in "mgs" for kind in KINDS])


def _candidates(based: DataFrame) -> DataFrame:
    """What patterns may extract, with its contexts as patterns: base entities (known), and
    tokens with a digit or @ and runs of groups of digits that no base entity touches:
    ``(__doc, __h, start, end, inst, known, patterns)``.  Groups of under four digits in a run are
    no candidates of their own."""
    matches, gaps = _found(F.col("text"), _CANDIDATE)
    runs, between = _found(F.col("text"), _GROUPS)
    rows = based.where(F.col("text").rlike("[0-9@]")).select("__doc", "__h", "base", "seen", matches.alias("m"), gaps.alias("g"), runs.alias("rm"), between.alias("rg"))
    rows = rows.select("__doc", "__h", "base", "seen", "m", "g", "rm", "rg", _placed(F.col("m"), F.col("g"), 0, OTHER).alias("s"), _placed(F.col("rm"), F.col("rg"), 0, OTHER).alias("rs"))
    free = lambda x, of="base": ~F.exists(of, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    tokens = F.filter(
        F.transform("s", lambda s, i: _around(s, F.get("m", i), F.col("g"), i, False)), lambda x: ((F.length(_digits(x["inst"])) >= 4) | free(x, "rs")) & free(x)
    )
    grouped = F.filter(F.transform("rs", lambda s, i: _around(s, F.get("rm", i), F.col("rg"), i, False)), lambda x: free(x))
    rows = rows.select("__doc", "__h", F.explode(F.concat("seen", tokens, grouped)).alias("x")).select("__doc", "__h", "x.*")
    word = lambda side: F.lower(F.regexp_replace(side, r"[^\p{L}=:#_]", ""))
    parts = lambda side: F.split(F.trim(F.regexp_replace(side, r"\s+", " ")), " ")
    lead = F.when(F.col("known"), 0).otherwise(F.length(F.regexp_extract("inst", r"^[^\p{L}0-9+@]*", 0)))
    inst = F.when(F.col("known"), F.col("inst")).otherwise(F.regexp_replace("inst", r"^[^\p{L}0-9+@]+|[^\p{L}0-9]+$", ""))
    start = F.col("start") + lead
    rows = rows.select(
        "__doc", "__h", start.alias("start"), (start + F.length(inst)).alias("end"), inst.alias("inst"), "known",
        word(F.try_element_at(parts(F.col("left")), F.lit(-1))).alias("l1"), word(F.try_element_at(parts(F.col("left")), F.lit(-2))).alias("l2"),
        word(F.get(parts(F.col("right")), F.lit(0))).alias("r1"),
    ).where(F.col("known") | F.col("inst").rlike("[0-9@]"))
    pattern = lambda kind, *c: F.when(reduce(lambda a, b: a & b, [F.length(x) > 0 for x in c]), F.concat_ws(" ", F.lit(kind), *c))
    patterns = F.array_compact(F.array(pattern("L", F.col("l1")), pattern("LL", F.col("l2"), F.col("l1")), pattern("LR", F.col("l1"), F.col("r1"))))
    return rows.select("__doc", "__h", "start", "end", "inst", "known", patterns.alias("patterns"))


def discovered(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(inst)``: identifiers that trusted patterns extract and no base entity covers; and
    ``(pattern)``: the trusted patterns.

    Round by round over the pattern-instance graph: a pattern's confidence is the share of
    known instances among the distinct ones that it extracts; an instance's score is one
    minus the product of (1 - confidence) over its trusted patterns; accepted instances count
    as known in the next round.  More known instances never lower a score, so the rounds end
    when none is newly accepted.
    """
    graph = stored(
        candidates.select("inst", "known", F.explode("patterns").alias("pattern")).groupBy("pattern", "inst").agg(F.max("known").alias("seed")), "graph"
    )
    seeds = graph.groupBy("inst").agg(F.max("seed").alias("seed"))
    graph = stored(graph.drop("seed").join(seeds, "inst"), "graph")
    accepted = None
    size = 0
    while True:
        now = graph.withColumn("known", F.col("seed")) if accepted is None else graph.join(accepted.withColumn("new", F.lit(True)), "inst", "left").withColumn("known", F.col("seed") | F.coalesce("new", F.lit(False))).drop("new")
        trusted = now.groupBy("pattern").agg(F.count_if("known").alias("k"), F.count("*").alias("n")).where((F.col("k") >= LEAST_KNOWN) & (F.col("k") >= F.col("n") * LEAST_SHARE))
        trusted = stored(trusted.select("pattern", ((F.col("k") - 0.5) / F.col("n")).alias("conf")), "trusted")
        score = 1 - F.exp(F.sum(F.log(1 - F.col("conf"))))
        accepted = stored(graph.where("not seed").join(trusted, "pattern").groupBy("inst").agg(score.alias("score")).where(F.col("score") >= LEAST_SCORE).select("inst"), "accepted")
        if (n := accepted.count()) <= size:
            return accepted, trusted.select("pattern")
        size = n


def _hits(candidates: DataFrame) -> DataFrame:
    """``(__doc, __h, more)``: where discovered identifiers stand, as structs ``start, end`` by
    start, overlapping ones as one.  An identifier of six characters or more with four digits
    or @ counts wherever it stands; others, which occur by chance, under a trusted pattern."""
    accepted, trusted = discovered(candidates)
    found = candidates.where("not known").join(accepted, "inst")
    distinct = (F.length("inst") >= 6) & ((F.length(_digits(F.col("inst"))) >= 4) | F.contains("inst", F.lit("@")))
    under = found.where(~distinct).withColumn("pattern", F.explode("patterns")).join(trusted, "pattern", "left_semi")
    spans = found.where(distinct).select("__doc", "__h", "start", "end").union(under.select("__doc", "__h", "start", "end"))
    grouped = spans.groupBy("__doc", "__h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = F.aggregate(
        "more", F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            last(acc)["end"] > s["start"],
            F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))),
        ).otherwise(F.array_append(acc, s)),
    )
    return grouped.withColumn("more", joined)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__h": F.xxhash64(F.lit(7), "text")})


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, more`` per row: base entities and discovered identifiers as arrays of
    structs ``start, ord, kind, end`` (code points, end exclusive).  Null and empty texts have
    none; repeated rows each have theirs; other columns are ignored."""
    based = with_base(_keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), contexts=True)
    spans = F.transform("more", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), F.lit(OTHER).alias("kind"), s["end"].alias("end")))
    more = _hits(stored(_candidates(based), "candidates")).withColumn("more", spans)
    return based.select("doc_id", "__doc", "__h", "base").join(more, ["__doc", "__h"], "left").select("doc_id", "base", F.coalesce("more", F.array().cast(_SPANS)).alias("more"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base entities, hash of their places, and all spans, per row of ``docs``.  Null
    and empty texts have none of them; repeated rows each have theirs."""
    return find_spans(docs).select(
        "doc_id", *[_count(kind) for kind in KINDS], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.array_sort(F.concat("base", "more"))).alias("spans")
    )


def _replaced(text: Column, kind: str) -> Column:
    matches, gaps = _found(text, EXPRESSIONS[kind])
    mark = F.transform(matches, lambda m: F.when(_holds(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m))
    parts = F.transform(F.arrays_zip(gaps.alias("g"), mark.alias("m")), lambda x: F.concat(x["g"], F.coalesce(x["m"], F.lit(""))))
    return F.when(_may_hold(text, kind), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by [EMAIL], [IP], [CARD], [PHONE] and [ID] in
    ``text``; all other columns and rows stay, repeated ones too.  Null texts stay null."""
    keyed = _keyed(docs)
    based = with_base(keyed.select("__doc", "__h", F.coalesce("text", F.lit("")).alias("text")), contexts=True)
    candidates = stored(_candidates(based), "candidates")
    more = _hits(candidates).withColumnRenamed("more", "__more")
    out = keyed.join(more, ["__doc", "__h"], "left")
    cut = F.aggregate(
        F.reverse("__more"), F.col("text"),
        lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.lit("[ID]"), F.substring(acc, s["end"] + 1, F.length(acc))),
    )
    out = out.withColumn("text", F.when(F.col("__more").isNotNull(), cut).otherwise(F.col("text")))
    for kind in KINDS:
        out = out.withColumn("text", _replaced(F.col("text"), kind))
    return out.select(*docs.columns)
