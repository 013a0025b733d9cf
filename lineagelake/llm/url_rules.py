"""URL filtering by association rules: fixed host rules first, then rules that FP-growth
mines from labelled URLs, matched by an inverted index.  DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Host, path prefix, verdict.
FIXED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_BLOCK, _ALLOW = "=block", "=allow"
#: A mined rule holds for so many labelled URLs and such a share of all, and blocks so many
#: times as often as URLs at large, even at the lower end of its confidence's 95 % interval.
LEAST_URLS, LEAST_SUPPORT, LEAST_LIFT = 20, 0.002, 1.5


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path`` of the column ``url``; both empty where it is null
    or has no ``://``."""
    rest = F.when(F.contains("url", F.lit("://")), F.substring("url", F.instr("url", F.lit("://")) + 3, F.length("url")))
    clean = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(clean, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(clean, F.length(host) + 1, F.length(clean)), r"(?s)^[^?#]*", 0)
    return pages.withColumns({"host": _lower(host), "path": path})


def fixed_rule() -> tuple[Column, Column]:
    """The longest fixed rule that fits host and path, and its verdict; else null."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, says in sorted(FIXED, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of a URL: labels of the host, words of the path; numbers are left out."""
    part = lambda c, sep, mark: F.transform(F.split(F.lower(c), sep), lambda t: F.concat(F.lit(mark), t))
    all_ = F.concat(part(F.col("host"), r"\.", "h:"), part(F.col("path"), r"[^\p{L}0-9]+", "p:"))
    return F.array_distinct(F.filter(all_, lambda t: ~t.rlike(r"^.:[0-9]*$")))


def _together(labelled: DataFrame) -> DataFrame:
    """``(token, head)``: tokens that stand in the same labelled URLs, by the first of them.
    They say the same, so the miner sees one item for all: k of them would make 2^k sets."""
    urls = labelled.select(F.monotonically_increasing_id().alias("u"), "tokens")
    where = urls.select("u", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("where"))
    heads = where.groupBy("n", "where").agg(F.min("token").alias("head"))
    return where.join(heads, ["n", "where"]).select("token", "head")


def mine(labelled: DataFrame, support: float = LEAST_SUPPORT, urls: int = LEAST_URLS, lift: float = LEAST_LIFT) -> DataFrame:
    """``(rule_id, antecedent, confidence, support, lift)`` from rows ``tokens, blocked``.

    FP-growth mines the frequent combinations of tokens with a verdict among the items; rules
    towards block stay if enough URLs carry them and the lower end of the confidence's Wilson
    interval is ``lift`` times the share of blocked URLs.  A rule that contains a shorter kept
    one matches nothing more, and goes.  Rows without tokens count in the shares only; labels
    that have nothing to do with the URLs give no rule.
    """
    spark = labelled.sparkSession
    n, blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    if not blocked:
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, support double, lift double")
    base = blocked / n
    same = stored(_together(labelled), "together")
    rows = labelled.withColumn("u", F.monotonically_increasing_id()).select("u", "blocked", F.explode_outer("tokens").alias("token")).join(same, "token", "left")
    verdict = F.when(F.first("blocked"), _BLOCK).otherwise(_ALLOW)
    items = stored(rows.groupBy("u").agg(F.array_append(F.collect_set("head"), verdict).alias("items")), "items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, urls / n)), minConfidence=min(1.0, lift * base)).fit(items)
    rules = model.associationRules.where((F.element_at("consequent", 1) == _BLOCK) & ~F.array_contains("antecedent", _ALLOW))
    hits = F.col("support") * n
    z, total = 1.96, hits / F.col("confidence")
    low = (F.col("confidence") + z * z / (2 * total) - z * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) / total + z * z / (4 * total * total))) / (1 + z * z / total)
    kept = rules.where((total >= urls) & (low >= lift * base))
    kept = kept.select(F.xxhash64(F.sort_array("antecedent")).alias("rule_id"), "antecedent", "confidence", "support", (F.col("confidence") / base).alias("lift"))
    kept = stored(kept, "rules")
    inside = kept.select(F.col("antecedent").alias("short"), F.array_min("antecedent").alias("token"))
    longer = kept.select("rule_id", "antecedent", F.explode("antecedent").alias("token")).join(inside, "token")
    longer = longer.where((F.size("short") < F.size("antecedent")) & (F.size(F.array_except("short", "antecedent")) == 0))
    kept = kept.join(longer.select("rule_id").distinct(), "rule_id", "left_anti")
    spelt = kept.select("rule_id", "confidence", "support", "lift", F.explode("antecedent").alias("head")).join(same, "head")
    return spelt.groupBy("rule_id").agg(F.sort_array(F.collect_set("token")).alias("antecedent"), *[F.first(c).alias(c) for c in ("confidence", "support", "lift")])


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` of rows ``url, tokens`` that a rule fits.

    Inverted index: a rule is posted under its rarest token only; a URL looks up its tokens
    and checks the rest of each rule found there.
    """
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token")).join(counts, "token")
    index = each.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("r"), F.first("antecedent").alias("antecedent")).select(F.col("r.token").alias("token"), "antecedent")
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return looked.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    A fixed rule decides where one fits; else the mined rules: block where one fits, allow
    otherwise.  A labelled page (``labels.doc_id`` = page_id) teaches block if its quality
    is 0.  Null labels teach nothing; null URLs have empty parts and are allowed; repeated
    rows are judged alike; other columns are ignored.
    """
    parts = with_parts(pages.select("page_id", "url"))
    rule, verdict = fixed_rule()
    parts = parts.withColumns({"rule": rule, "said": verdict, "tokens": tokens()})
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taught = parts.where("url is not null").join(known, parts["page_id"] == known["doc_id"]).select("tokens", (F.col("quality") == 0).alias("blocked"))
    rules = stored(mine(stored(taught, "taught"), **options), "rules")
    undecided = F.col("said").isNull() & F.col("url").isNotNull()
    open_ = parts.where(undecided).groupBy("url").agg(F.first("tokens").alias("tokens"))
    hit = matched(stored(open_, "urls"), rules).withColumn("hit", F.lit("block"))
    columns = ("page_id", "host", "path", "rule")
    judged = parts.where(undecided).join(hit, "url", "left").select(*columns, F.coalesce("hit", F.lit("allow")).alias("verdict"))
    return judged.union(parts.where(~undecided).select(*columns, F.coalesce("said", F.lit("allow")).alias("verdict")))
