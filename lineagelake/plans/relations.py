"""Sequencing relations derived from the test tables, in Spark and, as common table
expressions, in SQL.  Sequences come from md5, so both engines see the same letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.functions.expressions import made_once
from lineagelake.functions.storage import ship, spread

LEFT, RIGHT = "TGCACTTGAT", "ATCCGTTAGC"


def dna(x: Column) -> Column:
    """32 bases of a value."""
    return F.translate(F.md5(x.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def qual(x: Column) -> Column:
    """32 phred characters of a value."""
    return F.translate(F.md5(x.cast("string").cast("binary")), "0123456789abcdef", "!#%+5:=?ABCDFGHI")


def _dna(x: str) -> str:
    return f"translate(md5(CAST({x} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _qual(x: str) -> str:
    return f"translate(md5(CAST({x} AS VARCHAR)), '0123456789abcdef', '!#%+5:=?ABCDFGHI')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per line item: 50 barcodes, and a mutant of each, between fixed flanks.  The
    table may be one row group, which one task would turn into reads; hence ``spread``."""
    used = ("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_suppkey")
    t = spread(table(spark, sf_dir, "lineitem").select(*used))
    parent = dna(F.col("l_partkey") % 50)
    mutant = F.concat(F.substring(parent, 1, 4), F.translate(F.substring(parent, 5, 1), "ACGT", "CGTA"), F.substring(parent, 6, 27))
    p, q = dna(F.col("l_orderkey")), qual(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    out = t.select(
        F.concat("l_returnflag", "l_linestatus").alias("sample"), F.col("l_returnflag").alias("replicate"), F.col("l_linestatus").alias("condition"),
        F.when(F.col("l_quantity") == 1, mutant).otherwise(parent).alias("barcode_true"), p.alias("p"), q.alias("q"),
        F.substring(dna(F.col("l_suppkey")), 1, 16).alias("cell"), F.substring(p, 1, 8).alias("umi"), "l_linenumber",
    )
    # Letters and qualities made once, as if read: a filter on them would make them again.
    return out.select(
        "sample", "replicate", "condition", "barcode_true",
        made_once(F.concat(F.substring("p", 1, 8), F.lit(LEFT), "barcode_true", F.lit(RIGHT), F.substring("p", 9, 12))).alias("seq"),
        made_once(F.concat("q", "q", F.substring("q", 1, 8))).alias("qual"), "cell", "umi", "l_linenumber",
    )


READS = f"""base AS (
  SELECT l_returnflag || l_linestatus AS sample, l_returnflag AS replicate, l_linestatus AS condition, {_dna('l_partkey % 50')} AS parent,
    l_quantity, {_dna('l_orderkey')} AS p, {_qual("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)")} AS q,
    substr({_dna('l_suppkey')}, 1, 16) AS cell, l_linenumber
  FROM lineitem
), made AS (
  SELECT *, CASE WHEN l_quantity = 1 THEN substr(parent, 1, 4) || translate(substr(parent, 5, 1), 'ACGT', 'CGTA') || substr(parent, 6, 27) ELSE parent END AS barcode_true
  FROM base
), reads AS (
  SELECT sample, replicate, condition, barcode_true, substr(p, 1, 8) || '{LEFT}' || barcode_true || '{RIGHT}' || substr(p, 9, 12) AS seq,
    q || q || substr(q, 1, 8) AS qual, cell, substr(p, 1, 8) AS umi, l_linenumber
  FROM made
)"""


def reads_with_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reads`` whose barcode has N as its 20th base on every 7th line."""
    broken = F.concat(F.substring("seq", 1, 37), F.lit("N"), F.substring("seq", 39, 34))
    return reads(spark, sf_dir).withColumn("seq", F.when(F.col("l_linenumber") == 7, broken).otherwise(F.col("seq")))


READS_N = READS + """, reads_n AS (
  SELECT * REPLACE (CASE WHEN l_linenumber = 7 THEN substr(seq, 1, 37) || 'N' || substr(seq, 39, 34) ELSE seq END AS seq) FROM reads
)"""


def reads_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reads`` with one substitution in either flank: of base (line number mod 8) + 2."""
    k = F.col("l_linenumber") % 8
    put = lambda s, at: F.concat(F.substring("seq", s, k + 1), F.translate(F.substring(F.col("seq"), at, F.lit(1)), "ACGT", "CGTA"), F.substring(F.col("seq"), at + 1, 8 - k))
    left, right = put(9, k + 10), put(51, k + 52)
    return reads(spark, sf_dir).withColumn("seq", F.concat(F.substring("seq", 1, 8), left, F.substring("seq", 19, 32), right, F.substring("seq", 61, 12)))


def _put(first: int) -> str:
    k = "CAST(l_linenumber % 8 AS INTEGER)"
    return f"substr(seq, {first}, {k} + 1) || translate(substr(seq, {first + 1} + {k}, 1), 'ACGT', 'CGTA') || substr(seq, {first + 2} + {k}, 8 - {k})"


READS_E = READS + f""", reads_e AS (
  SELECT * REPLACE (substr(seq, 1, 8) || {_put(9)} || substr(seq, 19, 32) || {_put(51)} || substr(seq, 61, 12) AS seq) FROM reads
)"""


def read_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First and second reads of orders, by ordinal."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("ord"), "o_custkey")
    one = t.select("ord", dna(F.col("o_custkey")).alias("seq"))
    two = t.select("ord", F.concat(F.lit(LEFT), dna(F.col("ord") % 50), F.lit(RIGHT)).alias("seq"))
    return one, two


PAIRS = f"""pairs AS (
  SELECT CAST(o_orderkey AS BIGINT) AS ord, {_dna('o_custkey')} AS r1, '{LEFT}' || {_dna('o_orderkey % 50')} || '{RIGHT}' AS r2 FROM orders
)"""


def bam_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned-read records of events."""
    e = table(spark, sf_dir, "events")
    cell = F.substring(dna(F.col("user_id")), 1, 16)
    q = qual(F.col("event_id"))
    return e.select(
        F.concat(cell, F.lit("__"), F.col("event_id").cast("string")).alias("qname"), F.when(F.col("event_type") != "error", F.lit("chr1")).alias("contig"),
        F.concat(F.lit(LEFT), dna(F.col("user_id") % 50), F.lit(RIGHT)).alias("seq"), F.transform(F.split(q, ""), lambda c: F.ascii(c) - 33).alias("qual"),
        F.map_filter(F.create_map(F.lit("CB"), cell, F.lit("UB"), F.when(F.col("event_id") % 10 != 0, F.substring(q, 1, 8))), lambda k, v: v.isNotNull()).alias("tags"),
    )


BAM = f"""bam AS (
  SELECT substr({_dna('user_id')}, 1, 16) AS cb, event_id, CASE WHEN event_type <> 'error' THEN 'chr1' END AS contig, {_qual('event_id')} AS q,
    '{LEFT}' || {_dna('user_id % 50')} || '{RIGHT}' AS seq, CASE WHEN event_id % 10 <> 0 THEN substr({_qual('event_id')}, 1, 8) END AS ub
  FROM events
)"""


def dense(spark: SparkSession, sf_dir: str, letters: int = 6) -> DataFrame:
    """Short barcodes that lie close together, so that near ones chain: ``sample, barcode,
    counts`` of suppliers."""
    t = table(spark, sf_dir, "supplier")
    own = F.substring(dna(F.col("s_suppkey")), 1, letters)
    return t.groupBy(F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string")).alias("sample"), own.alias("barcode")).agg(F.sum(F.col("s_nationkey") + 1).cast("long").alias("counts"))


DENSE = f"""dense AS (
  SELECT 's' || CAST(s_suppkey % 3 AS VARCHAR) AS sample, substr({_dna('s_suppkey')}, 1, 6) AS barcode, CAST(sum(s_nationkey + 1) AS BIGINT) AS counts FROM supplier GROUP BY 1, 2
)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as many as orders: ``sequence, name, ord``."""
    t = table(spark, sf_dir, "orders")
    return t.select(dna(F.col("o_orderkey")).alias("sequence"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").cast("long").alias("ord"))


def library_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of its order's reference per line item, with as many substitutions as the line's
    number is over 5, and a base in excess before it on every third line."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("sample"))
    own, k = dna(F.col("l_orderkey")), F.col("l_linenumber")
    put = lambda s, at: F.concat(F.substring(s, 1, at - 1), F.translate(F.substring(s, at, 1), "ACGT", "CGTA"), F.substring(s, at + 1, 32))
    changed = F.when(k == 6, put(own, 7)).when(k == 7, put(put(own, 7), 25)).otherwise(own)
    return t.select("sample", F.concat(F.lit(LEFT), F.when(k % 3 == 0, F.lit("C")).otherwise(F.lit("")), changed, F.lit(RIGHT)).alias("seq"))


LIBRARY = f"""library AS (SELECT {_dna('o_orderkey')} AS sequence, 'order_' || CAST(o_orderkey AS VARCHAR) AS name FROM orders),
own AS (SELECT l_returnflag AS sample, l_linenumber AS k, {_dna('l_orderkey')} AS s FROM lineitem),
library_reads AS (
  SELECT sample, k, CASE WHEN k % 3 = 0 THEN 'C' ELSE '' END || CASE WHEN k < 6 THEN s WHEN k = 6 THEN substr(s, 1, 6) || translate(substr(s, 7, 1), 'ACGT', 'CGTA') || substr(s, 8)
    ELSE substr(s, 1, 6) || translate(substr(s, 7, 1), 'ACGT', 'CGTA') || substr(s, 8, 17) || translate(substr(s, 25, 1), 'ACGT', 'CGTA') || substr(s, 26) END AS core FROM own
)"""


def parents() -> str:
    """SQL of the 50 parents: ``seq, name, ord``."""
    return f"parents AS (SELECT {_dna('k')} AS seq, 'clone_' || CAST(k AS VARCHAR) AS name, CAST(k AS INTEGER) AS ord FROM range(50) AS r(k))"


def parent_list() -> list[str]:
    from hashlib import md5

    return [md5(str(k).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")) for k in range(50)]
