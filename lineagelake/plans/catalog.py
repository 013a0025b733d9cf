"""Registered queries by name, and their SQL equivalents, over the derived relations."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.functions import expressions as X
from lineagelake.functions import kernels as K
from lineagelake.functions.storage import shared_dir, stored
from lineagelake.operators import abundance, clones, collapse, counting, matrix, references, simulate, stats
from lineagelake.plans import relations as R
from lineagelake.plans.extract import Config, extract, finder
from lineagelake.sources import bam, fastq, tables, wide

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLANKED = f"{R.LEFT}*{R.RIGHT}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _good(alias: str, code: str, pct: int) -> str:
    return f"100.0 * length(regexp_replace({alias}, '[^{code}-~]', '', 'g')) / length({alias}) >= {pct}"


def _tally(source: str, barcode: str, ctes: str, where: str = "true") -> str:
    return f"WITH {ctes} SELECT sample, {barcode} AS barcode, count(*) AS counts FROM {source} WHERE {where} AND length({barcode}) > 0 AND NOT contains({barcode}, 'N') GROUP BY 1, 2"


# -- the flagship ----------------------------------------------------------------------


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality filter, extraction, length gate and counts per sample."""
    rows = R.reads(spark, sf_dir).where(X.qc_pass(F.col("qual"), 20, 70))
    found = counting.with_barcode(rows, X.extract(F.col("seq"), FLANKED), X.length_gate(F.col("barcode"), True, 32))
    return counting.count_reads(found, ["sample"])


_COUNTED = R.READS + f""", counted AS (
  SELECT sample, regexp_extract(seq, '{R.LEFT}(.*){R.RIGHT}', 1) AS barcode, count(*) AS counts FROM reads
  WHERE {_good('qual', '5', 70)} AND length(regexp_extract(seq, '{R.LEFT}(.*){R.RIGHT}', 1)) = 32 GROUP BY 1, 2
), share AS (SELECT *, counts / sum(counts) OVER (PARTITION BY sample) * 100 AS pct FROM counted),
flagship AS (SELECT sample, barcode, counts FROM share WHERE pct >= 0.01)"""


@query(f"WITH {_COUNTED} SELECT * FROM flagship")
def extract_dna_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundance.filter_abundance(_counted(spark, sf_dir), relative=0.01)


# -- quality ---------------------------------------------------------------------------


def _passing(spark: SparkSession, sf_dir: str, ok: Column) -> DataFrame:
    return R.reads(spark, sf_dir).where(ok).groupBy("sample").agg(F.count("*").alias("n_reads"))


@query(f"WITH {R.READS} SELECT sample, count(*) AS n_reads FROM reads WHERE {_good('qual', '5', 70)} GROUP BY 1")
def qc_filter_phred33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, X.qc_pass(F.col("qual"), 20, 70))


@query(f"WITH {R.READS} SELECT sample, count(*) AS n_reads FROM reads WHERE {_good('qual', 'B', 40)} GROUP BY 1")
def qc_filter_phred64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, X.qc_pass(F.col("qual"), 2, 40, phred33=False))


@query(f"WITH {R.BAM} SELECT coalesce(contig, '*') AS contig, count(*) AS n_reads FROM bam WHERE {_good('q', '5', 70)} GROUP BY 1")
def qc_filter_int_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.bam_like(spark, sf_dir).where(X.qc_pass_ints(F.col("qual"), 20, 70))
    return rows.groupBy(F.coalesce("contig", F.lit("*")).alias("contig")).agg(F.count("*").alias("n_reads"))


# -- patterns --------------------------------------------------------------------------


def _extracted(rows: DataFrame, barcode: Column) -> DataFrame:
    return counting.count_reads(counting.with_barcode(rows, barcode))


@query(_tally("reads", "regexp_extract(seq, 'ATCCGTTAGC', 0)", R.READS))
def extract_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir), X.extract(F.col("seq"), "ATCCGTTAGC"))


@query(_tally("reads_n", "regexp_extract(seq, 'ACTTGAT.{32}ATCC', 0)", R.READS_N))
def extract_n_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads_with_n(spark, sf_dir), X.extract(F.col("seq"), "ACTTGAT" + "N" * 32 + "ATCC"))


@query(_tally("reads", "right(regexp_extract(seq, '(.*)ATCCGTTAGC', 1), 32)", R.READS))
def extract_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir), X.extract(F.col("seq"), f"*{R.RIGHT}", max_read_length=32))


@query(_tally("reads", "regexp_extract(seq, '(.{32})ATCCGTTAGC', 1)", R.READS))
def extract_left_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir), X.extract(F.col("seq"), f"*{R.RIGHT}", read_length=32))


@query(_tally("reads", "regexp_extract(seq, 'TGCACTTGAT(.*)', 1)", R.READS))
def extract_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir), X.extract(F.col("seq"), f"{R.LEFT}*"))


@query(_tally("reads", "left(regexp_extract(seq, 'TGCACTTGAT(.*)', 1), 32)", R.READS))
def extract_right_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir), X.extract(F.col("seq"), f"{R.LEFT}*", max_read_length=32))


@query(_tally("reads", f"regexp_extract(seq, '{R.LEFT}(.*){R.RIGHT}', 1)", R.READS))
def extract_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir), X.extract(F.col("seq"), FLANKED))


@query(f"WITH {R.READS}, m AS (SELECT sample, regexp_extract(seq, 'ACG(.*)ATCCGTTAGC', 1) AS b FROM reads) SELECT sample, count(*) AS n_reads FROM m WHERE length(b) BETWEEN 20 AND 40 AND NOT contains(b, 'N') GROUP BY 1")
def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counting.with_barcode(R.reads(spark, sf_dir), X.extract(F.col("seq"), "ACG*ATCCGTTAGC"), X.length_gate(F.col("barcode"), True, 0, 20, 40))
    return found.groupBy("sample").agg(F.count("*").alias("n_reads"))


@query(f"WITH {R.READS_N} SELECT sample, count(*) AS n_reads FROM reads_n WHERE NOT contains(seq, 'N') GROUP BY 1")
def reject_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reads_with_n(spark, sf_dir).where(X.no_n(F.col("seq"))).groupBy("sample").agg(F.count("*").alias("n_reads"))


# -- counting --------------------------------------------------------------------------


@query(f"WITH {R.READS} SELECT sample, barcode_true AS barcode, count(*) AS counts FROM reads GROUP BY 1, 2")
def count_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_reads(R.reads(spark, sf_dir).withColumnRenamed("barcode_true", "barcode"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_umis(R.reads(spark, sf_dir).withColumnRenamed("barcode_true", "barcode"))


_CELLS = R.READS + ", cells AS (SELECT sample, cell, barcode_true AS barcode, count(DISTINCT umi) AS counts FROM reads GROUP BY 1, 2, 3)"


@query(f"WITH {_CELLS} SELECT * FROM cells")
def umi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(f"WITH {R.READS} SELECT sample, cell, barcode_true AS barcode, count(*) AS counts FROM reads GROUP BY 1, 2, 3")
def read_counts_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_reads(R.reads(spark, sf_dir).withColumnRenamed("barcode_true", "barcode"), ["sample", "cell"])


_WHITE = f"white AS (SELECT DISTINCT substr({R._dna('s_suppkey')}, 1, 16) AS cell FROM supplier WHERE s_suppkey % 2 = 0)"


@query(f"WITH {R.READS}, {_WHITE} SELECT cell, count(*) AS n_reads FROM reads WHERE cell IN (SELECT cell FROM white) GROUP BY 1")
def cell_whitelist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = R.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.substring(R.dna(F.col("s_suppkey")), 1, 16).alias("cell")).distinct()
    return counting.whitelisted(R.reads(spark, sf_dir), white).groupBy("cell").agg(F.count("*").alias("n_reads"))


@query(f"WITH {R.PAIRS} SELECT ord, r1 || r2 AS seq, substr(r1, 1, 16) || '-1' AS cell, substr(r1, 17, 8) AS umi FROM pairs")
def paired_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = R.read_pairs(spark, sf_dir)
    pair = counting.paired(one, two, ["ord"])
    return pair.select("ord", F.concat("r1.seq", "r2.seq").alias("seq"), X.with_suffix(X.cell_of_read(F.col("r1.seq")), "1").alias("cell"), X.umi_of_read(F.col("r1.seq")).alias("umi"))


@query(f"WITH {R.BAM} SELECT cb AS cell, count(*) AS n_reads, count(DISTINCT ub) AS n_umis FROM bam WHERE contig IS NULL AND ub IS NOT NULL GROUP BY 1")
def parse_cell_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.bam_like(spark, sf_dir).where("contig is null").select(X.cell_of_name(F.col("qname")).alias("cell"), F.col("tags")["UB"].alias("umi")).dropna()
    return rows.groupBy("cell").agg(F.count("*").alias("n_reads"), F.countDistinct("umi").alias("n_umis"))


@query("SELECT CAST(user_id AS VARCHAR) || '_' || CAST(event_id % 7 AS VARCHAR) AS cell, count(*) AS n_reads FROM events GROUP BY 1")
def coordinate_cell_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = X.cell_of_coordinates(F.col("user_id"), F.col("event_id") % 7)
    return R.table(spark, sf_dir, "events").groupBy(cell.alias("cell")).agg(F.count("*").alias("n_reads"))


@query(f"WITH {R.READS} SELECT cell || '_' || sample AS cell, count(*) AS n_reads FROM reads GROUP BY 1")
def cell_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reads(spark, sf_dir).groupBy(F.concat_ws("_", "cell", "sample").alias("cell")).agg(F.count("*").alias("n_reads"))


# -- abundance -------------------------------------------------------------------------


@query(f"WITH {_COUNTED} SELECT * FROM counted WHERE counts >= 20")
def filter_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundance.filter_abundance(_counted(spark, sf_dir), raw=20, relative=99)


@query(f"WITH {_COUNTED} SELECT sample, barcode, counts, round(pct, 6) AS relative_abundance FROM share WHERE pct >= 0.5")
def filter_rel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = abundance.with_share(_counted(spark, sf_dir)).where("relative_abundance >= 0.5")
    return out.withColumn("relative_abundance", F.round("relative_abundance", 6))


@query(f"""WITH {_COUNTED}, r AS (SELECT *, substr(sample, 1, 1) AS replicate FROM counted),
s AS (SELECT *, sum(counts) OVER (PARTITION BY replicate, barcode) / sum(counts) OVER (PARTITION BY replicate) * 100 AS pct FROM r)
SELECT sample, barcode, counts, replicate FROM s WHERE pct >= 0.5""")
def filter_rel_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counted(spark, sf_dir).withColumn("replicate", F.substring("sample", 1, 1))
    return abundance.filter_abundance(counts, relative=0.5, within="replicate")


@query(f"WITH {_COUNTED} SELECT sample, barcode, counts FROM counted")
def drop_all_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counted(spark, sf_dir)
    sheet = counts.select("sample").distinct().withColumns({"replicate": F.lit(" "), "condition": F.lit("")})
    return counting.without_empty_columns(counting.with_metadata(counts, sheet)).select("sample", "barcode", "counts")


@query(f"WITH {_CELLS} SELECT sample, cell, barcode, counts FROM cells")
def explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _cells(spark, sf_dir).groupBy("sample", "cell").agg(F.collect_list(F.struct("barcode", "counts")).alias("x"))
    return counting.exploded(nested.select("sample", "cell", F.col("x.barcode").alias("barcode"), F.col("x.counts").alias("counts")))


# -- similarity and collapse -----------------------------------------------------------


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("barcode").distinct()


_HAM = "hamming(a.barcode, b.barcode)"
_DISTINCT = _COUNTED + ", d AS (SELECT DISTINCT barcode FROM counted)"


@query(f"""WITH {_DISTINCT}, g AS (SELECT DISTINCT barcode, substr(barcode, CAST(i AS BIGINT), 10) AS gram FROM d, range(1, 24) AS r(i))
SELECT DISTINCT a.barcode AS a, b.barcode AS b FROM g a JOIN g b ON a.gram = b.gram AND a.barcode < b.barcode""")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = _distinct(spark, sf_dir).select("barcode", F.explode(X.ngrams(F.col("barcode"), 10)).alias("gram"))
    return grams.withColumnRenamed("barcode", "a").join(grams.withColumnRenamed("barcode", "b"), "gram").where("a < b").select("a", "b").distinct()


def _pairs(spark: SparkSession, sf_dir: str, equal: bool) -> DataFrame:
    near = collapse.near_pairs(_distinct(spark, sf_dir).withColumn("block", F.lit("")), 2, equal)
    return near.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dist").cast("long").alias("dist"))


@query(f"WITH {_DISTINCT} SELECT a.barcode AS a, b.barcode AS b, CAST({_HAM} AS BIGINT) AS dist FROM d a JOIN d b ON a.barcode < b.barcode AND {_HAM} <= 2")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, True)


@query(f"WITH {_DISTINCT} SELECT a.barcode AS a, b.barcode AS b, CAST(levenshtein(a.barcode, b.barcode) AS BIGINT) AS dist FROM d a JOIN d b ON a.barcode < b.barcode AND levenshtein(a.barcode, b.barcode) <= 2")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, False)


_CLUSTERED = _COUNTED + f""", m AS (SELECT barcode, max(counts) AS c FROM flagship GROUP BY 1),
clusters AS (SELECT a.barcode, arg_min(b.barcode, (-b.c, b.barcode)) AS cluster FROM m a JOIN m b ON {_HAM} <= 2 GROUP BY 1),
tops AS (SELECT cluster, max(counts) AS top, arg_min(f.barcode, (-f.counts, f.barcode)) AS main FROM flagship f JOIN clusters USING (barcode) GROUP BY 1)"""


def _collapsed_sql(ratio: int) -> str:
    return f"""WITH {_CLUSTERED} SELECT sample, CASE WHEN top >= counts * {ratio} THEN main ELSE f.barcode END AS barcode, CAST(sum(counts) AS BIGINT) AS counts
FROM flagship f JOIN clusters c ON f.barcode = c.barcode JOIN tops USING (cluster) GROUP BY 1, 2"""


@query(f"WITH {_CLUSTERED} SELECT barcode, cluster FROM clusters")
def cluster_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.cluster(extract_dna_long(spark, sf_dir), 2)


@query(_collapsed_sql(1))
def collapse_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(extract_dna_long(spark, sf_dir), 2)


@query(_collapsed_sql(50))
def collapse_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(extract_dna_long(spark, sf_dir), 2, 50)


# The greedy rule itself, barcode by barcode in order: ``lead`` is each barcode's block so far,
# ``root`` its cluster so far, both as lists over the numbers of the barcodes.
_CHAINS = R.DENSE + """, o AS (SELECT barcode, CAST(row_number() OVER (ORDER BY max(counts) DESC, barcode) AS INTEGER) AS i FROM dense GROUP BY 1),
size AS (SELECT CAST(count(*) AS INTEGER) AS n FROM o),
g AS (SELECT DISTINCT i, substr(barcode, CAST(p AS BIGINT), 3) AS gram FROM o, range(1, 5) AS r(p)),
adj AS (SELECT a.i, list(DISTINCT b.i) AS js FROM g a JOIN g b USING (gram) GROUP BY 1),
blocking(i, lead) AS (
  SELECT 0, list_resize(CAST([] AS INTEGER[]), n, 0) FROM size
  UNION ALL SELECT a.i, CASE WHEN b.lead[a.i] <> 0 THEN b.lead ELSE list_transform(range(1, n + 1), lambda j: CASE WHEN b.lead[j] = 0 AND list_contains(js, j) THEN a.i ELSE b.lead[j] END) END
  FROM blocking b JOIN adj a ON a.i = b.i + 1, size
), lead AS (SELECT unnest(lead) AS lead, unnest(range(1, n + 1)) AS i FROM blocking, size WHERE i = n),
b AS (SELECT o.i, barcode, lead FROM o JOIN lead USING (i)),
near AS (SELECT a.i, list({'d': hamming(a.barcode, b.barcode), 'j': b.i} ORDER BY hamming(a.barcode, b.barcode), b.i) AS js FROM b a JOIN b ON a.lead = b.lead AND b.i < a.i AND hamming(a.barcode, b.barcode) <= 2 GROUP BY 1),
rooting(i, root) AS (
  SELECT 0, CAST([] AS INTEGER[])
  UNION ALL SELECT o.i, list_append(r.root, coalesce(list_filter(near.js, lambda x: r.root[x.j] = x.j)[1].j, o.i)) FROM rooting r JOIN o ON o.i = r.i + 1 LEFT JOIN near ON near.i = o.i
), roots AS (SELECT unnest(root) AS root, unnest(range(1, n + 1)) AS i FROM rooting, size WHERE i = n),
clusters AS (SELECT a.barcode, c.barcode AS cluster FROM o a JOIN roots USING (i) JOIN o c ON c.i = root)"""


@query(f"WITH RECURSIVE {_CHAINS} SELECT barcode, cluster FROM clusters")
def cluster_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of barcodes so dense that near ones chain."""
    return collapse.cluster(R.dense(spark, sf_dir), 2)


@query(f"""WITH RECURSIVE {_CHAINS}, tops AS (SELECT cluster, max(counts) AS top, arg_min(f.barcode, (-f.counts, f.barcode)) AS main FROM dense f JOIN clusters USING (barcode) GROUP BY 1)
SELECT sample, CASE WHEN top >= counts * 2 THEN main ELSE f.barcode END AS barcode, CAST(sum(counts) AS BIGINT) AS counts
FROM dense f JOIN clusters c ON f.barcode = c.barcode JOIN tops USING (cluster) GROUP BY 1, 2""")
def collapse_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their counts merged where the cluster's largest is twice theirs."""
    return collapse.collapse(R.dense(spark, sf_dir), 2, 2)


# -- matrix ----------------------------------------------------------------------------

# Every barcode there can be: the parents and the mutant of each.
_ALL = sorted(x for p in R.parent_list() for x in (p, p[:4] + p[4].translate(str.maketrans("ACGT", "CGTA")) + p[5:]))


@query(f"WITH {_COUNTED} SELECT sample, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN barcode = '{b}' THEN counts END), 0) AS BIGINT) AS \"{b}\"" for b in _ALL) + " FROM counted GROUP BY 1")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.wide(_counted(spark, sf_dir))


@query(f"""WITH {_COUNTED}, grid AS (SELECT sample, barcode FROM (SELECT DISTINCT sample FROM counted) a, (SELECT DISTINCT barcode FROM counted) b)
SELECT g.sample, g.barcode, coalesce(counts, 0) AS counts FROM grid g LEFT JOIN counted c ON g.sample = c.sample AND g.barcode = c.barcode""")
def long_complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.complete(_counted(spark, sf_dir))


@query(f"""WITH {_CELLS} SELECT cell, count(*) AS n_barcodes_by_counts, CAST(sum(counts) AS BIGINT) AS total_counts,
round(ln(1 + count(*)), 6) AS log1p_n_barcodes_by_counts, round(ln(1 + sum(counts)), 6) AS log1p_total_counts FROM cells GROUP BY 1""")
def qc_metrics_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matrix.qc_obs(_cells(spark, sf_dir), "cell")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("log1p")})


@query(f"""WITH {_CELLS}, n AS (SELECT count(DISTINCT cell) AS n FROM cells)
SELECT barcode, count(DISTINCT cell) AS n_cells_by_counts, CAST(sum(counts) AS BIGINT) AS total_counts, round(sum(counts) / any_value(n), 6) AS mean_counts,
round(ln(1 + sum(counts) / any_value(n)), 6) AS log1p_mean_counts, round((1 - count(DISTINCT cell) / any_value(n)) * 100, 6) AS pct_dropout_by_counts,
round(ln(1 + sum(counts)), 6) AS log1p_total_counts FROM cells, n GROUP BY 1""")
def qc_metrics_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matrix.qc_var(_cells(spark, sf_dir), "cell")
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


# -- references and adapters -----------------------------------------------------------


@query(f"WITH {R.READS_N}, {R.parents()} SELECT sample, p.seq AS barcode, count(*) AS counts FROM reads_n r JOIN parents p ON contains(r.seq, p.seq) WHERE NOT contains(r.seq, 'N') GROUP BY 1, 2")
def reference_exact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads_with_n(spark, sf_dir), X.find_listed(F.col("seq"), R.parent_list()))


@query(f"WITH {R.READS_N}, {R.parents()} SELECT sample, p.name AS barcode, count(*) AS counts FROM reads_n r JOIN parents p ON contains(r.seq, p.seq) WHERE NOT contains(r.seq, 'N') GROUP BY 1, 2")
def reference_exact_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {s: f"clone_{k}" for k, s in enumerate(R.parent_list())}
    found = counting.with_barcode(R.reads_with_n(spark, sf_dir).select("sample", "seq"), K.find_listed(F.col("seq"), list(names)))
    return counting.count_reads(counting.named(found, counting.names_table(spark, names)))


@query(f"WITH {R.READS}, {R.parents()} SELECT sample, p.name AS barcode, count(*) AS counts FROM reads r JOIN parents p ON hamming(r.barcode_true, p.seq) <= 1 GROUP BY 1, 2")
def reference_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {s: f"clone_{k}" for k, s in enumerate(R.parent_list())}
    found = counting.with_barcode(R.reads(spark, sf_dir).select("sample", "seq"), K.find_near(F.col("seq"), list(names), 1))
    return counting.count_reads(counting.named(found, counting.names_table(spark, names)))


@query(f"WITH {R.LIBRARY}, w AS (SELECT sample, right(core, 32) AS s FROM library_reads UNION ALL SELECT sample, left(core, 32) FROM library_reads WHERE k % 3 = 0) SELECT sample, name AS barcode, count(*) AS counts FROM w JOIN library ON s = sequence GROUP BY 1, 2")
def reference_join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as many as orders, by a join."""
    return counting.count_reads(references.with_reference(R.library_reads(spark, sf_dir), R.library(spark, sf_dir)))


@query(f"""WITH {R.LIBRARY}, h AS (SELECT sample, right(core, 32) AS s FROM library_reads),
met AS (SELECT sample, name FROM h JOIN library ON left(s, 16) = left(sequence, 16) WHERE hamming(s, sequence) <= 1
  UNION ALL SELECT sample, name FROM h JOIN library ON right(s, 16) = right(sequence, 16) AND left(s, 16) <> left(sequence, 16) WHERE hamming(s, sequence) <= 1)
SELECT sample, name AS barcode, count(*) AS counts FROM met GROUP BY 1, 2""")
def reference_join_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as many as orders, within one edit, by a join."""
    return counting.count_reads(references.with_reference(R.library_reads(spark, sf_dir), R.library(spark, sf_dir), 1))


@query(_tally("reads", "right(regexp_extract(seq, '^(.*?)ATCCGTTAGC', 1), 32)", R.READS))
def adapter_trim_3p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir).select("sample", "seq"), K.trim(F.col("seq"), f"*{R.RIGHT}", 0.1, max_read_length=32))


@query(_tally("reads", "left(regexp_extract(seq, '^.*?TGCACTTGAT(.*)$', 1), 32)", R.READS))
def adapter_trim_5p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir).select("sample", "seq"), K.trim(F.col("seq"), f"{R.LEFT}*", 0.1, max_read_length=32))


@query(_tally("reads", "regexp_extract(seq, '^.*?TGCACTTGAT(.*?)ATCCGTTAGC', 1)", R.READS))
def adapter_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(R.reads(spark, sf_dir).select("sample", "seq"), K.trim(F.col("seq"), FLANKED, 0.1))


# Where a flank lies with at most one substitution: of the fewest, the leftmost.
def _near_flank(seq: str, flank: str) -> str:
    return f"(SELECT arg_min(i, (hamming(substr({seq}, i, 10), '{flank}'), i)) FROM range(1, length({seq}) - 8) AS p(i) WHERE hamming(substr({seq}, i, 10), '{flank}') <= 1)"


@query(f"""WITH {R.READS_E}, l AS (SELECT sample, substr(seq, CAST({_near_flank('seq', R.LEFT)} + 10 AS BIGINT)) AS rest FROM reads_e),
b AS (SELECT sample, substr(rest, 1, CAST({_near_flank('rest', R.RIGHT)} - 1 AS BIGINT)) AS barcode FROM l)
SELECT sample, barcode, count(*) AS counts FROM b WHERE length(barcode) > 0 GROUP BY 1, 2""")
def adapter_linked_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flanks of which each has a substitution in every read."""
    return _extracted(R.reads_with_errors(spark, sf_dir).select("sample", "seq"), K.trim(F.col("seq"), FLANKED, 0.1))


# -- files -----------------------------------------------------------------------------


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


@query(f"WITH {_COUNTED} SELECT sample, barcode, counts FROM counted")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads written as FASTQ, a folder for each sample, and extracted from the files."""
    folder = _run_folder(spark)
    rows = R.reads(spark, sf_dir).select("sample", F.concat_ws("\n", F.lit("@r"), "seq", F.lit("+"), "qual").alias("value"))
    rows.write.partitionBy("sample").text(folder)
    read = fastq.read_fastq(spark, f"{folder}/*").withColumn("sample", F.regexp_extract("file", "sample=([^/]*)", 1))
    found = counting.with_barcode(read.where(X.qc_pass(F.col("qual"), 20, 70)), X.extract(F.col("seq"), FLANKED), X.length_gate(F.col("barcode"), True, 32))
    return counting.count_reads(found, ["sample"])


@query(f"WITH {_COUNTED} SELECT sample, barcode, counts FROM counted")
def bgzip_fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads as block-gzipped FASTQ, a folder for each sample, through the extraction plan."""
    folder = _run_folder(spark)
    rows = stored(R.reads(spark, sf_dir).select("sample", F.concat_ws("\n", F.lit("@r"), "seq", F.lit("+"), "qual").alias("value")), "reads")
    names = [r["sample"] for r in rows.select("sample").distinct().collect()]  # six
    for s in names:
        fastq.write_bgzf(rows.where(F.col("sample") == s), f"{folder}/{s}")
    sheet = spark.createDataFrame([(s, f"{folder}/{s}") for s in names], "sample string, fastq_path_r1 string")
    return extract(spark, sheet, Config(reference=FLANKED, flanked_pattern=True, read_length=32, read_qc_threshold=20, read_qc_percentage=70))


@query(f"""WITH {R.PAIRS} SELECT 's' AS sample, substr(r1, 1, 16) || '-1_s' AS cell, regexp_extract(r2, '{R.LEFT}(.*){R.RIGHT}', 1) AS barcode, count(DISTINCT substr(r1, 17, 8)) AS counts
FROM pairs GROUP BY 1, 2, 3""")
def paired_fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs as FASTQ files, several for either read, through the extraction plan for cells."""
    folder = _run_folder(spark)
    one, two = R.read_pairs(spark, sf_dir)
    pairs = stored(one.withColumnRenamed("seq", "r1").join(two.withColumnRenamed("seq", "r2"), "ord"), "pairs")
    for k in ("r1", "r2"):
        line = F.concat_ws("\n", F.concat(F.lit("@"), F.col("ord").cast("string")), k, F.lit("+"), F.regexp_replace(k, ".", "@"))
        pairs.select(line.alias("value"), "ord").repartition(5, "ord").sortWithinPartitions("ord").select("value").write.text(f"{folder}/{k}")
    sheet = spark.createDataFrame([("s", f"{folder}/r1", f"{folder}/r2")], "sample string, fastq_path_r1 string, fastq_path_r2 string")
    return extract(spark, sheet, Config(sequencing_technology="10x", reference=FLANKED, flanked_pattern=True, read_length=32))


@query(f"""WITH {R.BAM} SELECT 's' AS sample, cb || '_s' AS cell, regexp_extract(seq, '{R.LEFT}(.*){R.RIGHT}', 1) AS barcode, count(DISTINCT ub) AS counts
FROM bam WHERE contig IS NULL AND ub IS NOT NULL AND {_good('left(q || q, length(seq))', '5', 70)} GROUP BY 1, 2, 3""")
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as BAM files, their unmapped reads through the extraction plan for cells.  The
    relation's qualities are those of 32 bases; the file takes as many as the read has."""
    folder = _run_folder(spark)
    rows = R.bam_like(spark, sf_dir)
    long_ = F.slice(F.concat("qual", "qual"), F.lit(1), F.length("seq"))
    bam.write_bam(rows.withColumn("qual", long_).repartition(4), folder, {"chr1": 1000})
    sheet = spark.createDataFrame([("s", folder)], "sample string, bam_path string")
    return extract(spark, sheet, Config(input="bam", sequencing_technology="10x", reference=FLANKED, flanked_pattern=True, read_length=32, read_qc_threshold=20, read_qc_percentage=70))


@query(f"WITH {R.READS_N}, {R.parents()} SELECT sample, 'barcode_' || CAST(k AS VARCHAR) AS barcode, count(*) AS counts FROM reads_n r JOIN (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k FROM parents) p ON contains(r.seq, p.seq) WHERE NOT contains(r.seq, 'N') GROUP BY 1, 2")
def reference_fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents written as FASTA and read as the reference of the search."""
    folder = f"{_run_folder(spark)}/parents.fasta"
    tables.write_fasta(spark.createDataFrame([(s,) for s in R.parent_list()], "barcode string"), folder)
    names = tables.read_reference(spark, folder)
    found = counting.with_barcode(R.reads_with_n(spark, sf_dir).select("sample", "seq"), K.find_listed(F.col("seq"), list(names)))
    return counting.count_reads(counting.named(found, counting.names_table(spark, names)))


@query(f"WITH {R.READS_N}, {R.parents()} SELECT sample, p.seq AS barcode, count(*) AS counts FROM reads_n r JOIN parents p ON contains(r.seq, p.seq) WHERE NOT contains(r.seq, 'N') GROUP BY 1, 2")
def reference_txt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents written as lines of text and read as the reference of the search."""
    folder = f"{_run_folder(spark)}/parents.txt"
    spark.createDataFrame([(s,) for s in R.parent_list()], "value string").write.text(folder)
    return _extracted(R.reads_with_n(spark, sf_dir).select("sample", "seq"), finder(F.col("seq"), tables.read_reference(spark, folder), Config()))


@query(f"WITH {R.READS}, {R.parents()} SELECT sample, p.name AS barcode, count(*) AS counts FROM reads r JOIN parents p ON hamming(r.barcode_true, p.seq) <= 1 GROUP BY 1, 2")
def reference_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents and their names written as JSON and read as the reference of the search."""
    folder = f"{_run_folder(spark)}/parents.json"
    spark.createDataFrame([(json.dumps({s: f"clone_{k}" for k, s in enumerate(R.parent_list())}),)], "value string").coalesce(1).write.text(folder)
    names = tables.read_reference(spark, folder)
    found = counting.with_barcode(R.reads(spark, sf_dir).select("sample", "seq"), finder(F.col("seq"), names, Config(aln_mismatches=1)))
    return counting.count_reads(counting.named(found, counting.names_table(spark, names)))


@query(f"""WITH {R.LIBRARY}, h AS (SELECT right(core, 32) AS s FROM library_reads),
met AS (SELECT name FROM h JOIN library ON left(s, 16) = left(sequence, 16) WHERE hamming(s, sequence) <= 1
  UNION ALL SELECT name FROM h JOIN library ON right(s, 16) = right(sequence, 16) AND left(s, 16) <> left(sequence, 16) WHERE hamming(s, sequence) <= 1)
SELECT 's' AS sample, name AS barcode, count(*) AS counts FROM met GROUP BY 1, 2""")
def library_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library as Parquet and reads as FASTQ through the extraction plan, within one edit."""
    folder = _run_folder(spark)
    R.library(spark, sf_dir).write.parquet(f"{folder}/library.parquet")
    rows = R.library_reads(spark, sf_dir).select(F.concat_ws("\n", F.lit("@r"), "seq", F.lit("+"), F.regexp_replace("seq", ".", "I")).alias("value"))
    rows.write.text(f"{folder}/reads")
    sheet = spark.createDataFrame([("s", f"{folder}/reads")], "sample string, fastq_path_r1 string")
    return extract(spark, sheet, Config(reference=f"{folder}/library.parquet", aln_mismatches=1))


@query("SELECT CAST(s_suppkey AS VARCHAR) || '-2' AS cell FROM supplier")
def whitelist_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as a list with one suffix and read with another."""
    folder = _run_folder(spark)
    R.table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("-1")).alias("value")).write.text(folder)
    return tables.read_whitelist(spark, folder, "2")


@query(f"WITH {_COUNTED} SELECT sample, count(*) AS n_barcodes_by_counts, CAST(sum(counts) AS BIGINT) AS total_counts FROM counted GROUP BY 1")
def wide_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide CSV written and read again, as metrics of its samples."""
    folder = _run_folder(spark)
    tables.write_wide(_counted(spark, sf_dir), folder)
    _, obs, _ = tables.read_dna(spark, folder)
    return obs.select("sample", "n_barcodes_by_counts", "total_counts")


@query(f"""WITH {R.READS}, cells AS (SELECT cell || '_' || sample AS cell, barcode_true AS barcode, count(DISTINCT umi) AS counts FROM reads GROUP BY 1, 2)
SELECT cell, count(*) AS n_barcodes_by_counts, CAST(sum(counts) AS BIGINT) AS total_counts FROM cells GROUP BY 1""")
def wide_cells_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide CSV of cells, in blocks of columns, written and read again."""
    folder = _run_folder(spark)
    cells = _cells(spark, sf_dir).select(F.concat_ws("_", "cell", "sample").alias("cell"), "barcode", "counts")
    wide.write_wide(cells, folder, block=16, part=1 << 20)
    _, obs, _ = tables.read_sc(spark, folder)
    return obs.select("cell", "n_barcodes_by_counts", "total_counts")


@query(f"WITH {_COUNTED} SELECT sample, barcode, counts FROM counted")
def sparse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated matrix, compressed by rows, written and read again."""
    folder = _run_folder(spark)
    tables.write_annotated(_counted(spark, sf_dir), folder, "sample")
    return tables.read_annotated(spark, folder)[0].select("sample", "barcode", "counts")


# -- clones and plot tables ------------------------------------------------------------

_CLONES = R.parents() + ", clone AS (SELECT CAST(ord // 5 AS INTEGER) AS ord, 'clone_' || CAST(ord // 5 AS VARCHAR) AS clone, seq AS barcode FROM parents)"
_ASSIGNED = f"""{R.READS}, cells AS (SELECT umi AS cell, barcode_true AS barcode, count(*) AS counts FROM reads GROUP BY 1, 2), {_CLONES}, size AS (SELECT ord, clone, count(*) AS size FROM clone GROUP BY 1, 2),
known AS (SELECT DISTINCT cell, barcode FROM cells WHERE barcode IN (SELECT barcode FROM clone)), n AS (SELECT cell, count(*) AS n FROM known GROUP BY 1),
k AS (SELECT cell, ord, clone, count(*) AS k FROM known JOIN clone USING (barcode) GROUP BY 1, 2, 3),
best AS (SELECT cell, arg_min(k.clone, (-(k * 1.0 / size), k.ord)) AS clone FROM k JOIN size USING (ord) JOIN n USING (cell) WHERE n <= size AND k * 1.0 / size >= 0.2 GROUP BY 1),
obs AS (SELECT cell, coalesce(clone, 'Unassigned') AS clone FROM (SELECT DISTINCT cell FROM cells) LEFT JOIN best USING (cell))"""




def _mapping(spark: SparkSession) -> DataFrame:
    p = R.parent_list()
    return clones.mapping_table(spark, {f"clone_{i}": p[i * 5 : i * 5 + 5] for i in range(10)})


@query(f"WITH {_ASSIGNED} SELECT cell, clone FROM obs")
def assign_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.reads(spark, sf_dir).select(F.col("umi").alias("cell"), F.col("barcode_true").alias("barcode"))
    return clones.assign_clones(counting.count_reads(rows, ["cell"]), _mapping(spark), 0.2)


_LINES = "SELECT l_returnflag AS grp, l_linestatus AS key, l_extendedprice AS value FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("key"), F.col("l_extendedprice").alias("value"))


@query(f"SELECT grp, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percentage FROM ({_LINES}) GROUP BY 1")
def category_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_percent(_lines(spark, sf_dir), "grp").withColumn("percentage", F.round("percentage", 6))


@query(f"SELECT grp, key, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY grp) * 100, 6) AS percentage FROM ({_LINES}) GROUP BY 1, 2")
def crosstab_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.crosstab_percent(_lines(spark, sf_dir), "grp", "key").withColumn("percentage", F.round("percentage", 6))


@query(f"""WITH t AS ({_LINES}), q AS (SELECT grp, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM t GROUP BY 1)
SELECT t.grp, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high FROM t JOIN q ON t.grp = q.grp GROUP BY 1""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.box_stats(_lines(spark, sf_dir), "value", "grp").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(f"""WITH {_CLUSTERED} SELECT f.sample, f.barcode, c.cluster, f.counts, CAST(sum(f.counts) OVER (PARTITION BY f.sample, c.cluster) AS BIGINT) AS total_count
FROM flagship f JOIN clusters c ON f.barcode = c.barcode""")
def pcr_cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(extract_dna_long(spark, sf_dir), "counts")
    return simulate.with_totals(counts.join(collapse.cluster(counts, 2), "barcode"), ["sample", "cluster"], "counts").select("sample", "barcode", "cluster", "counts", "total_count")


@query(f"WITH {_COUNTED} SELECT sample, barcode, counts, round(100 * counts / sum(counts) OVER (PARTITION BY sample), 6) AS frequency FROM counted")
def frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.with_frequency(_counted(spark, sf_dir), ["sample"], "counts").withColumn("frequency", F.round("frequency", 6))


@query()
def simulate_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.dna_ground_truth(spark, samples=["s1", "s2"], barcodes=10, length=16, counts=simulate.Counts("random"), chimeras=2, fraction=0.1, seed=7)


@query()
def simulate_sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.sc_molecules(spark, samples=["s1"], cells=20, clones=4, length=16, umis_per_cell=5, chimeras=2, fraction=0.2, seed=7)


@query("SELECT * FROM (VALUES ('s1', 10, 30, 16, true, true), ('s2', 10, 30, 16, true, true)) AS t(sample, n_clusters, most_rows, length, summed, shared)")
def simulate_dna_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of simulated populations: clusters of a barcode and at most two mutants, their
    sums, and mutants with a tenth of the barcode's count or less."""
    rows = simulate_dna(spark, sf_dir)
    by = rows.groupBy("sample", "cluster").agg(F.sum("count").alias("s"), F.min("total_count").alias("t"), F.max("count").alias("top"), F.count("*").alias("n"), F.min(F.length("barcode")).alias("lo"), F.max(F.length("barcode")).alias("hi"))
    most = F.when(F.max("n") <= 3, F.count("*") * 3).cast("int")
    return by.groupBy("sample").agg(
        F.count("*").cast("int").alias("n_clusters"), most.alias("most_rows"), F.when(F.min("lo") == F.max("hi"), F.min("lo")).alias("length"), F.bool_and(F.col("s") == F.col("t")).alias("summed"),
        F.bool_and((F.col("s") - F.col("top")) * 10 <= F.greatest(F.col("top"), F.lit(20))).alias("shared"),
    )


@query("SELECT 's1' AS sample, 20 AS n_cells, 100 AS n_molecules, 4 AS n_clones, 20 AS n_mutated")
def simulate_sc_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of simulated cells: all cells of four clones of one barcode each, five
    molecules a cell, a fifth of them with a mutant of the clone's barcode."""
    rows = stored(simulate_sc(spark, sf_dir), "molecules")
    own = rows.groupBy("clone", "barcode").agg(F.count("*").alias("n")).groupBy("clone").agg(F.max_by("barcode", "n").alias("own"))
    return rows.join(own, "clone").groupBy("sample").agg(
        F.countDistinct("cell_bc").cast("int").alias("n_cells"), F.count("*").cast("int").alias("n_molecules"), F.countDistinct("clone").cast("int").alias("n_clones"),
        F.count_if(F.col("barcode") != F.col("own")).cast("int").alias("n_mutated"),
    )
