import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake.operators import abundance, clones, counting, matrix, simulate, stats
from lineagelake.plans import catalog


def test_abundance(spark):
    df = spark.createDataFrame([("s", "A", 98), ("s", "C", 2), ("t", "A", 1)], "sample string, barcode string, counts long")
    assert abundance.filter_abundance(df, raw=2, relative=99).count() == 2
    assert {(r["sample"], r.barcode) for r in abundance.filter_abundance(df, relative=3).collect()} == {("s", "A"), ("t", "A")}
    rep = df.withColumn("replicate", F.lit("1"))
    assert abundance.filter_abundance(rep, relative=2.5, within="replicate").count() == 2
    assert abundance.filter_abundance(df).count() == 3


def test_counting(spark):
    df = spark.createDataFrame([("s", "c", "A", "u"), ("s", "c", "A", "u"), ("s", "c", "A", None)], "sample string, cell string, barcode string, umi string")
    assert counting.count_umis(df).first().counts == 1
    assert counting.count_reads(df).first().counts == 3
    sheet = spark.createDataFrame([("s", " ", "x")], "sample string, replicate string, condition string")
    out = counting.without_empty_columns(counting.with_metadata(counting.count_reads(df), sheet))
    assert out.columns == ["sample", "barcode", "counts", "condition"]


def test_matrix_round_trip(spark):
    df = spark.createDataFrame([("s", "A", 3), ("t", "C", 2)], "sample string, barcode string, counts long")
    wide = matrix.wide(df)
    assert [tuple(r) for r in wide.collect()] == [("s", 3, 0), ("t", 0, 2)]
    assert {tuple(r) for r in matrix.long(wide).where("counts > 0").collect()} == {tuple(r) for r in df.collect()}
    var = {r.barcode: r for r in matrix.qc_var(df).collect()}
    assert var["A"].mean_counts == 1.5 and var["A"].pct_dropout_by_counts == 50
    names = matrix.unique_names(spark.createDataFrame([("x",), ("x",)], "cell string"), "cell")
    assert {r.cell for r in names.collect()} == {"x", "x-1"}


def test_matrix_queries_hold_every_barcode(spark):
    path = "/root/testdata/sf0.001"
    want = {(r["sample"], r.barcode): r.counts for r in catalog.QUERIES["frequency"](spark, path).collect()}
    samples, barcodes = {s for s, _ in want}, {b for _, b in want}
    wide = catalog.QUERIES["pivot_counts"](spark, path).collect()
    assert len(barcodes) > 50
    assert {(r["sample"], b): r[b] for r in wide for b in r.asDict() if b != "sample"} == {(s, b): want.get((s, b), 0) for s in samples for b in barcodes}
    grid = catalog.QUERIES["long_complete_grid"](spark, path).collect()
    assert len(grid) == len(samples) * len(barcodes)
    assert {(r["sample"], r.barcode): r.counts for r in grid} == {(s, b): want.get((s, b), 0) for s in samples for b in barcodes}


def test_clones(spark):
    counts = spark.createDataFrame([("1", "A", 1), ("1", "C", 1), ("2", "A", 1), ("3", "Z", 1), ("4", "A", 0)], "cell string, barcode string, counts long")
    table = clones.mapping_table(spark, {"one": ["A", "C"], "two": "A", "three": ["A"]})
    got = {r.cell: r.clone for r in clones.assign_clones(counts, table).collect()}
    assert got == {"1": "one", "2": "two", "3": "Unassigned", "4": "Unassigned"}
    with pytest.raises(TypeError):
        clones.mapping_table(spark, {"one": 3})


def test_stats(spark):
    obs = spark.createDataFrame([("a", "x", float(i)) for i in range(1, 10)] + [("b", "y", 100.0)], "g string, k string, v double")
    assert [r.percentage for r in stats.category_percent(obs, "g").collect()] == [90, 10]
    assert [r.g for r in stats.category_percent(obs, "g", ["b", "a"]).collect()] == ["b", "a"]
    cross = {(r.g, r.k): r.percentage for r in stats.crosstab_percent(obs, "g", "k").collect()}
    assert cross == {("a", "x"): 100, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 100}
    box = {r.g: r for r in stats.box_stats(obs, "v", "g").collect()}
    assert (box["a"].q1, box["a"].median, box["a"].q3, box["a"].whisker_high) == (3, 5, 7, 9)
    with pytest.raises(ValueError):
        stats.box_stats(obs, "nope", "g")


@pytest.mark.parametrize("kind", ["uniform", "random", "normal", "powerlaw"])
def test_simulated_counts(spark, kind):
    out = simulate.dna_ground_truth(spark, ["s"], 8, 12, simulate.Counts(kind), seed=3).collect()
    assert len({r.barcode for r in out}) == 8 and all(len(r.barcode) == 12 and r["count"] >= 1 for r in out)
    assert abs(sum(r.frequency for r in out) - 100) < 1e-9


def test_simulated_errors(spark):
    base = spark.createDataFrame([("s", 0, "AAAAAA", 100), ("s", 1, "CCCCCC", 200)], "sample string, i long, barcode string, count long")
    out = simulate.with_pcr_errors(base, 2, 0.5).collect()
    assert len(out) == 6 and {r.cluster for r in out} == {"cluster_1", "cluster_2"}
    assert {r.total_count for r in out} == {150, 300}
    assert all(sum(a != b for a, b in zip(r.barcode, "AAAAAA" if r.cluster == "cluster_1" else "CCCCCC", strict=True)) in (0, 2) for r in out)
    assert simulate.with_pcr_errors(base, 2, 0).columns == base.columns


def test_distance_of_simulated_barcodes(spark):
    seqs = [r.seq for r in simulate.unique_sequences(spark, 12, 8, 5, 3).collect()]
    assert len(seqs) == 12 and min(sum(x != y for x, y in zip(a, b, strict=True)) for a in seqs for b in seqs if a != b) >= 3
    with pytest.raises(ValueError):
        simulate.unique_sequences(spark, 5, 1, 0)
    with pytest.raises(ValueError):
        simulate.Counts("odd").column(1, "x")


def test_simulated_cells(spark):
    out = simulate.sc_molecules(spark, ["s"], 12, 3, umis_per_cell=4, chimeras=2, fraction=0.5, seed=1).collect()
    assert len(out) == 48 and len({r.cell_bc for r in out}) == 12 and {r.clone for r in out} == {"clone_1", "clone_2", "clone_3"}
    assert len({r.barcode for r in out}) > 3
    pair = simulate.sc_reads(spark.createDataFrame(out), 100, "GGG", "TTT").first()
    assert len(pair.read_2) == 100 and pair.read_2.startswith("GGG")


def test_power_law_counts_follow_zipf(spark):
    law = simulate.Counts("powerlaw", a=2.0)
    got = [r.c for r in spark.range(20_000).select(law.column(3, "id").alias("c")).collect()]
    for k in (1, 2, 3, 5):
        assert abs(sum(c == k for c in got) / len(got) - 6 / 3.141592653589793**2 / k**2) < 0.012


def test_box_of_many_ties(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(g, h, float(rng.integers(0, 9)) if g == "a" else float(rng.normal())) for g in "ab" for h in "xy" for _ in range(157)] + [("a", "x", None), (None, "x", 1.0)]
    got = {(r.g, r.h): r for r in stats.box_stats(spark.createDataFrame(rows, "g string, h string, v double"), "v", "g", "h").collect()}
    assert len(got) == 4
    for (g, h), r in got.items():
        v = np.array([x for a, b, x in rows if (a, b) == (g, h) and x is not None])
        q = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q[0] - 1.5 * (q[2] - q[0])) & (v <= q[2] + 1.5 * (q[2] - q[0]))]
        assert r.n == len(v) and np.allclose([r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [*q, inside.min(), inside.max()])


@pytest.mark.parametrize("by_column", [False, True])
def test_compressed_matrix_equals_scipy_layout(spark, by_column):
    rng = random.Random(3)
    rows = [(f"s{i:02}", f"B{k:02}", rng.randrange(0, 4)) for i in range(23) for k in rng.sample(range(40), rng.choice((0, 1, 9, 30)))] + [("zero", "B00", 0), ("s99", "B07", 5), ("s99", "B07", 2)]
    df = spark.createDataFrame(rows, "sample string, barcode string, counts long").repartition(3)
    for block in (1, 7, 10_000):
        x = matrix.compressed(df, by_column, block)
        obs, var = (list(r) for r in ([r[0] for r in x["obs"].orderBy("row").select("sample").collect()], [r[0] for r in x["var"].orderBy("col").select("barcode").collect()]))
        dense = np.zeros((len(obs), len(var)), int)
        for s, b, c in rows:
            dense[obs.index(s), var.index(b)] += c
        lines = dense.T if by_column else dense
        assert obs == sorted({r[0] for r in rows}) and var == sorted({r[1] for r in rows})
        blocks = x["blocks"].orderBy("block").collect()
        assert [k for r in blocks for k in r.indices] == np.nonzero(lines)[1].tolist() and [v for r in blocks for v in r.data] == lines[np.nonzero(lines)].tolist()
        assert all(len(r.data) == block for r in blocks[:-1])
        assert [r.start for r in x["indptr"].orderBy("line").collect()] == [0, *(lines != 0).sum(1).cumsum().tolist()]
        back = {(r["sample"], r.barcode): r.counts for r in matrix.expanded(x, by_column, block).collect()}
        assert back == {(obs[i], var[k]): dense[i, k] for i, k in zip(*np.nonzero(dense), strict=True)}
    empty = matrix.compressed(df.limit(0), by_column)
    assert [r.start for r in empty["indptr"].collect()] == [0] and matrix.expanded(empty, by_column).count() == 0
