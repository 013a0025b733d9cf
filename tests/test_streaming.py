"""Files that arrive while a query runs, and after it was started again."""

import gzip

import pytest
from pyspark.sql import functions as F

from lineagelake.functions import expressions as X
from lineagelake.operators import counting
from lineagelake.sources import bgzf
from lineagelake.streaming.arrivals import stream_fastq, streaming_molecules


@pytest.fixture
def rocks(spark):
    """The state store that the counts need, and no batches without data."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def text(reads):
    return "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(reads)).encode()


def run(df, path, mode="append"):
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    q = q.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_files_are_read_once_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    first = [f"ACGT{'ACGT'[i % 4] * (i % 7)}" for i in range(200)]
    (tmp_path / "in/a.fastq").write_bytes(text(first))
    run(stream_fastq(spark, f"{tmp_path}/in", size=500), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.seq for r in got.collect()) == sorted(first) and got.where("arrived is null or length(seq) <> length(qual)").count() == 0
    (tmp_path / "in/b.fastq.gz").write_bytes(bgzf.blocks_of(text(["GG"] * 5)) + bgzf.blocks_of(text(["CC"])) + bgzf.END)
    (tmp_path / "in/c.fastq.gz").write_bytes(gzip.compress(text(["TT"] * 3)))
    run(stream_fastq(spark, f"{tmp_path}/in", size=500), tmp_path)  # from the checkpoint
    got = spark.read.parquet(f"{tmp_path}/out").groupBy(F.regexp_extract("file", "[^/]*$", 0).alias("f")).count().collect()
    assert {r.f: r["count"] for r in got} == {"a.fastq": 200, "b.fastq.gz": 6, "c.fastq.gz": 3}


def test_molecules_count_once_over_restarts(rocks, tmp_path):
    spark = rocks
    (tmp_path / "in").mkdir()

    def counts():
        read = stream_fastq(spark, f"{tmp_path}/in").select(F.lit("s").alias("sample"), "seq")
        found = counting.with_barcode(read, X.extract(F.col("seq"), "GGG*TTT")).select("sample", F.substring("seq", 1, 2).alias("cell"), "barcode", F.substring("seq", 3, 2).alias("umi"))
        run(streaming_molecules(found), tmp_path, "update")
        rows = spark.read.parquet(f"{tmp_path}/out").groupBy("sample", "cell", "barcode").agg(F.max("counts").alias("n")).collect()
        return {(r.cell, r.barcode): r.n for r in rows}

    read = lambda cell, umi, barcode: f"{cell}{umi}GGG{barcode}TTT"
    (tmp_path / "in/a.fastq").write_bytes(text([read("AA", "AC", "CACA"), read("AA", "AC", "CACA"), read("AA", "AT", "CACA"), read("CC", "AC", "CACA"), "ACGT"]))
    assert counts() == {("AA", "CACA"): 2, ("CC", "CACA"): 1}
    (tmp_path / "in/b.fastq").write_bytes(text([read("AA", "AC", "CACA"), read("AA", "TA", "CACA"), read("CC", "AC", "ACAC")]))
    assert counts() == {("AA", "CACA"): 3, ("CC", "CACA"): 1, ("CC", "ACAC"): 1}
