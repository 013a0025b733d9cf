import gzip
import json
import struct
import zlib

import pytest
import yaml

from lineagelake import cli
from lineagelake.plans.extract import Config, ValidationError, extract, validate_sheet
from lineagelake.sources import bam as bams
from lineagelake.sources import fastq, tables


def bgzf(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam(records):
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    letters = "=ACMGRSVTWYHKDBN"
    for name, ref, seq, tags in records:
        codes = [letters.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        rec = struct.pack("<iiBBHHHiiii", ref, 0, len(name) + 1, 0, 0, 0, 0, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + bytes([30] * len(seq))
        rec += b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in tags.items())
        out += struct.pack("<i", len(rec)) + rec
    return bgzf(out[:40]) + bgzf(out[40:]) + bgzf(b"")


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nTT\n+r2\n##\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r3\nGG\n+\nII\n")
    rows = fastq.read_fastq(spark, str(tmp_path)).orderBy("file", "ord").collect()
    assert [(r.ord, r.name, r.seq, r.qual) for r in rows] == [(0, "r1", "ACGT", "@III"), (1, "r2", "TT", "##"), (0, "r3", "GG", "II")]
    (tmp_path / "a.fastq").write_text("@r1\nACGT\n+\nI\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path / "a.fastq")).collect()


def test_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam([("c1__r", -1, "ACGTN", {"CB": "c1", "UB": "u"}), ("q", 0, "GG", {})]))
    all_ = bams.read_bam(spark, str(tmp_path / "x.bam")).orderBy("ord").collect()
    assert [(r.qname, r.contig, r.seq, r.tags) for r in all_] == [("c1__r", None, "ACGTN", {"CB": "c1", "UB": "u"}), ("q", "chr1", "GG", {})]
    assert all_[0].qual == [30] * 5
    assert [r.qname for r in bams.read_bam(spark, str(tmp_path / "x.bam"), "*").collect()] == ["c1__r"]
    assert [r.qname for r in bams.read_bam(spark, str(tmp_path / "x.bam"), "chr1").collect()] == ["q"]


def test_references(spark, tmp_path):
    (tmp_path / "r.txt").write_text("ACGT\nGTCGAT\n\nTGCATGCA\n")
    assert tables.read_reference(spark, str(tmp_path / "r.txt")) == ["ACGT", "GTCGAT", "TGCATGCA"]
    (tmp_path / "r.json").write_text(json.dumps({"ACGT": "one", "GT": "two"}))
    assert tables.read_reference(spark, str(tmp_path / "r.json")) == {"ACGT": "one", "GT": "two"}
    (tmp_path / "r.fasta").write_text(">one\nAC\nGT\n>two\nGT\n>three\nACGT\n")
    assert tables.read_reference(spark, str(tmp_path / "r.fasta")) == {"ACGT": "three", "GT": "two"}
    assert tables.read_reference(spark, "AC*GT") == "AC*GT"
    (tmp_path / "bad.txt").write_text("ACGTN\n")
    for bad in (str(tmp_path / "bad.txt"), str(tmp_path / "x.csv"), "ACGTBXGT", "ACGT*N", ["AC*"]):
        with pytest.raises(ValueError):
            tables.read_reference(spark, bad)
    with pytest.raises(TypeError):
        tables.read_reference(spark, 3)


def test_sheet_validation(spark):
    sheet = spark.createDataFrame([("s", "x.fastq", "1", None), ("t", "y.fastq", None, None)], "sample string, fastq_path_r1 string, replicate string, condition string")
    with pytest.raises(ValidationError, match="replicate"):
        validate_sheet(sheet, Config())
    with pytest.raises(ValidationError, match="fastq_path_r2"):
        validate_sheet(sheet.drop("replicate"), Config(paired_end=True))
    with pytest.raises(ValidationError, match="technology"):
        validate_sheet(sheet, Config(sequencing_technology="odd"))
    validate_sheet(sheet.drop("replicate"), Config())
    with pytest.raises(ValidationError):
        Config.of({"nonsense": 1})


def test_missing_files(spark):
    sheet = spark.createDataFrame([("s", "/nowhere/x.fastq")], "sample string, fastq_path_r1 string")
    with pytest.raises(ValidationError, match="nothing at"):
        extract(spark, sheet, Config(reference="ACGT*"))


def test_simulated_reads_give_the_ground_truth_back(spark, tmp_path):
    conf = {
        "general": {"output_path": str(tmp_path), "samples": ["s1"], "simulation_type": "dna", "seed": 4},
        "common": {"flank_left": "ACGTACGTAC", "flank_right": "TTGGCCAATT", "barcode_length": 12, "sequence_length": 60},
        "distribution_params": {"distribution_type": "random", "max_count": 20}, "dna": {"num_barcodes": 5},
    }
    cli.run_simulate(spark, conf)
    sheet = tmp_path / "sheet.csv"
    sheet.write_text(f"sample,condition,replicate,fastq_path_r1\ns1,,,{tmp_path}/s1_R1.fastq/part-*\n")
    config = {"sequencing_technology": "DNA", "input": "fastq", "reference": "ACGTACGTAC*TTGGCCAATT", "n_threads": 2}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    got = extract(spark, tables.read_sheet(spark, str(sheet)), Config.of(config))
    truth = spark.read.csv(f"{tmp_path}/ground_truth", header=True, inferSchema=True)
    assert {(r["sample"], r.barcode, r.counts) for r in got.collect()} == {(r["sample"], r.barcode, r["count"]) for r in truth.collect()}
    cli.run_extract(spark, {"input_csv": str(sheet), "output_path": f"{tmp_path}/out", "config": config})
    x, obs, var = tables.read_dna(spark, f"{tmp_path}/out/barcodes_output.csv")
    assert x.count() == 5 and obs.first().n_barcodes_by_counts == 5 and var.count() == 5
    x, obs, var = tables.read_annotated(spark, f"{tmp_path}/out/barcodes_output")
    assert {(r.barcode, r.counts) for r in x.collect()} == {(r.barcode, r["count"]) for r in truth.collect()} and obs.first().total_counts == x.agg({"counts": "sum"}).first()[0] and var.count() == 5


def test_read_numbers_are_observed(spark, tmp_path):
    from lineagelake.plans.extract import ReadNumbers

    for name, n in (("a", 30), ("b", 7)):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@r\n{'ACGT' if i % 3 else 'TT'}GG\n+\n{'I' if i % 5 else '#'}IIIII"[: -2 * (not i % 3) or None] + "\n" for i in range(n)))
    sheet = spark.createDataFrame([(s, f"{tmp_path}/{s}.fastq") for s in "ab"], "sample string, fastq_path_r1 string")
    for config in (Config(reference="AC*GG", read_qc_threshold=20, read_qc_percentage=100), Config(reference="AC*GG", read_qc_threshold=20, read_qc_percentage=100, distance_threshold=1)):
        numbers = ReadNumbers()
        counts = extract(spark, sheet, config, numbers).collect()
        passing = {s: [i for i in range(n) if i % 5] for s, n in (("a", 30), ("b", 7))}
        assert numbers.get() == {s: {"reads": n, "passing": len(passing[s]), "with_barcode": sum(1 for i in passing[s] if i % 3)} for s, n in (("a", 30), ("b", 7))}
        assert {(r["sample"], r.counts) for r in counts} == {(s, sum(1 for i in passing[s] if i % 3)) for s in "ab"}


def test_single_cell_reads(spark, tmp_path):
    conf = {
        "general": {"output_path": str(tmp_path), "samples": ["s1"], "simulation_type": "sc"}, "common": {"flank_left": "GGGGG", "flank_right": "TTTTT"},
        "distribution_params": {}, "sc": {"num_cells": 6, "num_clones": 2, "umis_per_cell": 3, "umi_length": 8},
    }
    cli.run_simulate(spark, conf)
    sheet = spark.createDataFrame([("s1", f"{tmp_path}/s1_R1.fastq/part-*", f"{tmp_path}/s1_R2.fastq/part-*")], "sample string, fastq_path_r1 string, fastq_path_r2 string")
    got = extract(spark, sheet, Config(sequencing_technology="10x", reference="GGGGG*", flanked_pattern=True, read_length=16, max_read_length=16)).collect()
    assert len(got) == 6 and {r.counts for r in got} == {3} and all(r.cell.endswith("-1_s1") for r in got)


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from lineagelake.functions.expressions import extract as pattern
    from lineagelake.streaming.counts import streaming_counts

    rows = [("s", "c", "u1", "AATTGG"), ("s", "c", "u1", "AATTGG"), ("s", "c", "u2", "AATTGG")]
    spark.createDataFrame(rows, "sample string, cell string, umi string, seq string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sample string, cell string, umi string, seq string").parquet(f"{tmp_path}/in")
    q = streaming_counts(stream, pattern(F.col("seq"), "AA*GG"), umi=True).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.barcode, r.counts) for r in spark.table("counts").collect()] == [("TT", 2)]


def test_wide_matrix_in_blocks_and_parts(spark, tmp_path):
    from lineagelake.sources.wide import read_wide, write_wide

    rows = [(s, r, f"B{k:03}", k + 1) for s, r, step in (("a", "1", 1), ('b, "c"', None, 7), ("d", "2", 90), ("e", "2", 1)) for k in range(0, 100, step)]
    df = spark.createDataFrame(rows, "sample string, replicate string, barcode string, counts long")
    held = {(s, b): c for s, _, b, c in rows}
    for block, part in ((7, 1), (100, 650), (1000, 1 << 20)):
        write_wide(df, f"{tmp_path}/wide", block, part)
        got = spark.read.csv(f"{tmp_path}/wide", header=True, escape='"')
        assert got.columns == ["sample", "replicate", *[f"B{k:03}" for k in range(100)]]
        assert {(r["sample"], b): int(r[b]) for r in got.collect() for b in got.columns[2:]} == {(s, f"B{k:03}"): held.get((s, f"B{k:03}"), 0) for s in {s for s, _ in held} for k in range(100)}
    lines, cells = read_wide(spark, f"{tmp_path}/wide")
    back = cells.join(lines, "line").collect()
    assert {(r["sample"], r.replicate or None, r.barcode, r.counts) for r in back if r.counts} == set(rows) and len(back) == 400
    x, obs, var = tables.read_dna(spark, f"{tmp_path}/wide")
    assert x.count() == 400 and {(r["sample"], r.n_barcodes_by_counts) for r in obs.collect()} == {("a", 100), ('b, "c"', 15), ("d", 2), ("e", 100)}
    assert {r.barcode: (r.n_cells_by_counts, r.mean_counts) for r in var.collect()}["B000"] == (4, 1.0)
    write_wide(df.limit(0), f"{tmp_path}/empty")
    assert spark.read.csv(f"{tmp_path}/empty", header=True).columns == ["sample", "replicate"]
    assert read_wide(spark, f"{tmp_path}/empty")[0].count() == 0


def test_a_wide_file_of_another_writer(spark, tmp_path):
    (tmp_path / "w.csv").write_text("cell,sample,B1,B2\nc1,s,0,2.0\nc1,t,3,0\n")
    x, obs, _ = tables.read_sc(spark, str(tmp_path / "w.csv"))
    assert sorted((r.cell, r["sample"], r.barcode, r.counts) for r in x.collect()) == [("c1", "s", "B1", 0), ("c1", "s", "B2", 2), ("c1-1", "t", "B1", 3), ("c1-1", "t", "B2", 0)]
    assert obs.count() == 2
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="none of the columns"):
        tables.read_sc(spark, str(tmp_path / "bad.csv"))


def test_hundred_thousand_barcodes(spark, tmp_path):
    df = spark.range(100_000).selectExpr("concat('s', id % 3) AS sample", "concat('B', id) AS barcode", "id + 1 AS counts")
    tables.write_wide(df, f"{tmp_path}/wide")
    x, obs, _ = tables.read_dna(spark, f"{tmp_path}/wide")
    assert {(r["sample"], r.n_barcodes_by_counts, r.total_counts) for r in obs.collect()} == {(f"s{k}", len(range(k, 100_000, 3)), sum(range(k + 1, 100_001, 3))) for k in range(3)}
    assert x.where("counts > 0").count() == 100_000


def test_numbers_of_rows(spark):
    from lineagelake.functions.storage import numbered

    df = spark.createDataFrame([(i % 3, "x") for i in range(300)], "k int, n2 string").repartition(5)
    got = numbered(df, ["k"]).collect()
    assert sorted(r.n for r in got) == list(range(300)) and [r.k for r in sorted(got, key=lambda r: r.n)] == sorted(i % 3 for i in range(300))
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_samples_keep_their_own_cells(spark, tmp_path):
    df = spark.createDataFrame([("s_1", "c_1_s_1", "A", 2), ("t", "c_t", "A", 1)], "sample string, cell string, barcode string, counts long")
    tables.write_samples(df, f"{tmp_path}/samples")
    assert {(r["sample"], r.cell) for r in spark.read.csv(f"{tmp_path}/samples", header=True).collect()} == {("s_1", "c_1"), ("t", "c")}
