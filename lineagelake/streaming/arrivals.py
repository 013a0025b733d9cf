"""FASTQ files that keep arriving, and molecules counted as they do."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lineagelake.functions.storage import ship
from lineagelake.sources import fastq
from lineagelake.sources.stores import RANGE, Range

_RECORDS = "file string, arrived timestamp, part int, idx long, name string, seq string, qual string"


def stream_fastq(spark: SparkSession, path: str, files_a_batch: int = 1000, size: int = RANGE) -> DataFrame:
    """``(file, arrived, name, seq, qual)`` of the records of FASTQ files, plain or gzip, as they
    arrive in the folder ``path``.

    Spark's file source finds the files and keeps in the query's checkpoint which it has handed
    out, so that a restart reads each file once; their content is not read there.  Files are
    cut into ranges of bytes, which tasks read as ``fastq.read_fastq`` does.  Files have to
    arrive whole (moved into the folder), at a path that tasks can open.
    """
    ship(spark)
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = source.option("maxFilesPerTrigger", files_a_batch).load(path).select("path", "length", "modificationTime")
    begins = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("part", "begin")
    ranges = found.select("path", "length", "modificationTime", begins).repartition("path", "part")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, arrived, part, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, n = Range(0, path, length, part, begin, min(begin + size, length)), 0
                for heads, seqs, _, quals in fastq.records(at):
                    k = len(heads)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * k), pa.array([arrived] * k, pa.timestamp("us", "UTC")), pa.array([part] * k, pa.int32()), pa.array(range(n, n + k), pa.int64()),
                            fastq.text([(h[1:].split(None, 1) or [b""])[0] for h in heads]), fastq.text(seqs), fastq.text(quals),
                        ],
                        names=["file", "arrived", "part", "idx", "name", "seq", "qual"],
                    )
                    n += k

    return ranges.select("path", "length", "modificationTime", "part", "begin").mapInArrow(records, _RECORDS).drop("part", "idx")


class Molecules(StatefulProcessor):
    """Distinct UMIs by barcode of one (sample, cell).  A UMI is known for ``ttl`` milliseconds
    after it was last seen, the counts for as long as the query lives."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "barcode string, umi string", "known boolean", self.ttl)
        self.counts = handle.getMapState("counts", "barcode string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:  # noqa: N802, N803
        changed: dict[str, int] = {}
        for batch in rows:
            for barcode, umi in zip(batch["barcode"], batch["umi"], strict=True):
                if not self.seen.containsKey((barcode, umi)):
                    if barcode not in changed:
                        changed[barcode] = self.counts.getValue((barcode,))[0] if self.counts.containsKey((barcode,)) else 0
                    changed[barcode] += 1
                self.seen.updateValue((barcode, umi), (True,))
        for barcode, n in changed.items():
            self.counts.updateValue((barcode,), (n,))
        if changed:
            yield pd.DataFrame({"sample": key[0], "cell": key[1], "barcode": list(changed), "counts": list(changed.values())})

    def close(self) -> None:
        pass


def streaming_molecules(found: DataFrame, ttl: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Running counts ``(sample, cell, barcode, counts)`` of distinct UMIs of a streaming frame
    ``(sample, cell, barcode, umi)``: a row each time a count has grown (output mode update).
    Repeats of a UMI count once as long as it is known, ``ttl`` milliseconds after it was last
    seen, None for ever; so the state holds the UMIs of that time only.  Rows with a null are
    left out.  The session needs Spark's RocksDB state store; as times are those of processing,
    Spark also runs batches without data unless it is told not to
    (``spark.sql.streaming.noDataMicroBatches.enabled``)."""
    keyed = found.dropna(subset=["sample", "cell", "barcode", "umi"]).select("sample", "cell", "barcode", "umi").groupBy("sample", "cell")
    return keyed.transformWithStateInPandas(Molecules(ttl), "sample string, cell string, barcode string, counts long", "Update", "ProcessingTime")
