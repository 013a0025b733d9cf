"""The library's functions for SQL text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lineagelake.functions import kernels as K
from lineagelake.sources.bam import BamSource
from lineagelake.sources.fastq import FastqSource

#: Functions that SQL itself can express.
_SQL = {
    "hamming_distance(a STRING, b STRING) RETURNS INT": "aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> IF(x <=> y, 0, 1)), 0, (s, x) -> s + x)",
    "qc_fraction(qual STRING, threshold INT, shift INT) RETURNS DOUBLE": "size(filter(split(qual, ''), c -> ascii(c) >= threshold + shift)) / nullif(length(qual), 0)",
    "kmers(seq STRING, n INT) RETURNS ARRAY<STRING>": "IF(length(seq) >= n, array_distinct(transform(sequence(1, greatest(1, length(seq) - n + 1)), i -> substring(seq, i, n))), array())",
}


def infix_edit_distance(pattern: pa.Array, seq: pa.Array) -> pa.Array:
    """Least edit distance of a pattern to any part of a read."""
    out = []
    for p, s in zip(pattern.to_pylist(), seq.to_pylist(), strict=True):
        out.append(None if p is None or s is None else len(p) if not s else 0 if not p else int(K.infix_distance(p, np.frombuffer(s.encode("ascii", "replace"), np.uint8)[None])[0]))
    return pa.array(out, pa.int32())


def trim_adapter(seq: pa.Array, left: pa.Array, right: pa.Array, max_errors: pa.Array) -> pa.Array:
    """What stands between two flanks that may hold errors; an empty flank is none."""
    rows = list(zip(left.to_pylist(), right.to_pylist(), max_errors.to_pylist(), strict=True))
    reads, out = seq.to_pylist(), [None] * len(rows)
    for kind in set(rows):
        at = [i for i, r in enumerate(rows) if r == kind]
        for i, x in zip(at, K.cut_adapters([reads[i] for i in at], kind[0] or "", kind[1] or "", kind[2] or 0), strict=True):
            out[i] = x
    return pa.array(out, pa.string())


def find_reference(seq: pa.Array, references: pa.Array, most: pa.Array) -> pa.Array:
    """The listed sequence nearest to a part of the read, within ``most`` edits."""
    rows = [(tuple(r or ()), m) for r, m in zip(references.to_pylist(), most.to_pylist(), strict=True)]
    reads, out = seq.to_pylist(), [None] * len(rows)
    for kind in set(rows):
        at = [i for i, r in enumerate(rows) if r == kind]
        for i, x in zip(at, K.nearest_listed([reads[i] for i in at], list(kind[0]), kind[1] or 0), strict=True):
            out[i] = x
    return pa.array(out, pa.string())


def register(spark: SparkSession) -> None:
    """``hamming_distance, qc_fraction, kmers, infix_edit_distance, trim_adapter,
    find_reference`` as SQL functions, ``fastq`` and ``bam`` as formats of the session."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for f, kind in ((infix_edit_distance, "int"), (trim_adapter, "string"), (find_reference, "string")):
        spark.udf.register(f.__name__, F.arrow_udf(f, kind))
    for source in (FastqSource, BamSource):
        spark.dataSource.register(source)
