"""Exact dedup by a cuckoo-filter index: digests of texts are inserted into and deleted from
filters, one for each shard of the digests; what a filter reports is verified in its bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, scratch, stored, texts_of

#: Slots of a bucket, moves before an insertion counts as an overflow, buckets of a new filter,
#: and rows for each shard of a new index.
SLOTS, KICKS, BUCKETS, SHARD_ROWS = 4, 500, 1024, 250_000
#: Digests that a task combines before it passes them on.
_HELD = 50_000


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each digest has two buckets, and either can
    be had from the other and the fingerprint, so that fingerprints move and can be deleted."""

    def __init__(self, buckets: int = BUCKETS, table: bytes | None = None):
        self.buckets = buckets
        self.table = np.frombuffer(table, "<u2").tolist() if table else [0] * (buckets * SLOTS)
        self.turn = 0

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and the two buckets."""
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & (self.buckets - 1)
        return mark, first, self.other(mark, first)

    def other(self, mark: int, bucket: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) >> 4 & (self.buckets - 1))

    def holds(self, mark: int, first: int, second: int) -> bool:
        t = self.table
        return mark in t[first * SLOTS : first * SLOTS + SLOTS] or mark in t[second * SLOTS : second * SLOTS + SLOTS]

    def put(self, mark: int, bucket: int) -> bool:
        """False on overflow; the table then lacks one fingerprint and must be made anew."""
        t = self.table
        for _ in range(KICKS):
            for b in (bucket, self.other(mark, bucket)):
                own = t[b * SLOTS : b * SLOTS + SLOTS]
                if 0 in own:
                    t[b * SLOTS + own.index(0)] = mark
                    return True
            self.turn = (self.turn * 5 + 3) & 0xFFFF  # which one moves on
            at = b * SLOTS + (self.turn >> 3) % SLOTS
            mark, t[at] = t[at], mark
            bucket = self.other(mark, b)
        return False

    def remove(self, mark: int, first: int, second: int) -> None:
        for b in (first, second):
            own = self.table[b * SLOTS : b * SLOTS + SLOTS]
            if mark in own:
                self.table[b * SLOTS + own.index(mark)] = 0
                return

    def packed(self) -> bytes:
        return np.array(self.table, "<u2").tobytes()


class Shard:
    """One shard of the index: the filter, and by bucket the stored keys with what is known of
    them: byte length, the largest doc_id and the number of rows."""

    def __init__(self, number: int):
        self.number, self.filter = number, CuckooFilter()
        self.keys: dict[int, list[list]] = {}

    def restore(self, buckets: int, table: bytes) -> None:
        self.filter = CuckooFilter(buckets, table)

    def keep(self, digest: bytes, length: int, keep_id: int | None, copies: int) -> None:
        """A stored key, whose fingerprint is in the filter already."""
        _, a, b = self.filter.places(digest)
        self.keys.setdefault(min(a, b), []).append([digest, length, keep_id, copies])

    def find(self, digest: bytes, length: int) -> list | None:
        """The live key that equals (digest, length): asked of the filter first, and only what
        it reports is looked up in its bucket."""
        mark, a, b = self.filter.places(digest)
        if self.filter.holds(mark, a, b):
            for key in self.keys.get(min(a, b), ()):
                if key[0] == digest and key[1] == length:
                    return key
        return None

    def insert(self, digest: bytes, length: int, keep_id: int | None, copies: int) -> None:
        key = self.find(digest, length)
        if key is not None:
            if keep_id is not None and (key[2] is None or keep_id > key[2]):
                key[2] = keep_id
            key[3] += copies
            return
        mark, a, _ = self.filter.places(digest)
        fits = self.filter.put(mark, a)
        self.keep(digest, length, keep_id, copies)
        if not fits:
            self.resize()

    def delete(self, digest: bytes, length: int) -> bool:
        """Take a digest out of filter and bucket; False if it was not live."""
        key = self.find(digest, length)
        if key is None:
            return False
        mark, a, b = self.filter.places(digest)
        self.filter.remove(mark, a, b)
        own = self.keys[min(a, b)]
        own[:] = [k for k in own if k is not key]
        return True

    def resize(self) -> None:
        """A filter of twice the buckets, or more, made from the stored keys."""
        keys, buckets = [k for own in self.keys.values() for k in own], self.filter.buckets
        while True:
            buckets *= 2
            self.filter, self.keys = CuckooFilter(buckets), {}
            if all(self.filter.put(*self.filter.places(k[0])[:2]) for k in keys):
                break
        for k in keys:
            self.keep(*k)


_STATE = "shard int, kind int, digest binary, length long, keep_id long, copies long, buckets int"
_STATE_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary()), ("length", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64()), ("buckets", pa.int32())])
#: Rows of the state: the filter (its table in ``digest``), its stored keys, and what arrives.
FILTER, KEY, ARRIVAL = 0, 1, 2


def _shards(batches: Iterator[pa.RecordBatch], at_arrival: Callable[[Shard, list], None]) -> Iterator[Shard]:
    """Shards one after the other, from rows sorted by (shard, kind)."""
    now: Shard | None = None
    for batch in batches_of(batches, 5000):
        for number, kind, digest, length, keep_id, copies, buckets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.number != number:
                if now is not None:
                    yield now
                now = Shard(number)
            if kind == FILTER:
                now.restore(buckets, digest)
            elif kind == KEY:
                now.keep(digest, length, keep_id, copies)
            else:
                at_arrival(now, [digest, length, keep_id, copies])
    if now is not None:
        yield now


def _rows_of(shard: Shard) -> Iterator[pa.RecordBatch]:
    def rows(kind: int, columns: list[list], buckets: int | None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip([[shard.number] * n, [kind] * n, *columns, [buckets] * n], _STATE_ARROW, strict=True)], schema=_STATE_ARROW
        )

    yield rows(FILTER, [[shard.filter.packed()], [None], [None], [None]], shard.filter.buckets)
    keys = [k for own in shard.keys.values() for k in own]
    for i in range(0, len(keys), 20_000):
        yield rows(KEY, [list(x) for x in zip(*keys[i : i + 20_000], strict=True)], None)


def _inserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches, lambda s, row: s.insert(*row)):
        yield from _rows_of(shard)


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches, lambda s, row: s.delete(*row[:2])):
        yield from _rows_of(shard)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The live keys among what arrives."""
    hits: list[list] = []

    def ask(shard: Shard, row: list) -> None:
        key = shard.find(*row[:2])
        if key is not None:
            hits.append([shard.number, KEY, *key, None])

    for _ in _shards(batches, ask):
        if hits:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*hits, strict=True), _STATE_ARROW, strict=True)], schema=_STATE_ARROW)
            hits.clear()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of a task as one row: byte length, largest doc_id, number of rows."""
    held: dict[tuple[bytes, int], list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held], pa.binary()), pa.array([k[1] for k in held], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
            names=["digest", "length", "keep_id", "copies"],
        )

    for batch in batches:
        for doc_id, digest, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = held.setdefault((digest, length), [doc_id, 0])
            v[1] += 1
            if doc_id is not None and (v[0] is None or doc_id > v[0]):
                v[0] = doc_id
        if len(held) >= _HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(batches, 200):
        texts = [t.lower() for t in b.column(1).to_pylist()]  # of bytes: A-Z only
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "digest", "length"]
        )


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, length)`` of every row: SHA-256 and bytes of the whole text, null as
    empty, A-Z lower-cased."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts_of(rows).mapInArrow(_digests, "doc_id long, digest binary, length long")


class CuckooIndex:
    """A stored index of live texts, by digest, over ``shards`` cuckoo filters.

    ``path`` lies in a store that driver and executors share.  Each change reads the last
    version and writes the next, so a failed or repeated task leaves no half of it.  Rows of
    a shard are dealt to one task, which goes through its shards one at a time: about
    ``SHARD_ROWS`` keys each if ``shards`` was chosen so.  Equal digests are combined in the
    tasks that read them, so a text with a third of all rows is one row for each such task.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int):
        self.spark, self.path, self.shards, self.version = spark, path, shards, 0

    def state(self) -> DataFrame:
        """Filters (kind 0) and stored keys (kind 1) of the last version."""
        if not self.version:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/version={self.version}")

    def keys(self) -> DataFrame:
        """``(digest, length, keep_id, copies)`` of every live text."""
        return self.state().where(F.col("kind") == KEY).select("digest", "length", "keep_id", "copies")

    def _met(self, digested: DataFrame) -> DataFrame:
        arrivals = digested.select("doc_id", "digest", "length").mapInArrow(_combined, "digest binary, length long, keep_id long, copies long")
        # Eight bytes that neither fingerprint nor bucket is taken from.
        shard = F.pmod(F.conv(F.hex(F.substring("digest", 17, 7)), 16, 10).cast("long"), F.lit(self.shards)).cast("int")
        arrivals = arrivals.select(shard.alias("shard"), F.lit(ARRIVAL).alias("kind"), "digest", "length", "keep_id", "copies", F.lit(None).cast("int").alias("buckets"))
        rows = self.state().union(arrivals) if self.version else arrivals
        return rows.repartition("shard").sortWithinPartitions("shard", "kind")

    def _change(self, digested: DataFrame, how: Callable) -> None:
        self._met(digested).mapInArrow(how, _STATE).write.parquet(f"{self.path}/version={self.version + 1}")
        self.version += 1

    def insert(self, digested: DataFrame) -> None:
        """Make the texts of ``digests(docs)`` live; of a text that is live already, the
        largest doc_id and the number of rows follow."""
        self._change(digested, _inserted)

    def delete(self, digested: DataFrame) -> None:
        """Withdraw texts: they are live no more, however many rows had them, and a later
        insertion finds them new.  Texts that are not live change nothing."""
        self._change(digested, _deleted)

    def lookup(self, digested: DataFrame) -> DataFrame:
        """``(digest, length, keep_id, copies)`` of the live texts among those given; one that
        several tasks ask for is returned once."""
        return self._met(digested).mapInArrow(_found, _STATE).select("digest", "length", "keep_id", "copies").distinct()


def exact_duplicates(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Groups of rows with equal text (A-Z lower-cased, null as empty); the largest doc_id stays.

    Returns per row ``doc_id, keep_id, group_size`` (rows of the group), ``kept`` (doc_id =
    keep_id) and ``text_sha256``.  Equal means equal SHA-256 and byte length.

    The digests of all rows are inserted into a new ``CuckooIndex``, whose number of shards
    follows the number of rows; its keys then meet the rows by digest, an equi-join that
    Spark splits where one text has many rows.  Texts are read once and never shuffled.

    Rows without doc_id count and stay only if no row of their group has one; rows that
    repeat the kept doc_id all stay.  An empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs), "digests")
    index = CuckooIndex(spark, scratch(spark, "cuckoo-index"), max(16, -(-rows.count() // shard_rows)))
    index.insert(rows)
    out = rows.join(index.keys(), ["digest", "length"])
    return out.select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
