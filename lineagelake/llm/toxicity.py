"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive
Bayes log-count ratios (NB-weighted logistic regression, Wang and Manning, 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored, texts_of

#: Lengths of the character n-grams, and the bits of a bucket number.
SIZES, BITS = (4, 5, 6), 20


def _buckets(text: str | None) -> np.ndarray:
    """Bucket numbers of all n-grams of a whole text (lower case, white space runs as one
    space, a space at both ends), with repeats."""
    x = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    h = x * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n in SIZES:
            out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    """Weight of every chosen bucket (ratio times coefficient) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A column function from text to the probability of label 1; null or empty texts
        get the intercept's."""
        at, weights, bias = self.buckets, self.weights, self.bias
        table: list[np.ndarray] = []

        @F.arrow_udf("double")
        def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if not table:
                table.append(np.full(1 << BITS, -1, np.int32))
                table[0][at] = np.arange(len(at))
            for s in texts:
                out = np.empty(len(s))
                for i, t in enumerate(s):
                    k = table[0][_buckets(t.as_py())]
                    out[i] = bias + weights[np.unique(k[k >= 0])].sum()
                yield pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))

        return score


#: Entries of the sample's matrix that one step of the fit looks at together.
CHUNK = 400_000


def _fit(cols: np.ndarray, lengths: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression over presence times ratio, by L-BFGS on the whole (bounded) sample:
    ``cols`` holds the features of one row after the other.  Besides it, only the entries of
    a chunk of rows are in memory at a time."""
    n, ends = len(y), np.cumsum(lengths)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(CHUNK, ends[-1] + CHUNK, CHUNK)), n))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        u, value, grad, i = w[:-1] * ratio, 0.0, np.zeros_like(w), 0
        for j in cuts[cuts > 0]:
            own, first = lengths[i:j], ends[i] - lengths[i]
            part, some = cols[first : ends[j - 1]], own > 0
            z = np.full(j - i, w[-1])
            if len(part):
                z[some] += np.add.reduceat(u[part], (ends[i:j] - own)[some] - first)
            value += (np.logaddexp(0, z) - y[i:j] * z).sum()
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i:j]
            grad[:-1] += np.bincount(part, np.repeat(g, own), len(ratio))
            grad[-1] += g.sum()
            i = j
        grad[:-1] = grad[:-1] * ratio / n + l2 * w[:-1]
        grad[-1] /= n
        return value / n + l2 / 2 * float(w[:-1] @ w[:-1]), grad

    w = np.zeros(len(ratio) + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    now, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, factors = -grad, []
        for s, t in reversed(past):
            factors.append(float(s @ d) / float(s @ t))
            d = d - factors[-1] * t
        d = d * (float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(grad).sum())))
        for (s, t), f in zip(past, reversed(factors), strict=True):
            d = d + (f - float(t @ d) / float(s @ t)) * s
        slope, step = float(d @ grad), 1.0
        new, after = loss(w + d)
        while new > now + 1e-4 * step * slope and step > 1e-6:
            step /= 2
            new, after = loss(w + step * d)
        if not new < now:
            break
        s, t = step * d, after - grad
        done = now - new < 1e-7 * max(1.0, now)
        w, now, grad = w + s, new, after
        if float(s @ t) > 0:
            past = [*past[-7:], (s, t)]
        if done:
            break
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, features: int = 16_384, l2: float = 1e-4, rounds: int = 80,
    min_docs: int = 3, held_out: Column | None = None,
) -> Model:
    """Fit on at most ``max_rows`` labelled rows (those of the smallest hash of doc_id; the
    bound of the sample) that ``held_out`` does not mark.

    Documents with several labels count as toxic if one label says so; null labels and ids
    are left out; of rows that repeat a doc_id the first text in order is learnt from.  The log-count ratio of a bucket is log((p/|p|)/(q/|q|)) with p and q one
    plus the number of toxic and clean sample documents that hold it.  Of buckets in
    ``min_docs`` sample documents or more, since rarer ones only tell those apart, the ``features``
    whose ratio is furthest from zero in standard errors enter the regression, so at
    most ``max_rows`` * ``features`` two-byte numbers reach the driver.
    Without any label the model scores 0.5 everywhere.
    """
    lab = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).dropna()
    lab = lab.where(~held_out) if held_out is not None else lab
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def featured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(rows, 200):
            found = [np.unique(_buckets(t)) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(f) for f in found])
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=["toxic", "buckets"])

    def tallied(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int32)
        for b in rows:
            toxic = np.repeat(b.column(0).to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            for k in (0, 1):
                held[k] += np.bincount(b.column(1).flatten().to_numpy(zero_copy_only=False)[toxic == k], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(held.any(0))
        for at in np.split(some, range(50_000, len(some), 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[1, at], pa.int64()), pa.array(held[:, at].sum(0), pa.int64())], names=["bucket", "p", "c"])

    rows = texts_of(docs).select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    rows = stored(rows.mapInArrow(featured, "toxic int, buckets array<int>"), "toxicity-sample")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return Model(np.empty(0, np.int32), np.empty(0), 0.0 if n == 0 else (8.0 if positive else -8.0))
    counts = rows.mapInArrow(tallied, "bucket int, p long, c long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    p, q = F.col("p") + 1.0, F.col("c") - F.col("p") + 1.0
    ratio = F.log(p / (positive + 2.0)) - F.log(q / (n - positive + 2.0))
    spread = F.sqrt(1 / p + 1 / q)
    top = (
        counts.where(F.col("c") >= min_docs).select("bucket", ratio.alias("ratio"), F.abs(ratio / spread).alias("z"))
        .orderBy(F.desc("z"), "bucket").limit(features).select("bucket", "ratio").collect()
    )
    chosen = sorted((r.bucket, r.ratio) for r in top)
    buckets, ratios = np.array([k for k, _ in chosen], np.int32), np.array([r for _, r in chosen])
    kind = np.uint16 if len(buckets) <= 1 << 16 else np.int32

    def chosen_only(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BITS, -1, np.int32)
        table[buckets] = np.arange(len(buckets))
        for b in rows:
            lists = b.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            k = table[lists.flatten().to_numpy(zero_copy_only=False)]
            kept = [x[x >= 0].astype(kind).tobytes() for x in np.split(k, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], names=["toxic", "at"])

    sample = rows.mapInArrow(chosen_only, "toxic int, at binary").toArrow()
    parts = [np.frombuffer(x.as_buffer(), kind) for x in sample.column("at")]
    lengths = np.array([len(x) for x in parts])
    w, bias = _fit(np.concatenate(parts), lengths, sample.column("toxic").to_numpy().astype(float), ratios, l2, rounds)
    return Model(buckets, w * ratios, bias)


def fold() -> Column:
    """crc32 of doc_id as text mod 5 is 0: held out.  Rows without doc_id are held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score`` (probability of label 1) and
    ``predicted`` (1 from 0.5 on).  Learns only from rows that are not held out; labels and
    other columns never enter a score.  Every row is returned, repeated ones too."""
    model = train(docs, labels, held_out=fold(), **options)
    scored = docs.select("doc_id", fold().alias("held_out"), model.scorer()(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not call toxic, all columns.  Without any
    label to learn from nothing is known to be toxic, and all rows stay.  Null and
    empty texts are scored by the intercept; repeated rows go or stay together."""
    model = train(docs, labels, held_out=fold(), **options)
    if model.bias == 0 and not len(model.buckets):
        return docs
    return docs.withColumn("__score", model.scorer()(F.col("text"))).where("__score < 0.5").drop("__score")
