"""Benchmark decontamination by the q-gram lemma: shared character q-grams counted in
overlapping diagonal bands, bands within the edit budget verified by banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, stored, texts_of

#: Characters of a q-gram and of a benchmark window, distance of two windows' starts, share
#: of a window's characters that edits may touch, shortest item that may be edited, and
#: characters of benchmark text that one pass broadcasts.
Q, WINDOW, STRIDE, EDITS, SHORTEST, BLOCK = 12, 64, 1, 0.0625, 24, 2_000_000
#: Of windows found side by side one is returned at this distance, and the last; neighbouring
#: bands verified together.
APART, TOGETHER = 32, 4
_TOKEN = re.compile(r"\w+|[^\w\s]")
_NONE = np.uint32(0xFFFFFFFF)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
MATCHES = "array<struct<item_id:long,start:int,end:int,edits:int>>"


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    x, m = codes.astype(np.uint64), len(codes) - Q + 1
    h = np.zeros(m, np.uint64)
    for i in range(Q):
        h = (h ^ (h >> np.uint64(31))) * _MUL + x[i : i + m]
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _dense(pos: np.ndarray, need: int) -> np.ndarray:
    """Positions with ``need`` of them, themselves included, in a stretch as long as any match:
    others cannot be part of one."""
    if len(pos) < need:
        return pos[:0]
    first = np.flatnonzero(pos[need - 1 :] - pos[: len(pos) - need + 1] <= WINDOW + int(EDITS * WINDOW) - Q)
    edge = np.zeros(len(pos) + 1, int)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + need, -1)
    return pos[np.cumsum(edge[:-1]) > 0]


class Index:
    """The q-grams of a bounded block of benchmark items, and its shortest items as strings."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text, self.codes = [], [], []
        self.short: dict[str, list[tuple[int, str]]] = {}
        grams, owner, at = [], [], []
        for item, raw in items:
            text = normal(raw)
            if len(text) < SHORTEST:
                if text:
                    self.short.setdefault(_TOKEN.match(text).group(), []).append((item, text))
                continue
            codes = _codes(text)
            g = _grams(codes)
            grams.append(g)
            owner.append(np.full(len(g), len(self.text)))
            at.append(np.arange(len(g)))
            self.item.append(item)
            self.text.append(text)
            self.codes.append(codes)
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.owner = (np.concatenate(owner) if owner else np.empty(0, int))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, int))[order]
        self.grams, self.first = np.unique(g[order], return_index=True)
        self.last = np.append(self.first[1:], len(g)).astype(int)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _BITS)] = True
        self.length = np.array([len(t) for t in self.text], int)
        self.width = np.minimum(self.length, WINDOW)
        self.edits = np.minimum((EDITS * self.width).astype(int), (self.width - Q) // Q)
        self.need = self.width - Q + 1 - Q * self.edits
        self.least = int(self.need.min()) if self.text else 1

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, start, end, edits)`` in the normalised text: windows found, and items of
        under ``SHORTEST`` characters that stand in it as whole words."""
        return self._whole(text) + self._windows(text)

    def _whole(self, text: str) -> list[tuple[int, int, int, int]]:
        out = []
        for m in _TOKEN.finditer(text) if self.short else ():
            for item, short in self.short.get(m.group(), ()):
                end = m.start() + len(short)
                if text.startswith(short, m.start()) and not re.match(r"\w\w", text[end - 1 : end + 1]):
                    out.append((item, m.start(), end, 0))
        return out

    def _windows(self, text: str) -> list[tuple[int, int, int, int]]:
        codes = _codes(text)
        g = _grams(codes)
        pos = _dense(np.flatnonzero(self.seen[g >> np.uint64(64 - _BITS)]), self.least)
        if not len(pos) or not len(self.grams):
            return []
        k = np.minimum(np.searchsorted(self.grams, g[pos]), len(self.grams) - 1)
        real = self.grams[k] == g[pos]
        pos, k = pos[real], k[real]
        if not len(pos):
            return []
        many = self.last[k] - self.first[k]
        into = np.repeat(self.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        v, at, pos = self.owner[into], self.at[into], np.repeat(pos, many)
        # A match within e edits keeps its q-grams within 2e+1 neighbouring diagonals, which
        # one of the bands of twice that width, placed at that distance, holds whole.
        band = (pos - at) // (2 * self.edits[v] + 1)
        v, band, at = np.concatenate([v, v]), np.concatenate([band, band - 1]), np.concatenate([at, at])
        order = np.lexsort((at, band, v))
        v, band, at = v[order], band[order], at[order]
        new = np.append(True, (v[1:] != v[:-1]) | (band[1:] != band[:-1]) | (at[1:] != at[:-1]))
        v, band, at = v[new], band[new], at[new]
        # Windows of the item that hold as many q-grams of one band as a match leaves.
        room = self.width[v] - Q
        there = np.arange(len(v)) + self.need[v] - 1
        far = np.minimum(there, len(v) - 1)
        enough = np.flatnonzero((there < len(v)) & (v[far] == v) & (band[far] == band) & (at[far] - at <= room))
        if not len(enough):
            return []
        low, high = np.maximum(0, at[far] - room)[enough], np.minimum(at, self.length[v] - self.width[v])[enough]
        v, band = v[enough], band[enough]
        out, i = [], 0
        while i < len(v):
            j = i
            while j < len(v) and v[j] == v[i] and band[j] - band[i] < TOGETHER and (j == i or band[j] - band[j - 1] <= 1):
                j += 1
            edge = np.zeros(int(high[i:j].max()) + 2, int)
            np.add.at(edge, low[i:j], 1)
            np.add.at(edge, high[i:j] + 1, -1)
            step = 2 * int(self.edits[v[i]]) + 1
            out += self._verified(int(v[i]), np.flatnonzero(np.cumsum(edge) > 0), text, codes, int(band[i]) * step, (int(band[j - 1] - band[i]) + 2) * step)
            i = j
        return sorted(set(out))

    def _verified(self, v: int, starts: np.ndarray, text: str, codes: np.ndarray, diagonal: int, across: int) -> Iterator[tuple[int, int, int, int]]:
        """The windows of item ``v`` at ``starts`` that occur within the budget of edits on the
        ``across`` diagonals from ``diagonal`` on, one for each ``APART`` and the last."""
        e, w = int(self.edits[v]), int(self.width[v])
        size = w + across + 2 * e

        def exact(s: int) -> tuple[int, int, int] | None:
            lo = max(0, diagonal + s - e)
            at = text.find(self.text[v][s : s + w], lo, max(0, diagonal + s - e + size))
            return (at, at + w, 0) if at >= 0 else None

        def aligned(chunk: np.ndarray) -> list[tuple[int, tuple[int, int, int]]]:
            where = (diagonal + chunk - e)[:, None] + np.arange(size)
            inside = (where >= 0) & (where < len(codes))
            region = np.where(inside, codes[np.clip(where, 0, len(codes) - 1)], _NONE)
            found = _aligned(self.codes[v][chunk[:, None] + np.arange(w)], region, e)
            clip = lambda x: min(max(x, 0), len(codes))
            return [(n, (clip(int(where[n, 0]) + a), clip(int(where[n, 0]) + b), c)) for n, a, b, c in found]

        k, matched = 0, False
        while k < len(starts):
            # The first window found, then the farthest that is no more than APART away.
            end = int(np.searchsorted(starts, starts[k - 1] + APART, "right")) if matched else min(len(starts), k + APART)
            if end == k:
                matched = False
                continue
            n = end - 1 if matched else k
            hit = exact(int(starts[n]))
            if hit is None and (found := aligned(starts[k:end])):
                n, hit = found[-1 if matched else 0]
                n += k
            if hit:
                yield (self.item[v], *hit)
                k, matched = n + 1, True
            else:
                k, matched = end, False


def _aligned(pieces: np.ndarray, regions: np.ndarray, budget: int) -> list[tuple[int, int, int, int]]:
    """``(row, start, end, edits)`` of the best occurrence of each row of ``pieces`` in the same
    row of ``regions``, for rows with one of at most ``budget`` edits.

    Banded: only the diagonals from the region's start to where the piece just fits are filled,
    so a row of the table is as long as the region is longer than the piece.
    """
    width = pieces.shape[1]
    steps = np.arange(regions.shape[1] - width + 1, dtype=np.int32)
    alive = np.arange(len(pieces))
    row = np.zeros((len(pieces), len(steps)), np.int32)
    start = np.repeat(steps[None], len(pieces), 0)
    for i in range(width):
        best, frm = row + (regions[:, i : i + len(steps)] != pieces[:, i : i + 1]), start.copy()
        less = row[:, 1:] + 1 < best[:, :-1]  # a character of the piece is missing
        best[:, :-1], frm[:, :-1] = np.where(less, row[:, 1:] + 1, best[:, :-1]), np.where(less, start[:, 1:], frm[:, :-1])
        best -= steps
        left = np.minimum.accumulate(best, 1)
        src = np.maximum.accumulate(np.where(best == left, steps, 0), 1)
        row, start = left + steps, np.take_along_axis(frm, src, 1)
        keep = row.min(1) <= budget
        if not keep.all():
            alive, pieces, regions, row, start = alive[keep], pieces[keep], regions[keep], row[keep], start[keep]
            if not len(alive):
                return []
    ends = row.argmin(1)
    return [(int(n), int(start[x, end]), int(end) + width, int(row[x, end])) for x, (n, end) in enumerate(zip(alive, ends, strict=True))]


def _original(text: str, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of the normalised text as code points of the text itself."""
    where, blank, lower = [], True, text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer
        lower, owner = "", []
        for i, c in enumerate(text):
            lower += c.lower()
            owner += [i] * len(c.lower())
    else:
        owner = range(len(text))
    for j, c in enumerate(lower):
        if not c.isspace():
            where.append(owner[j])
            blank = False
        elif not blank:
            where.append(owner[j])
            blank = True
    return [(i, where[s], where[min(e, len(where)) - 1] + 1, n) for i, s, e, n in spans]


def blocks(benchmark: DataFrame, chars: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``chars`` characters, each small enough for
    the driver and for a broadcast; nulls are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    for i in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def _searcher(shared):
    """A column function from text to matches with the items of the broadcast ``shared``."""
    index: list[Index] = []

    @F.arrow_udf(MATCHES)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not index:
            index.append(Index(shared.value))
        for s in texts:
            out = []
            for t in (x.as_py() for x in s):
                found = index[0].matches(normal(t))
                out.append([dict(zip(("item_id", "start", "end", "edits"), m, strict=True)) for m in _original(t, found)] if found else [])
            yield pa.array(out, _ARROW)

    return search


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str = "matches", chars: int = BLOCK) -> DataFrame:
    """``docs`` and a column of the benchmark windows found in each whole text, as structs
    ``item_id, start, end`` (code points of the text, end exclusive) and ``edits``.

    Every stretch of 64 characters of an item, or the whole of a shorter one, is a window; it
    matches with up to a sixteenth of its characters edited, case and white space aside.  Items
    of under 24 characters match whole, unedited and between word boundaries.  Of windows
    found side by side the first, one for each 32 characters and the last are returned.  Null
    texts match nothing; repeated rows each have their matches.  A larger benchmark takes more
    passes over the texts, one after the other for ``chars`` characters of it, never a larger broadcast or index.  Nothing is
    shuffled.
    """
    out, last = texts_of(docs).withColumn(column, F.array().cast(MATCHES)), None
    for k, items in enumerate(blocks(benchmark, chars)):
        if k:  # one block's index at a time in a worker's memory
            before, last, out = last, *[stored(out, "searched")] * 2
            if before is not None:
                free(before)
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = out.withColumn(column, F.concat(column, _searcher(shared)("text")))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document that holds benchmark text: ``doc_id, contaminated`` (true),
    ``n_items, item_ids`` (sorted, joined by commas), ``n_windows`` and ``spans``
    (``item:start:end:edits``, by start, joined by commas).  Clean documents have no row, nor
    have null and empty texts; repeated rows each have one."""
    found = with_matches(docs.select("doc_id", "text"), benchmark).drop("text").where(F.size("matches") > 0)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"), m["item_id"].alias("i"), m["edits"].alias("n"))))
    return found.select(
        "doc_id", F.lit(True).alias("contaminated"), F.size(ids).cast("long").alias("n_items"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("item_ids"), F.size("matches").cast("long").alias("n_windows"),
        F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", m["i"], m["s"], m["e"], m["n"])), ",").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without benchmark text, all columns.  Rows with null or empty texts
    stay; repeated rows go or stay together."""
    return with_matches(docs, benchmark, "__matches").where(F.size("__matches") == 0).drop("__matches")
