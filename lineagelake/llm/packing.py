"""Best-two-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored, texts_of

#: A row of the plan: length, first rank of that length, ranks, uses in a sequence, first
#: sequence, offset in it.
Segment = tuple[int, int, int, int, int, int]


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Segment]:
    """The plan of best-two-fit over ``counts`` (pieces by length).

    A sequence is filled greedily, longest fitting piece first.  Then its smallest piece is
    replaced by the two unpacked pieces that fit the gap so widened most tightly, if those
    fill it better.  The same sequence is made as often as the counts allow before the next
    is planned, which is what packing one piece after the other gives; so the work depends
    on the number of different lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    used: dict[int, int] = {}
    plan: list[Segment] = []
    sequence = 0
    while lengths:
        own: dict[int, int] = {}

        def free(n: int) -> int:
            return left.get(n, 0) - own.get(n, 0)

        gap, i = capacity, len(lengths) - 1
        while i >= 0:
            i = min(i, bisect_right(lengths, gap) - 1)
            if i < 0:
                break
            n = lengths[i]
            k = min(free(n), gap // n)
            if k:
                own[n] = own.get(n, 0) + k
                gap -= k * n
            i -= 1
        if gap and len(own):
            small = min(own)
            room = gap + small
            best = (small, None)
            j = bisect_right(lengths, room) - 1
            for i in range(len(lengths)):
                a = lengths[i]
                if a >= room or best[0] == room:
                    break
                if not free(a):
                    continue
                while j >= 0 and a + lengths[j] > room:
                    j -= 1
                k = j
                while k >= i and (not free(lengths[k]) or k == i and free(a) < 2):
                    k -= 1
                if k < i:
                    if j < i:
                        break
                    continue
                if a + lengths[k] > best[0]:
                    best = (a + lengths[k], (a, lengths[k]))
            if best[1]:
                own[small] -= 1
                for n in best[1]:
                    own[n] = own.get(n, 0) + 1
        own = {n: k for n, k in own.items() if k}
        times = min(left[n] // k for n, k in own.items())
        offset = 0
        for n in sorted(own, reverse=True):
            k = own[n]
            plan.append((n, used.get(n, 0), k * times, k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += k * n
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
        sequence += times
    return plan


#: How a tokenizer must normalise and split texts so that parts can be looked up
#: by themselves.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

#: Kinds of bytes: white space, ASCII letters, digits, other visible ASCII, all else.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[9, 10, 13, 32]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts that ``_SPLIT`` makes of a normalised text which begins and ends with two white
    spaces: their bytes, one after the other, their lengths, and where they stand in the text.

    ASCII and the letters U+00C0 to U+00FF are lower-cased and split here.  A white-space
    separated word with any other character, or with what may be a special token, stays one
    part as it is.
    """
    raw = np.frombuffer(text, np.uint8)
    kind, low = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[~np.isin(raw[lead + 1], (0x97, 0xB7))]  # the signs of multiplication and division
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead[raw[lead + 1] < 0x9F] + 1] += 32
    kind[np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))] = _OTHER
    other = np.flatnonzero(kind == _OTHER)
    if len(other):
        gaps = np.flatnonzero(kind == _SPACE)
        word = np.unique(np.searchsorted(gaps, other))
        edge = np.zeros(len(raw), np.int8)
        edge[gaps[word - 1] + 1], edge[gaps[word]] = 1, -1
        whole = np.cumsum(edge, dtype=np.int8) == 1
        kind[whole] = _OTHER
        low[whole] = raw[whole]
    begins = np.ones(len(raw), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    at = np.flatnonzero((raw == ord("'")) & (kind == _SIGN))
    at = at[kind[at - 1] != _SIGN]
    one, two = low[at + 1], low[at + 2]
    short = np.isin(one, list(b"stmd"))
    long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = begins[at[long] + 3] = True
    first = np.flatnonzero(begins)
    size = np.diff(first, append=len(raw))
    seen = kind[first] != _SPACE
    return low[kind != _SPACE], size[seen], first[seen]


class _Words:
    """Ids of texts, the distinct parts of many texts looked up at once in a memory of ids (as
    little-endian 32-bit bytes).  The memory has two halves: once the newer one is large, it
    becomes the older one and that is forgotten, so common parts stay.  A tokenizer of another
    kind than ``_SPLIT`` and ``_NORMAL`` say encodes whole texts, without any memory."""

    MOST, LONGEST, AT_ONCE, MARK = 200_000, 100, 4_000_000, "<|startoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.token_to_id(self.MARK)
        told = json.loads(self.tokenizer.to_str())
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = (
            (told["normalizer"] or {}).get("normalizers") == _NORMAL
            and len(splits) == 2
            and splits[0].get("pattern") == {"Regex": _SPLIT}
            and splits[0].get("behavior") == "Removed"
            and splits[1].get("type") == "ByteLevel"
            and not splits[1].get("add_prefix_space")
            and not splits[1].get("use_regex")
            and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in told["added_tokens"])
        )
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after the other, and how many each text has."""
        if not self.by_word:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)
        own = [t.encode() for t in texts]
        starts = np.cumsum([0, *(len(t) + 1 for t in own)])[:-1]
        joined = b"\n".join(own)
        ids, counts, a = [np.empty(0, "<u4")], np.zeros(len(texts), np.int64), 0
        while a < len(joined):  # cut at white space, so that long texts need no more memory
            b = len(joined)
            if b - a > self.AT_ONCE:
                b = a + self.AT_ONCE
                b = max(joined.rfind(x, a, b) for x in (b" ", b"\n")) + 1 or min((k + 1 for x in (b" ", b"\n") if (k := joined.find(x, b)) >= 0), default=len(joined))
            data, size, at = _parts(b"  " + joined[a:b] + b"  ")
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            parts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            known = self._look_up(parts.dictionary.to_pylist())
            n = np.fromiter(map(len, known), np.int64, len(known)) // 4
            flat, which = np.frombuffer(b"".join(known), "<u4"), parts.indices.to_numpy()
            each = n[which]
            ends = np.cumsum(each)
            ids.append(flat[np.repeat((np.cumsum(n) - n)[which] - (ends - each), each) + np.arange(each.sum())])
            counts += np.bincount(np.searchsorted(starts, at + (a - 2), "right") - 1, each, len(texts)).astype(np.int64)
            a = b
        return np.concatenate(ids), counts

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        found = list(map(self.newer.get, parts))
        new = [p for p, ids in zip(parts, found, strict=True) if ids is None]
        if new:
            own = {p: ids for p in new if (ids := self.older.get(p)) is not None}
            own |= self._learn([p for p in new if p not in own])
            found = [own[p] if ids is None else ids for p, ids in zip(parts, found, strict=True)]
            if len(self.newer) > self.MOST:
                self.newer, self.older = {}, self.newer
            self.newer.update((p, ids) for p, ids in own.items() if len(p) <= self.LONGEST)
        return found

    def _learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        rest: list[bytes] = []
        for p in parts:
            if p.isalpha():  # lower-case ASCII: nothing to normalise or to split
                out[p] = array("I", [t.id for t in self.model.tokenize(p.decode())]).tobytes()
            elif self.mark is None or b"<|" in p:
                out[p] = np.array(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                rest.append(p)
        for i in range(0, len(rest), 4000):  # together, a special token between them
            some = rest[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.MARK.join(p.decode() for p in some)], add_special_tokens=False)[0].ids, "<u4")
            for p, own in zip(some, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                out[p] = (own[1:] if len(own) and own[0] == self.mark else own).tobytes()
        return out


_words: dict[str, _Words] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document cut at ``capacity``.

    Where the tokenizer drops white space and never joins what it separates, each part that it
    splits a text into is looked up by itself; its ids are those of the whole text.  The file
    must lie at ``tokenizer`` on every machine.  Null and empty texts are the end id alone.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _words:
            _words[tokenizer] = _Words(tokenizer)
        words = _words[tokenizer]
        for b in batches_of(rows, 500):
            ids, counts = words.encode([t or "" for t in b.column(1).to_pylist()])
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False)
            counts = counts + 1
            of = -(-counts // capacity)  # pieces of each document
            piece = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
            start = piece * capacity
            length = np.minimum(np.repeat(counts, of) - start, capacity)
            at = np.repeat(np.cumsum(counts) - counts, of) + start
            crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), of))), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, salts: int = 64) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens by best-two-fit.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Pieces are counted by length (at most ``capacity`` numbers reach the driver), the plan is
    made from those counts, and each piece finds its place by its rank among the pieces of
    its length.  Ranks are counted within ``salts`` parts of a length, so that one very
    common length is no single task.  Equal lengths are interchangeable: which of them goes
    where is fixed by (crc32 of the ids, doc_id, piece).  Rows without doc_id are packed like
    others; repeated rows are packed as often as they occur.  An empty table gives no row.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # at most capacity * salts numbers
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(sizes, key=lambda r: (r.length, r.salt)):
        before[r.length, r.salt] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    plan = best_two_fit(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast((plan, before))

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = shared.value
        by: dict[int, np.ndarray] = {}
        for s in plan:
            by.setdefault(s[0], []).append(s[1:])
        by = {n: np.array(v, np.int64) for n, v in by.items()}
        for b in rows:
            t = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names) if n in ("length", "salt", "rank")}
            seq, off = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for n in np.unique(t["length"]):
                at = np.flatnonzero(t["length"] == n)
                rank = np.array([before[int(n), int(s)] for s in t["salt"][at]]) + t["rank"][at] - 1
                seg = by[int(n)]
                k = np.searchsorted(seg[:, 0], rank, "right") - 1
                own = rank - seg[k, 0]
                seq[at] = seg[k, 3] + own // seg[k, 2]
                off[at] = seg[k, 4] + own % seg[k, 2] * n
            yield pa.RecordBatch.from_arrays(b.columns[:5] + [pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    from pyspark.sql import Window

    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("ids_crc32", "doc_id", "piece")).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
