"""Column expressions over reads, qualities and barcodes.  All run inside Spark's codegen."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def qc_pass(qual: Column, threshold: int, percentage: float, phred33: bool = True) -> Column:
    """At least ``percentage`` % of a quality string's characters reach ``threshold``.
    A threshold or percentage of 0 lets everything pass; an empty or null string fails."""
    if not threshold or not percentage:
        return F.lit(True)
    low = threshold + (33 if phred33 else 64)
    if low > 126:
        return F.lit(False)
    good = F.length(F.regexp_replace(qual, f"[^{re.escape(chr(low))}-~]", ""))
    return F.coalesce(100.0 * good / F.nullif(F.length(qual), F.lit(0)) >= percentage, F.lit(False))


def qc_pass_ints(qual: Column, threshold: int, percentage: float) -> Column:
    """The same over an array of phred numbers."""
    if not threshold or not percentage:
        return F.lit(True)
    good = F.size(F.filter(qual, lambda q: q >= threshold))
    return F.coalesce(100.0 * good / F.nullif(F.size(qual), F.lit(0)) >= percentage, F.lit(False))


def made_once(c: Column) -> Column:
    """``c``, made once for each row: Spark would write a column out again in every later filter
    that uses it.  One that depends on a row's place, if only where it is null, stays."""
    return F.coalesce(c, F.when(F.monotonically_increasing_id() < 0, c))


@dataclass(frozen=True)
class Pattern:
    """A barcode pattern: literal, with N for any base, or with one * for the barcode."""

    text: str
    kind: str  # exact, n, left (*F), right (F*), both (A*B)
    left: str = ""
    right: str = ""

    @staticmethod
    def parse(text: str) -> Pattern:
        """Checks the alphabet and shape; ValueError names what is wrong."""
        if not isinstance(text, str):
            raise TypeError("a pattern is a string, a list of sequences or a mapping of sequence to name")
        if not re.fullmatch(r"[ACGTN*]+", text):
            raise ValueError(f"a pattern may hold A, C, G, T, N and * only: {text!r}")
        if "N" in text and "*" in text:
            raise ValueError("a pattern holds N or *, not both")
        if text.count("*") > 1:
            raise ValueError("a pattern holds one * at most")
        if text == "*":
            raise ValueError("a * needs a flanking sequence")
        if "*" not in text:
            return Pattern(text, "n" if "N" in text else "exact")
        left, right = text.split("*")
        return Pattern(text, "both" if left and right else "right" if left else "left", left, right)

    def regex(self, read_length: int = 0) -> tuple[str, int]:
        """The regular expression and the group that is the barcode."""
        body = f"(.{{{read_length}}})" if read_length and self.kind in ("left", "right") else "(.*)"
        if self.kind == "exact":
            return self.text, 0
        if self.kind == "n":
            return re.sub("N+", lambda m: f".{{{len(m.group())}}}", self.text), 0
        return self.left + body + self.right, 1


def trimmed(barcode: Column, kind: str, most: int) -> Column:
    """A one-sided match cut to ``most`` bases, those next to the flank."""
    if not most or kind not in ("left", "right"):
        return barcode
    return F.right(barcode, F.lit(most)) if kind == "left" else F.left(barcode, F.lit(most))


def extract(seq: Column, pattern: str | Pattern, read_length: int | None = 0, max_read_length: int | None = 0) -> Column:
    """The barcode of a read, or null: the leftmost match; one that holds N is no match."""
    p = pattern if isinstance(pattern, Pattern) else Pattern.parse(pattern)
    rx, group = p.regex(read_length or 0)
    found = F.regexp_extract(seq, rx, group)
    found = F.when((F.length(found) > 0) & ~F.contains(found, F.lit("N")), found)
    return trimmed(found, p.kind, max_read_length or 0)


def length_gate(barcode: Column, flanked: bool, length: int | None = 0, least: int | None = 0, most: int | None = 0) -> Column:
    """Length limits, which hold only for flanked patterns; 0 or None is no limit."""
    ok = F.length(barcode) > 0
    if flanked:
        n = F.length(barcode)
        if length:
            ok = ok & (n == length)
        if least:
            ok = ok & (n >= least)
        if most:
            ok = ok & (n <= most)
    return ok


def no_n(seq: Column) -> Column:
    return ~F.contains(seq, F.lit("N"))


def find_listed(seq: Column, sequences: list[str]) -> Column:
    """Of the leftmost-longest, non-overlapping occurrences of listed sequences, the longest;
    the first of equals.  Reads with N have none.  For lists that fit a regular expression;
    larger ones use ``kernels.find_listed``."""
    rx = "|".join(sorted(set(sequences), key=lambda s: (-len(s), s)))
    hits = F.regexp_extract_all(seq, F.lit(f"({rx})"), F.lit(1))
    longest = F.reduce(hits, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(no_n(seq) & (F.length(longest) > 0), longest)


def named(found: Column, names: dict[str, str]) -> Column:
    """The name of a found sequence."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), found)


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; missing positions of the shorter count."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def ngrams(seq: Column, n: int) -> Column:
    """Distinct character n-grams; none for shorter strings."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - n + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(n)))
    return F.when(F.length(seq) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def cell_of_read(r1: Column, cell_length: int = 16) -> Column:
    return F.substring(r1, 1, cell_length)


def umi_of_read(r1: Column, cell_length: int = 16, umi_length: int = 8) -> Column:
    return F.substring(r1, cell_length + 1, umi_length)


def cell_of_name(qname: Column) -> Column:
    """Cell id of a split-pool read: what precedes the first ``__`` of its name."""
    return F.split_part(qname, F.lit("__"), F.lit(1))


def cell_of_coordinates(x: Column, y: Column) -> Column:
    return F.concat_ws("_", x, y)


def with_suffix(cell: Column, suffix: Column | str) -> Column:
    return F.concat(cell, F.lit("-"), F.lit(suffix) if isinstance(suffix, str) else suffix)
