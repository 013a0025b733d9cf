import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake.functions import expressions as X
from lineagelake.functions import kernels as K

# Pattern, read, barcode.
LITERALS = [
    ("ACGT", "ACGTACGT", "ACGT"),
    ("ACGTN", "ACGTGACGT", "ACGTG"),
    ("*CGT", "ACGAACGT", "ACGAA"),
    ("ACGT*", "ACGTTCGT", "TCGT"),
    ("A*GT", "ACGTACGT", "CGTAC"),
    ("ACGT", "TTTTTTTT", None),
    ("ACGTNN", "ACGTGG", "ACGTGG"),
    ("AA*CGT", "AAACTTGCTACGT", "ACTTGCTA"),
]
TOLERANT = [
    ("ACGT*", "ACGTTCGT", "TCGT"),
    ("ACGTACGTAT*", "ACGTCCGTATTCGT", "TCGT"),
    ("*GCTAGCTATT", "TTTTGCTAGCTATA", "TTTT"),
    ("ACGT*GCTA", "ACGTATTAGCTA", "ATTA"),
    ("ACACGT*GCTAAT", "ACACGTATTAGCTAAT", "ATTA"),
]


def one(spark, column, read):
    return spark.createDataFrame([(read,)], "seq string").select(column.alias("x")).first().x


@pytest.mark.parametrize(("pattern", "read", "barcode"), LITERALS)
def test_exact_patterns(spark, pattern, read, barcode):
    assert one(spark, X.extract(F.col("seq"), pattern), read) == barcode


@pytest.mark.parametrize(("pattern", "read", "barcode"), TOLERANT)
def test_tolerant_patterns(spark, pattern, read, barcode):
    assert one(spark, K.trim(F.col("seq"), pattern, 0.1), read) == barcode


def test_trimming_keeps_what_is_next_to_the_flank(spark):
    assert one(spark, X.extract(F.col("seq"), "*CGT", max_read_length=2), "ACGAACGT") == "AA"
    assert one(spark, X.extract(F.col("seq"), "ACGT*", max_read_length=2), "ACGTTCGT") == "TC"
    assert one(spark, X.extract(F.col("seq"), "ACGT*", read_length=3), "ACGTTCGT") == "TCG"


def test_matches_with_n_are_rejected(spark):
    assert one(spark, X.extract(F.col("seq"), "ACGT*"), "ACGTTNGT") is None
    assert one(spark, X.find_listed(F.col("seq"), ["ACGT"]), "ACGTN") is None


@pytest.mark.parametrize("bad", ["AC*GT*", "*", "ACN*", "ACX", "", "acgt"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        X.Pattern.parse(bad)


@pytest.mark.parametrize("find", [X.find_listed, K.find_listed])
@pytest.mark.parametrize(
    ("names", "read", "want"),
    [
        ({"ACGT": "MATCH1", "GCTA": "MATCH2"}, "ACGTGCTAGCAT", "MATCH1"),
        ({"ACGT": "MATCH1", "ACG": "MATCH2"}, "ACGTGCTAGCAT", "MATCH1"),
        ({"CGTA": "CGTA", "GCTA": "GCTA"}, "CGTAGCTAGCAT", "CGTA"),
        ({"AC": "short", "GGGG": "long"}, "ACTTGGGG", "long"),
        ({"AC": "x"}, "TTTT", None),
    ],
)
def test_listed(spark, find, names, read, want):
    assert one(spark, X.named(find(F.col("seq"), list(names)), names), read) == want


def test_near(spark):
    assert one(spark, K.find_near(F.col("seq"), ["ACGC", "GCTAAA"], 1), "ACGTGCTAGCAT") == "ACGC"
    assert one(spark, K.find_near(F.col("seq"), ["ACGC", "GCTAAA"], 1), "T" * 14) is None
    assert one(spark, K.find_near(F.col("seq"), ["ACGC"], 1), None) is None


def infix(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, a in enumerate(p, 1):
            new.append(min(row[i - 1] + (a != c), new[-1] + 1, row[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_infix_distance_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        p, t = ("".join(rng.choices("ACGT", k=rng.randint(1, n))) for n in (70, 40))
        assert K.infix_distance(p, np.frombuffer(t.encode(), np.uint8)[None])[0] == infix(p, t)


def test_adapter_errors_against_brute_force():
    rng = random.Random(4)
    reads = ["".join(rng.choices("ACGT", k=24)) for _ in range(60)]
    _, stop = K.adapter_places(reads, "ACGTAC", False, 2, 6)
    for r, e in zip(reads, stop, strict=True):
        assert (e >= 0) == (infix("ACGTAC", r) <= 2)


def test_quality(spark):
    q = F.col("seq")
    assert one(spark, X.qc_pass(q, 20, 75), "IIII")
    assert not one(spark, X.qc_pass(q, 20, 75), "####")
    assert not one(spark, X.qc_pass(q, 20, 75), "")
    assert not one(spark, X.qc_pass(q, 20, 75), None)
    assert one(spark, X.qc_pass(q, 0, 75), "####")
    assert one(spark, X.qc_pass(q, 20, 50), "II##")
    assert not one(spark, X.qc_pass(q, 20, 50, phred33=False), "II##")
    ints = spark.createDataFrame([([30, 30, 2],), ([],), (None,)], "q array<int>").select(X.qc_pass_ints(F.col("q"), 20, 60).alias("x"))
    assert [r.x for r in ints.collect()] == [True, False, False]


def test_lengths_and_distances(spark):
    df = spark.createDataFrame([("ACGT", "ACGA"), ("ACG", "ACGTT")], "a string, b string")
    assert [r.x for r in df.select(X.hamming(F.col("a"), F.col("b")).alias("x")).collect()] == [1, 2]
    gate = df.where(X.length_gate(F.col("a"), True, 0, 4, 0)).collect()
    assert [r.a for r in gate] == ["ACGT"]
    assert df.where(X.length_gate(F.col("a"), False, 9)).count() == 2
    assert one(spark, X.ngrams(F.col("seq"), 3), "AC") == []
    assert one(spark, X.ngrams(F.col("seq"), 2), "ACACG") == ["AC", "CA", "CG"]


def test_both_finders_of_listed_sequences_agree(spark):
    rng = random.Random(9)
    reads = ["".join(rng.choices("ACGTN", (5, 5, 5, 5, 0.2), k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "N"]
    listed = list({"".join(rng.choices("ACGT", k=rng.randint(2, 5))) for _ in range(50)})
    reads += ["".join(rng.choices(listed, k=8)) for _ in range(100)]
    df = spark.createDataFrame([(r,) for r in reads], "seq string")
    got = df.select(X.find_listed(F.col("seq"), listed).alias("a"), K.find_listed(F.col("seq"), listed).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a is not None for r in got) > 200


def test_nearest_listed_against_brute_force():
    rng = random.Random(10)
    listed = ["".join(rng.choices("ACGT", k=rng.randint(2, 12))) for _ in range(25)]
    reads = ["".join(rng.choices("ACGT", k=rng.randint(1, 30))) for _ in range(200)] + [None]
    for most in (0, 1, 2, 3):
        want = []
        for r in reads:
            d = [(infix(s, r), k) for k, s in enumerate(listed)] if r else []
            want.append(listed[min(d)[1]] if d and min(d)[0] <= most else None)
        assert K.nearest_listed(reads, listed, most) == want


def test_exact_adapters_are_the_best_alignments():
    rng = random.Random(11)
    reads = ["".join(rng.choices("AC", k=24)) for _ in range(300)]
    for end3 in (True, False):
        a, b = K.adapter_places(reads, "ACCAC", end3, 0.2, 3)
        c, d = K._aligned_places(reads, "ACCAC", end3, 0.2, 3)
        assert (a == c).all() and (b == d).all()


def plain_place(read, adapter, end3, rate, overlap):
    """The best alignment by a table over the whole read."""
    m, n = len(adapter), len(read)
    free = 0 if end3 else m - overlap
    column = [(i - min(i, free), -2 * (i - min(i, free)), 0, min(i, free)) for i in range(m + 1)]
    best, found = -(10**6), (-1, -1)

    def offer(i, j):
        nonlocal best, found
        cost, score, start, skipped = column[i]
        if i - skipped >= overlap and cost <= int(rate * (i - skipped) + 1e-9) and score > best:
            best, found = score, (start, j)

    for j in range(1, n + 1):
        new = [(0, 0, j, 0)]
        for i in range(1, m + 1):
            c, s, o, k = column[i - 1]
            hit = read[j - 1] == adapter[i - 1]
            cell = (c + (not hit), s + (1 if hit else -1), o, k)
            for c, s, o, k in (new[i - 1], column[i]):
                if c + 1 < cell[0]:
                    cell = (c + 1, s - 2, o, k)
            new.append(cell)
        column = new
        offer(m, j)
    if end3:
        for i in range(m - 1, 0, -1):
            offer(i, n)
    return found


@pytest.mark.parametrize("end3", [True, False])
def test_windows_of_flanks_equal_whole_alignments(end3):
    rng = random.Random(end3)
    for _ in range(250):
        adapter = "".join(rng.choices("ACG", k=rng.randrange(1, 14)))
        errors, overlap = rng.choice([0.1, 0.2, 0.34, 0.5, 1, 2, 3]), rng.randrange(1, len(adapter) + 1)
        reads = []
        for _ in range(12):
            x = list("".join(rng.choices("ACG", k=rng.randrange(12))) + adapter[rng.randrange(2) :] + "".join(rng.choices("ACG", k=rng.randrange(12))))
            for _ in range(rng.randrange(4)):
                if x:
                    k = rng.randrange(len(x))
                    x[k : k + 1] = rng.choice(["", "A", "C", "GG"])
            reads.append("".join(x))
        begin, stop = K._aligned_places(reads, adapter, end3, errors, overlap)
        rate = errors / len(adapter) if errors >= 1 else errors
        assert list(zip(begin.tolist(), stop.tolist(), strict=True)) == [plain_place(r, adapter, end3, rate, overlap) for r in reads]


def test_a_long_flank():
    rng = random.Random(7)
    adapter = "".join(rng.choices("ACGT", k=70))
    reads = ["".join(rng.choices("ACGT", k=9)) + adapter[:30] + "A" + adapter[31:] + "ACGT", "ACGT" * 20]
    begin, stop = K._aligned_places(reads, adapter, True, 0.1, 70)
    assert list(zip(begin.tolist(), stop.tolist(), strict=True)) == [plain_place(r, adapter, True, 0.1, 70) for r in reads] == [(9, 79), (-1, -1)]
