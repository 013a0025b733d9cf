import random

import pytest

from lineagelake.operators import collapse as C


def distance(a, b, equal):
    if equal:
        return sum(x != y for x, y in zip(a, b, strict=True))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), new[-1] + 1, row[j] + 1))
        row = new
    return row[-1]


def sequential(order, t):
    """The method as a loop: blocks by shared n-grams, then nearest earlier root."""
    equal = len({len(s) for s in order}) == 1
    n = max(3, max(map(len, order)) // (t + 1))
    grams = {s: {s[i : i + n] for i in range(len(s) - n + 1)} for s in order}
    rest, out = list(order), {}
    while rest:
        block = [rest[0]] + [s for s in rest[1:] if grams[s] & grams[rest[0]]]
        rest = [s for s in rest if s not in block]
        roots = []
        for s in block:
            near = [(distance(s, r, equal), i) for i, r in enumerate(roots) if distance(s, r, equal) <= t]
            if near:
                out[s] = roots[min(near)[1]]
            else:
                roots.append(s)
                out[s] = s
    return out


@pytest.mark.parametrize(("lengths", "t", "seed"), [((8, 8), 1, 0), ((8, 8), 2, 1), ((6, 9), 2, 2), ((2, 6), 1, 3)])
def test_clusters_equal_the_sequential_method(spark, lengths, t, seed):
    rng = random.Random(seed)
    seqs = list({"".join(rng.choices("ACG", k=rng.randint(*lengths))) for _ in range(40)})
    counts = [(s, rng.randint(1, 9)) for s in seqs]
    want = sequential([s for s, _ in sorted(counts, key=lambda x: (-x[1], x[0]))], t)
    got = C.cluster(spark.createDataFrame(counts, "barcode string, counts long"), t).collect()
    assert {r.barcode: r.cluster for r in got} == want


@pytest.mark.parametrize(
    ("seqs", "t", "sizes"),
    [
        (["ACGT", "ACGTTT", "ACGTT"], 2, [3]),
        (["ATGACGTAACGT", "ATGACGTAATTT", "ATGACGTAAGGG", "ATGACGTAACCC"], 3, [4]),
    ],
)
def test_known_clusters(spark, seqs, t, sizes):
    got = C.cluster(spark.createDataFrame([(s, 1) for s in seqs], "barcode string, counts long"), t).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == sizes


def test_several_clusters(spark):
    seqs = ["ACTG", "ACTA", "ACGG", "GCTG", "GCTC", "GTTG"]
    got = C.cluster(spark.createDataFrame([(s, 1) for s in seqs], "barcode string, counts long"), 1).groupBy("cluster").count().collect()
    assert len(got) > 1 and max(r["count"] for r in got) > 1


def test_ratio_and_nothing(spark):
    rows = [("a", "AAAAAA", 100), ("a", "AAAAAT", 2), ("b", "AAAAAT", 60)]
    df = spark.createDataFrame(rows, "sample string, barcode string, counts long")
    got = {(r["sample"], r.barcode): r.counts for r in C.collapse(df, 1, 3).collect()}
    assert got == {("a", "AAAAAA"): 102, ("b", "AAAAAT"): 60}
    assert C.collapse(df, 0).count() == 3
    assert C.cluster(df.limit(0), 1).count() == 0


def test_exact_mode_looks_across_blocks(spark):
    df = spark.createDataFrame([("AAATTT", 9), ("AACCTT", 1)], "barcode string, counts long")
    assert C.cluster(df, 2).select("cluster").distinct().count() == 2
    assert C.cluster(df, 2, exact=True).select("cluster").distinct().count() == 1


def test_a_region_that_all_barcodes_share_is_no_key(spark):
    """Half of each barcode is constant: no set of positions lies in it, so few pairs meet."""
    rng = random.Random(8)
    seqs = sorted({"".join(rng.choices("ACGT", k=8)) + "ACGTACGTACGT" + "".join(rng.choices("ACGT", k=10)) for _ in range(300)})
    seqs += [s[:3] + ("A" if s[3] != "A" else "C") + s[4:] for s in seqs[:40]]
    df = spark.createDataFrame([(s, "") for s in seqs], "barcode string, block string")
    met = C._hamming_pairs(df, 2, "block")
    near = {(r.src, r.dst): r.dist for r in C.near_pairs(df, 2, True).collect()}
    assert near == {(a, b): distance(a, b, True) for a in seqs for b in seqs if a != b and distance(a, b, True) <= 2} and len(near) >= 80
    assert met.count() < 1000  # of 57,630


def test_short_barcodes_with_more_sets_than_letters(spark):
    df = spark.createDataFrame([(s, "") for s in ("A", "C", "G")], "barcode string, block string")
    assert len(C.near_pairs(df, 2, True).collect()) == 6
