import random

from lineagelake.llm.common import connected_components, shingle_set
from lineagelake.llm.near_dedup import near_duplicates


def brute(rows, words, percent):
    sets = [(i, set(shingle_set(t, words).tolist())) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in sets}


def corpus(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_groups_equal_brute_force(spark):
    rows = corpus(1, 12, 8)
    for words in (2, 5):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()
        want = brute(rows, words, 80)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "ONE", "b"), (6, "one two", "b"), (7, "Ünë", "b"), (8, "üNë", "b"),
        (None, "one", "c"), (9, long, "c"), (10, long + " more", "c"), (6, "one two", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(df, 2).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[4, 1] == (4, True) and got[5, 1] == (4, False) and got[6, 1] == (6, True)
    assert got[7, 1] == (7, True) and got[8, 1] == (8, True)  # only A-Z is lower-cased
    assert got[None, 1] == (None, True)
    assert got[9, 29_999] == (9, True) and got[10, 30_000] == (9, False)
    assert near_duplicates(df, 2).count() == len(rows)
    assert near_duplicates(df.limit(0), 2).count() == 0


def test_shingles():
    assert len(shingle_set("a b c a b", 2)) == 3
    assert len(shingle_set("a b", 5)) == 1
    assert (shingle_set("A b", 5) == shingle_set("a  B", 5)).all()
    assert not len(set(shingle_set("a b", 2)) & set(shingle_set("a b", 1)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert set(got) == set(range(41)) | {100, 101} | set(range(500, 560))
    assert all(c == (0 if n < 50 else 100 if n < 200 else 500) for n, c in got.items())
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
