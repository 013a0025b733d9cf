import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lineagelake.llm.common import scratch
from lineagelake.llm.exact_dedup import BUCKETS, SLOTS, CuckooFilter, CuckooIndex, Shard, digests, exact_duplicates

SCHEMA = "doc_id long, text string, digest string, keep_id int, kept string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[lowered(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lowered(t)).hexdigest()))
    return sorted(out, key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def test_groups_equal_a_dictionary(spark):
    """Nulls, empty texts, case of A-Z only, ties, repeated rows, a hot text, a very long one."""
    rows = [(i, "the same Text") for i in range(400)] + [(1000 + i, f"text {i % 90}") for i in range(300)]
    rows += [(1, None), (2, ""), (None, ""), (None, "alone"), (None, "ALONE"), (5, "É"), (6, "é"), (7, "A" * 3_000_000), (8, "a" * 3_000_000), (9, "a" * 2_999_999), (9, "the same text"), (9, "the same text")]
    random.Random(3).shuffle(rows)
    got = sorted((tuple(r) for r in exact_duplicates(docs(spark, rows)).collect()), key=repr)
    assert got == plain(rows)
    assert exact_duplicates(docs(spark, [])).collect() == []


def test_many_shards_and_resizing(spark):
    rows = [(i, f"text {i % 9000}") for i in range(12_000)]
    got = sorted((tuple(r) for r in exact_duplicates(docs(spark, rows), shard_rows=100_000).collect()), key=repr)
    assert got == plain(rows)
    index = CuckooIndex(spark, scratch(spark, "test-index"), 1)  # one shard has to grow
    index.insert(digests(docs(spark, rows)))
    filters = index.state().where("kind = 0").collect()
    assert [r.buckets for r in filters] == [BUCKETS * 4] and len(filters[0].digest) == 2 * SLOTS * BUCKETS * 4
    assert index.keys().count() == 9000


def test_insertion_deletion_and_lookup_over_versions(spark):
    index = CuckooIndex(spark, scratch(spark, "test-index"), 3)
    texts = lambda rows: digests(docs(spark, rows))
    sha = lambda t: hashlib.sha256(lowered(t)).digest()
    live = lambda: {bytes(r.digest): (r.keep_id, r.copies) for r in index.keys().collect()}
    assert live() == {}
    index.insert(texts([(1, "a"), (2, "b"), (3, "A"), (None, "c")]))
    assert live() == {sha("a"): (3, 2), sha("b"): (2, 1), sha("c"): (None, 1)}
    index.insert(texts([(9, "B"), (0, "a"), (4, "c"), (5, "d")]))
    assert live() == {sha("a"): (3, 3), sha("b"): (9, 2), sha("c"): (4, 2), sha("d"): (5, 1)}
    index.delete(texts([(77, "a"), (78, "never there")]))
    assert live() == {sha("b"): (9, 2), sha("c"): (4, 2), sha("d"): (5, 1)} and index.version == 3
    assert {bytes(r.digest) for r in index.lookup(texts([(1, "a"), (2, "b"), (3, "b"), (4, "new")])).collect()} == {sha("b")}
    index.insert(texts([(6, "a")]))  # deleted, so new again
    assert live()[sha("a")] == (6, 1)
    index.insert(texts([]))
    assert len(live()) == 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=200))
def test_a_shard_behaves_as_a_dictionary(steps):
    shard, want = Shard(0), {}
    for insert, k in steps:
        d = hashlib.sha256(bytes([k])).digest()
        if insert:
            shard.insert(d, 1, k, 1)
            want[d] = want.get(d, 0) + 1
        else:
            assert shard.delete(d, 1) == (want.pop(d, None) is not None)
    assert {k[0]: k[3] for own in shard.keys.values() for k in own} == want
    marks = sum(1 for x in shard.filter.table if x)
    assert marks == len(want)  # nothing is left behind by deletion
    assert all(shard.find(d, 1) for d in want) and all(shard.filter.holds(*shard.filter.places(d)) for d in want)


def test_a_false_hit_is_told_from_a_live_text():
    """Digests of one fingerprint and one bucket, more of them than two buckets hold."""
    same = [b"\x07\x00" + b"\x01\0\0\0\0\0" + bytes([k]) * 24 for k in range(2 * SLOTS)]
    shard = Shard(0)
    for k, d in enumerate(same[:-1]):
        assert shard.find(d, 5) is None
        shard.insert(d, 5, k, 1)
        assert shard.find(d, 4) is None and shard.find(d, 5)[2] == k
    assert shard.find(same[-1], 5) is None and shard.filter.holds(*shard.filter.places(same[-1]))
    assert shard.delete(same[0], 5) and shard.find(same[0], 5) is None and shard.find(same[1], 5)[2] == 1


def test_overflow_is_reported_and_mended():
    digests_ = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    small = CuckooFilter(4)
    assert not all(small.put(*small.places(d)[:2]) for d in digests_[:20])  # 16 slots
    shard = Shard(0)
    for k, d in enumerate(digests_):
        shard.insert(d, 1, k, 1)
    assert shard.filter.buckets > BUCKETS and all(shard.find(d, 1)[2] == k for k, d in enumerate(digests_))
