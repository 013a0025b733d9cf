import math
import random

import numpy as np
import pytest

from lineagelake.llm.common import stored
from lineagelake.llm.whitening import Whitening, column_blocks, covariance, gridded, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, component string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], SCHEMA)


def plain(rows, components=16):
    """numpy over all rows at once."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    x = np.array([x for _, x in good])
    return [i for i, _ in good], n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def check(spark, rows, tile):
    got = whiten(frame(spark, rows), tile=tile).collect()
    ids, n, far, white, explained = plain(rows)
    k = white.shape[1]
    assert len(got) == len(ids) * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for c in range(1, k + 1):
        want = sorted((i if i is not None else -1, int(d), w) for i, d, w in zip(ids, far, white[:, c - 1], strict=True))
        own = sorted((r.vec_id if r.vec_id is not None else -1, int(r.deviation), r.whitened) for r in got if r.component == c)
        assert [x[:2] for x in own] == [x[:2] for x in want]
        key = lambda x: x[:2]  # noqa: E731  repeated ids have equal or different deviations
        a, b = (np.array([x[2] for x in sorted(part, key=key)]) for part in (own, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8  # either sign
        assert all(abs(r.explained / explained[c - 1] - 1) < 1e-9 for r in got if r.component == c)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, width)) @ np.diag(np.linspace(3, 0.5, width))
    return [(i, [float(x) for x in row]) for i, row in enumerate(m)]


@pytest.mark.parametrize(("width", "tile"), [(20, 32), (20, 8), (5, 2)])
def test_equal_to_numpy(spark, width, tile):
    check(spark, vectors(300, width), tile)


def test_copies_nulls_and_odd_entries(spark):
    rows = vectors(200, 6)
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(150)] + [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [math.nan] * 6), (2004, [math.inf] * 6), (None, hot), (5, rows[9][1])]
    check(spark, rows, 4)


def test_without_variance_or_rows(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = whiten(frame(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0]), (4, [1.0])])).collect()
    assert {(r.vec_id, r.component) for r in flat} == {(1, 1), (2, 1), (3, 1)} and {r.explained for r in flat} == {1.0}


def test_tiles_make_the_covariance(spark):
    rows = vectors(500, 13)
    fit = stored(gridded(frame(spark, rows)).select("x").repartition(5), "fit")
    x = np.array([r.x for r in fit.collect()])
    for tile in (13, 5, 1):
        blocks = stored(column_blocks(fit, 13, tile), "blocks")
        assert np.allclose(covariance(blocks, len(x), x.sum(0).tolist(), tile), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)


def test_deviation_is_exact_at_any_size():
    rng = random.Random(5)
    x = [[rng.randrange(10**6) for _ in range(4)] for _ in range(5)]
    for n in (3, 10**6, 10**13):
        sums = [rng.randrange(n * 10**6) for _ in range(4)]
        want = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        assert [int(d) for d in Whitening(n, sums, None, None, None).deviation(np.array(x))] == want
