"""Whitening against exact integers: nulls, non-finite entries, ties, repeats, other lengths, wide entries, an empty table, clashing columns."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from feedloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, id int, size string, x string, n int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", "t", 2, "u") for i, v in rows], SCHEMA)


def expected(rows, components=16):
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = defaultdict(set)
    for _, x in usable:
        fit[len(x)].add(tuple(x))
    out = []
    for i, x in usable:
        lists = sorted(fit[len(x)])
        n, dims = len(lists), len(x)
        sums = [sum(f[d] for f in lists) for d in range(dims)]
        out.append((i, n, sum((n * x[d] - sums[d]) ** 2 for d in range(dims)), dims, x, lists, sums))
    return out


def covariance(lists, sums):
    n, dims = len(lists), len(sums)
    return np.array([[sum((n * f[a] - sums[a]) * (n * f[b] - sums[b]) for f in lists) / n ** 3 for b in range(dims)] for a in range(dims)])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(20, 20)))[0]
    rows = [(i, (turn @ np.array([r.gauss(0, 3 / (k + 1)) for k in range(20)])).tolist()) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(40)] + [(i, rows[5][1]) for i in (600, 601, 601, None, None)]
    rows += [(700, None), (701, []), (702, [None] * 20), (703, [float("nan")] + [0.0] * 19), (704, [float("inf")] + [0.0] * 19), (705, [0.0] * 20)]
    rows += [(800 + i, [r.random(), r.random() * 5, r.random()]) for i in range(30)]
    return rows


def test_whitening_equals_brute_force(spark, rows):
    found = defaultdict(list)
    for r in whitening.whiten(frame(spark, rows)).collect():
        found[r.vec_id].append(r)
    want = expected(rows)
    assert sum(len(x) for x in found.values()) == sum(min(16, e[3]) for e in want)
    fits = {}
    for e in want:
        fits.setdefault(e[3], covariance(e[5], e[6]))
    values = {d: np.linalg.eigvalsh(v)[::-1] for d, v in fits.items()}
    whitened = defaultdict(dict)
    for i, n, deviation, dims, x, lists, sums in want:
        own = sorted((r for r in found[i] if r.n == n), key=lambda r: r.component)
        k = min(16, dims)
        assert [r.component for r in own[::len(own) // k]] == list(range(1, k + 1))
        assert {r.deviation for r in own} == {deviation} or i is None
        e, v = values[dims], fits[dims]
        assert np.allclose([r.explained for r in own[::len(own) // k]], (e / np.trace(v))[:k], rtol=1e-9)
        whitened[dims][tuple(x)] = [r.whitened for r in own[::len(own) // k]]
        assert all(r.identity_error < 1e-9 for r in own)
        # squared length in the components' space doesn't depend on signs
        c = np.array([(n * x[d] - sums[d]) / n for d in range(dims)])
        if k == dims:
            assert math.isclose(sum(w * w for w in whitened[dims][tuple(x)]), c @ np.linalg.inv(v) @ c, rel_tol=1e-9)
    for dims, v in fits.items():
        vectors = np.linalg.eigh(v)[1][:, ::-1][:, :16]
        lists = next(e[5] for e in want if e[3] == dims)
        sums = next(e[6] for e in want if e[3] == dims)
        c = np.array([[(len(lists) * f[d] - sums[d]) / len(lists) for d in range(dims)] for f in lists])
        mine = np.array([whitened[dims][f] for f in lists])
        truth = c @ vectors / np.sqrt(values[dims][:16])
        assert np.allclose(np.abs(np.sum(mine * truth, 0)), np.sum(truth * truth, 0), rtol=1e-8)
        assert np.abs(np.cov(mine.T, bias=True) - np.eye(mine.shape[1])).max() < 1e-9


@pytest.mark.parametrize("width", [3, 31, 62, 63])
def test_scatter_is_exact(width):
    r = random.Random(width)
    x = np.array([[r.randrange(-(1 << width), 1 << width) for _ in range(5)] for _ in range(131)], np.int64)
    sums, cross = whitening.scatter(x)
    assert list(sums) == [sum(int(v) for v in x[:, d]) for d in range(5)]
    assert all(cross[a, b] == sum(int(p) * int(q) for p, q in zip(x[:, a], x[:, b])) for a in range(5) for b in range(5))


def test_blocks_and_tasks_add_up(spark, rows):
    usable = whitening.quantised(frame(spark, rows).selectExpr("coalesce(vec_id, 0) as id", "embedding as v"), 64, 1_000_000).select("size", "x").distinct().repartition(5)
    whole, cut = whitening.totals(usable), whitening.totals(usable, block=7)
    assert all(whole[n][0] == cut[n][0] and (whole[n][1] == cut[n][1]).all() and (whole[n][2] == cut[n][2]).all() for n in whole) and set(whole) == {3, 20}


def test_wide_and_dependent_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1e16, 1.0]), (4, [2.0, 1.0])]
    found = sorted(whitening.whiten(frame(spark, rows)).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component, r.n) for r in found] == [(i, c, 4) for i in (1, 2, 3, 4) for c in (1, 2)]
    assert all(r.deviation is None and r.identity_error < 1e-9 and (r.whitened is None) == (r.component == 2) for r in found)
    assert whitening.integers(np.array([1e300, -1e300, 0.5, -0.001]), 64, 1_000_000).tolist() == [(1 << 63) - 1, -(1 << 63), 1_000_032, 999_999]


def test_one_vector_and_no_vector(spark):
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
