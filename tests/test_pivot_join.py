"""The threshold join by pivots gives the answers of all pairs, and compares few of them where vectors have groups."""

import numpy as np
import pytest

from brindle.operators import pivot_join as P

SCHEMA = "vec_id int, ts int, scope string, embedding array<double>, label int"


def all_pairs(rows, least):
    out = []
    usable = [r for r in rows if r[3] is not None and r[3] and all(x is not None and np.isfinite(x) for x in r[3]) and r[1] is not None and r[2] is not None]
    for i, t, s, v, _ in usable:
        found = [(-round(float(np.dot(v, w)), 12), j) for j, u, z, w, _ in usable if z == s and u < t and len(w) == len(v)]
        found = [f for f in found if -f[0] >= least]
        if found:
            out.append((i, min(found)[1], -min(found)[0]))
    return sorted(out)


def grouped(rng, n, groups, size=24, spread=0.02, scale=False):
    centres = rng.normal(0, 1, (groups, size))
    x = centres[rng.integers(0, groups, n)] / np.sqrt(size) + rng.normal(0, spread, (n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * rng.uniform(0.5, 1.5, (n, 1)) if scale else x


@pytest.mark.parametrize("least,scale", [(0.96, False), (0.9, True), (0.3, False), (-0.2, True)])
def test_equals_all_pairs(spark, monkeypatch, least, scale):
    monkeypatch.setattr(P, "CELL_ROWS", 8)
    monkeypatch.setattr(P, "BLOCK", 11)
    rng = np.random.default_rng(5)
    x = grouped(rng, 260, 9, scale=scale)
    rows = [(k, int(rng.integers(0, 90)), "big" if k % 3 else f"s{k % 7}", x[k].tolist(), k) for k in range(260)]
    rows += [(900, 5, "big", None, 0), (901, 95, "big", [0.0] * 24, 0), (902, 95, "big", [None] * 24, 0), (903, 95, "big", [float("nan")] * 24, 0), (904, 95, "big", [], 0)]
    rows += [(905, 1, "big", [1.0, 0.0], 0), (906, 2, "big", [1.0, 0.0], 0), (907, None, "big", x[0].tolist(), 0), (908, 95, None, x[0].tolist(), 0), (909, 99, "big", x[1].tolist(), 1)]
    got = P.cached_answers(spark.createDataFrame(rows, SCHEMA), least)
    assert got.columns == ["vec_id", "answered_by", "similarity"]
    want = all_pairs(rows, least)
    assert sorted((a, b, round(c, 9)) for a, b, c in map(tuple, got.collect())) == [(a, b, round(c, 9)) for a, b, c in want]
    assert len(want) > 100


def test_few_pairs_of_grouped_vectors_are_compared(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 16)
    x = grouped(np.random.default_rng(6), 1200, 40)
    rows = [(k, k, "one", x[k].tolist(), 0) for k in range(1200)]
    found = P.comparisons(spark.createDataFrame(rows, SCHEMA)).first()
    assert found["n"] == 1200 and 0 < found["pairs"] < 1200 * 1200 / 8


def test_nothing_to_compare(spark):
    assert P.cached_answers(spark.createDataFrame([], SCHEMA)).collect() == []
    assert P.cached_answers(spark.createDataFrame([(1, 1, "a", [0.0, 0.0], 0), (2, 2, "a", [0.0, 0.0], 0)], SCHEMA)).collect() == []
