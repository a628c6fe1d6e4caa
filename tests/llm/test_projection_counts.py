import numpy as np
import pytest

from brindle.llm import projection_counts as pc


def brute(rows, threshold=0.95):
    """vec_id, n_links, component_id, kept by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = [[False] * len(rows) for _ in rows]
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[k][1], float) for k in (i, j))
            if i != j and len(a) == len(b):
                near[i][j] = (a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()) >= threshold
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if near[i][j] and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((key, sum(near[i]), least, key is not None and key == least))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id bigint, embedding array<double>, node string, ball int")
    return sorted((tuple(r) for r in pc.near_vectors(df, **options).collect()), key=repr)


def made(rng, n=250, groups=((60, 0.05), (40, 0.1), (7, 0.2), (3, 0.29)), size=32):
    rows = [rng.standard_normal(size) for _ in range(n)]
    for members, spread in groups:
        base = rng.standard_normal(size)
        base /= np.linalg.norm(base)
        rows += [base + spread * rng.standard_normal(size) / np.sqrt(size) for _ in range(members)]
    rows += rows[:5] + [2 * rows[0], 0.5 * rows[-1]]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


ODD = [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [None] + [1.0] * 31), (9004, [float("nan")] + [1.0] * 31), (9005, [float("inf")] * 32), (None, [1.0, 0.0]), (9006, [1.0, 0.001]), (9007, [1.0]), (9008, [-3.0]), (9009, [1e200, 1e-200]), (9010, [5e-324, 0.0])]


def test_links_by_brute_force(spark):
    rows = made(np.random.default_rng(1)) + ODD
    rows += [(3, rows[4][1])]  # an id again, with another's vector
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("dense, block", [(10_000, 16), (8, 16), (8, 5)])
def test_groups_dealt_in_blocks_and_balls(spark, dense, block):
    """The same links, whether groups are balls or pairs, in whole cells or in blocks."""
    rows = made(np.random.default_rng(2), n=60)
    assert got(spark, rows, dense=dense, block=block) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_recall_at_the_threshold(spark):
    """Pairs of a cosine just above 0.95, the hardest to find: the plan's recall holds, and nothing below is linked."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        a = rng.standard_normal(48)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(48)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        for j, c in enumerate((0.9501, 0.9499) if i % 2 else (0.9505, 0.94)):
            rows += [(4 * i + 2 * j, a.tolist()), (4 * i + 2 * j + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())] if j == 0 else [(4 * i + 3, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    links = {r[0]: r[1] for r in got(spark, rows)}
    want = {r[0]: r[1] for r in brute_counts(rows)}
    assert all(links[k] <= want[k] for k in links)
    assert sum(links.values()) >= 0.99 * sum(want.values())


def brute_counts(rows):
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    n = (v @ v.T >= 0.95).sum(axis=1) - 1
    return [(r[0], int(k)) for r, k in zip(rows, n)]


def test_plan_holds_its_recall():
    rng = np.random.default_rng(5)
    for n in (10, 1000, 50_000, 10**9):
        cuts, runs, window = pc.plan(n)
        d = np.sqrt(0.1)
        trials = 4000
        gaps = rng.standard_normal((trials, runs, cuts + 1)) * d
        places = rng.uniform(0, pc.WIDTH, (trials, runs, cuts))
        held = (np.floor((places + gaps[:, :, :-1]) / pc.WIDTH) == 0).all(axis=2) & (np.abs(gaps[:, :, -1]) <= window)
        assert (held.sum(axis=1) >= pc.COUNT).mean() >= 0.996
