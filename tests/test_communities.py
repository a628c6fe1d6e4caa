"""Communities against plain Python: modularity near a sequential run's, connected, small enough."""

import random
from collections import defaultdict

import pytest

from brindle.operators import communities as C

SCHEMA = "src string, dst string"


def graph(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def quality(near, label):
    m2 = sum(map(len, near.values()))
    tot, inside = defaultdict(int), 0
    for a in near:
        tot[label[a]] += len(near[a])
        inside += sum(label[a] == label[b] for b in near[a])
    return inside / m2 - sum(t * t for t in tot.values()) / m2**2


def sequential(near):
    """Local moving and aggregation, one node after the other."""
    w = {a: {b: 1.0 for b in bs} for a, bs in near.items()}
    m2, named = sum(map(len, near.values())), {a: a for a in near}
    while True:
        label = {a: a for a in w}
        k = {a: sum(w[a].values()) for a in w}
        tot, moved = dict(k), True
        any_moved = False
        while moved:
            moved = False
            for a in sorted(w):
                to = defaultdict(float)
                for b, x in w[a].items():
                    if b != a:
                        to[label[b]] += x
                tot[label[a]] -= k[a]
                gains = {c: x - k[a] * tot[c] / m2 for c, x in to.items()}
                gains.setdefault(label[a], -k[a] * tot[label[a]] / m2)
                best = max(gains, key=lambda c: (round(gains[c], 9), c == label[a], c))
                moved |= best != label[a] and gains[best] > gains[label[a]] + 1e-9
                any_moved |= moved
                label[a] = best
                tot[best] += k[a]
        named = {a: label[c] for a, c in named.items()}
        if not any_moved:
            return named
        up = defaultdict(lambda: defaultdict(float))
        for a in w:
            for b, x in w[a].items():
                up[label[a]][label[b]] += x
        w = up


def run(spark, pairs, most=None):
    rows = C.communities_within(spark.createDataFrame(pairs, SCHEMA), most).collect()
    label = {r.node: r.label for r in rows}
    near = graph(pairs)
    assert len(rows) == len(label) == len(near)
    for c in set(label.values()):
        members = {a for a in label if label[a] == c}
        seen, todo = set(), [min(members)]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += near[a] & members
        assert seen == members and c == min(members)  # connected, and named by its least node
        assert most is None or len(members) <= most
    return near, label


def clique(p, n):
    return [(f"{p}{i:02}", f"{p}{j:02}") for i in range(n) for j in range(i)]


def test_two_cliques_and_a_bridge(spark):
    pairs = clique("a", 10) + clique("b", 10) + [("a00", "b00")]
    for most in (None, 15):
        _, label = run(spark, pairs, most)
        assert len({label[f"a{i:02}"] for i in range(10)}) == len({label[f"b{i:02}"] for i in range(10)}) == 1 and label["a00"] != label["b00"]


@pytest.mark.parametrize("seed", [2])
def test_modularity_of_planted_groups(spark, seed):
    rng = random.Random(seed)
    nodes = [f"g{g}n{i}" for g in range(7) for i in range(12)]
    pairs = [(a, b) for a in nodes for b in nodes if a < b and rng.random() < (0.5 if a[:2] == b[:2] else 0.02)]
    near, label = run(spark, pairs + pairs[:20] + [(nodes[0], nodes[0])])
    assert quality(near, label) >= 0.98 * quality(near, sequential(near))


def test_large_communities_are_parted(spark):
    # A star can't be parted by modularity, a clique neither; both have to be cut, into connected pieces.
    star = [("hub", f"leaf{k:02}") for k in range(25)]
    near, label = run(spark, star + clique("c", 20) + [("hub", "c00")], 15)
    sizes = sorted(list(label.values()).count(c) for c in set(label.values()))
    assert sizes[-1] <= 15 and sum(s for s in sizes if s >= 3) >= 20


def test_suppliers(spark):
    from brindle.plans.graph_queries import edges

    e = edges(spark, "/root/testdata/sf0.01").select("src", "dst")
    pairs = [tuple(r) for r in e.collect()]
    near, label = run(spark, pairs)
    assert quality(near, label) >= 0.98 * quality(near, sequential(near))
    assert abs(C.modularity(C.simple_links(e), spark.createDataFrame(list(label.items()), "node string, label string")) - quality(near, label)) < 1e-9


def test_no_edges(spark):
    assert C.communities_within(spark.createDataFrame([], SCHEMA), 15).collect() == []
    assert C.communities_within(spark.createDataFrame([("a", "a")], SCHEMA)).collect() == []
