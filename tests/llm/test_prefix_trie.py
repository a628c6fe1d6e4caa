import hashlib
import random
import zlib

import pytest

from brindle.llm import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple((convs.get(base, [])[:h] if rebuild else []) + own[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = {k: [x for x in nodes if len(x) == len(k) + 1 and x[:-1] == k] for k in nodes}
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = sorted(c for c in members if len(paths[c]) == len(k))
        out.append(
            (min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), sum(not kids[x] for x in below),
             sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(out, key=repr)


def got(spark, rows, rebuild=True, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, node string, depth int")
    turns = prefix_trie.rebuilt(df) if rebuild else prefix_trie.plain(df)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(turns, **options).collect()), key=repr)


def made(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-120, 700), n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 7, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "längere 😀 Zeile", "a"])))
    rows += rows[:20] + [(None, 0, "user", "lost"), (5000, None, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(7)]  # a group of equal conversations
    rows += [(900, t, "user", str(t % 3)) for t in range(300)]  # a long one
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_tries_by_brute_force(spark, seed):
    rows = made(seed)
    assert got(spark, rows) == brute(rows)


def test_partial_tries_merge_to_the_same_whole(spark, monkeypatch):
    rows = made(3, 150)
    want = brute(rows, rebuild=False)
    assert got(spark, rows, rebuild=False, tasks=1) == want
    assert got(spark, rows, rebuild=False, tasks=11, fan=2) == want


def test_small_tables_of_a_task(spark, monkeypatch):
    # Tries are given out after every few nodes, and lists of ends after two conversations.
    monkeypatch.setattr(prefix_trie, "LOCAL_NODES", 5)
    monkeypatch.setattr(prefix_trie, "LIST", 2)
    rows = made(4, 120)
    assert got(spark, rows, tasks=3, fan=2) == brute(rows)


def test_turnless_and_empty(spark):
    assert got(spark, []) == []
    rows = [(c, 0, "user", "x") for c in (101, 102, 103, 104, 105, 106, 107)]
    assert got(spark, rows) == brute(rows)
