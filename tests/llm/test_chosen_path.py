import random

import numpy as np
import pytest

from brindle.llm import chosen_path, components, shingles
from brindle.llm.groups import intersections


def truth(rows, threshold=0.8):
    """(doc_id, class_id, n_links) by comparing every pair."""
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i in range(n):
        for j in range(i + 1, n):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], least.get(root(i)), links[i]) for i in range(n)), key=str)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(k, " ".join(word() for _ in range(rng.randint(30, 80)))) for k in range(60)]
    base = [word() for _ in range(100)]
    for k in range(100, 160):  # near copies, about the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(100)] = word()
        rows.append((k, " ".join(w)))
    rows += [(k, rows[3][1]) for k in range(200, 230)] + [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one\ttwo"), (305, "two one"), (3, rows[3][1]), (None, rows[5][1]), (None, "nobody else says this"), (7, "another text under an id in use")]
    rows.append((400, " ".join(word() for _ in range(30_000))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"leaf": 8, "block": 7, "block_tokens": 900}])
def test_all_links_by_brute_force(spark, sizes):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, node string").repartition(5)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_duplicates(df, **sizes).collect()), key=str)
    assert got == truth(rows)


def test_one_row_of_each_class(spark):
    a, b = ("alpha beta gamma delta epsilon " * 3).strip(), "zeta eta theta iota kappa lambda mu"
    rows = [(1, a), (None, a), (None, b), (None, b), (5, "one more text of its own words here"), (5, "and another under the same id"), (5, "and another under the same id"), (6, None), (6, None), (7, " \n"), (None, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, node string, id string").repartition(3)
    got = chosen_path.thinned(df)
    assert got.columns == df.columns
    want = [rows[0], rows[2], rows[4], rows[5], *rows[7:]]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert chosen_path.thinned(df.limit(0)).collect() == []


def test_data_by_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_duplicates(df).collect()), key=str)
    assert got == truth(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert chosen_path.near_duplicates(df).collect() == []
    assert components.components(df.selectExpr("doc_id a", "doc_id b")).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    up = {v: v for e in edges for v in e}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7))
    assert {(r.vertex, r.component) for r in got.collect()} >= {(v, root(v)) for v in up if any(v in e and e[0] != e[1] for e in edges)}
    assert got.count() == got.select("vertex").distinct().count()


def test_shingles_and_intersections():
    text = "a bb\tccc\ndd e  f ".encode()
    s, e, h = shingles.words(text)
    assert [text[i:j] for i, j in zip(s, e)] == text.split() and len(set(h.tolist())) == 6
    again = shingles.words(b"zz  " + text)
    assert again[2][1:].tolist() == h.tolist()
    old, shingles._SLICE = shingles._SLICE, 3
    try:
        assert shingles.words(text)[2].tolist() == h.tolist() and shingles.words(text)[0].tolist() == s.tolist()
    finally:
        shingles._SLICE = old
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert intersections(sets).tolist() == want and intersections(sets[:2]).tolist() == [r[:2] for r in want[:2]]


def test_runs():
    assert chosen_path.meeting_chance(0.8, 1) == pytest.approx(0.84)
    assert (1 - chosen_path.meeting_chance(0.8, 2)) ** chosen_path.runs_for(0.8, 0.9999, 2) <= 1e-4


def test_runs_follow_the_depth(spark, monkeypatch):
    r = np.random.default_rng(5)
    values = r.integers(0, 2, (600, chosen_path.COORDINATES)).astype("<u4")  # every level halves a bucket
    nodes = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(values)], "node bigint, coordinates binary")
    calls, leaves = [], chosen_path.leaves

    def noted(nodes, runs, leaf, done):
        calls.append((runs, done, out := leaves(nodes, runs, leaf, done)))
        return out

    monkeypatch.setattr(chosen_path, "leaves", noted)
    chosen_path.repeated_leaves(nodes, 0.8, 0.99, 40)
    depth, total = max(len(x[2]) for x in calls), sum(x[0] for x in calls)
    assert depth > 2 and (1 - chosen_path.meeting_chance(0.8, depth)) ** total <= 0.01
    assert [x[1] for x in calls] == [sum(x[0] for x in calls[:k]) for k in range(len(calls))]


@pytest.mark.parametrize("n", [2, 3])
def test_links_with_more_blocks_than_members(spark, n):
    rows = []
    for c in range(8):
        base = np.random.default_rng(c).integers(0, 1 << 60, 400)
        rows += [(c, 100 * c + k, 1, 100 * c + k, bytearray(np.unique(base[k : k + 397].astype(np.uint64)).tobytes())) for k in range(n)]
    members = spark.createDataFrame(rows, "class bigint, node bigint, copies bigint, id bigint, shingles binary")
    got = chosen_path.exact_links(members, 0.8, block_tokens=200).groupBy("node").sum("links").collect()
    assert sorted(r[1] for r in got) == [n - 1] * 8 * n


def test_kept_row_of_equal_id_and_text_is_the_least(spark):
    """Rows of one id and text that differ in another column: the same one stays, however they are dealt."""
    from brindle.llm.chosen_path import thinned

    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, lang, "node") for lang in ("fr", "de", "en")] + [(2, text, "aa", "node"), (3, "other words here that stand alone", None, "x")]
    for parts in (1, 2, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, node string").repartition(parts)
        assert sorted((r.doc_id, r.lang or "") for r in thinned(df).collect()) == [(1, "de"), (3, "")]
