import random

import numpy as np
import pytest

from brindle.llm import paragraph_dedup as pd_
from brindle.llm.shingles import windows, words

rng = random.Random(8)


def prose(n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_places_by_brute_force():
    r = np.random.default_rng(1)
    for _ in range(200):
        keys = r.integers(0, r.choice([3, 50, 10**9]), r.integers(1, 80)).astype(np.uint64)
        got = pd_.places(keys, 9, 6, 5)
        n = len(keys) - 4
        want = set()
        if 0 < n <= 6:
            want = {max(i for i in range(n) if keys[i] == keys[:n].min())}
        for i in range(max(0, n - 5)):
            run = keys[i : i + 6]
            want.add(max(k for k in range(i, i + 6) if keys[k] == run.min()))
        assert set(got.tolist()) >= want and all(0 <= p < n for p in got.tolist())
        if len(set(keys.tolist())) == len(keys):
            assert set(got.tolist()) == want


def test_places_of_many_texts_are_those_of_each():
    r = np.random.default_rng(2)
    for _ in range(200):
        sizes = r.integers(0, 60, r.integers(1, 9))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        hashes = r.integers(0, r.choice([4, 1 << 60]), int(offsets[-1])).astype(np.uint64)
        got = pd_.places_of_texts(windows(hashes, 5), offsets, 9, 6).tolist() if len(hashes) >= 9 else []
        want = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= 9:
                want += (pd_.places(windows(hashes[a:b], 5), 9, 6, 5) + a).tolist()
        assert got == want


def test_shared_passages_share_a_paragraph():
    parts = pd_.Paragraphs()
    for _ in range(60):
        passage = prose(rng.randint(pd_.SIZE + pd_.STEP - 1, 90))
        a, b = (" ".join(prose(rng.randint(0, 70)) + passage + prose(rng.randint(0, 70))) for _ in range(2))
        pa_, pb = parts.of(a.encode()), parts.of(b.encode())
        assert set(pa_[1].tolist()) & set(pb[1].tolist())


@pytest.fixture(scope="module")
def corpus():
    passage, other = prose(60), prose(55)
    edited = list(other)
    edited[50] = "changed"
    rows = [(k, " ".join(prose(rng.randint(30, 120))), "x") for k in range(40)]
    for k in range(50, 60):
        rows.append((k, " ".join(prose(33) + passage + prose(41)), "x"))
    rows += [(70, " ".join(prose(20) + other + prose(20)), "x"), (71, " ".join(prose(31) + edited + prose(9)), "x")]
    rows += [(80, None, "x"), (81, "", "x"), (82, "short text", "x"), (82, "short text", "x"), (83, "short text", "x"), (None, " ".join(passage), "x"), (90, " ".join(prose(40_000)), "x")]
    return passage, rows


@pytest.mark.parametrize("sizes", [{}, {"large": 4, "block": 3}])
def test_passages(spark, corpus, sizes):
    passage, rows = corpus
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(4)
    found = pd_.duplicates(df, **sizes)
    got = pd_.spans(found, df).collect()
    flagged = {r.doc_id for r in got}
    assert {*range(50, 60), 70, 71, None} <= flagged and not flagged & {*range(40), 80, 81, 82, 83, 90}
    assert {r.doc_id for r in got if r.kept} >= {50, 70} and not any(r.kept for r in got if r.doc_id in (51, 59, None))
    assert len({r.passage for r in got if r.doc_id in range(50, 60)}) == 1
    out = {r.doc_id: r.text for r in pd_.remove(df, found).collect()}
    text = " ".join(passage)
    assert text in out[50] and all(text not in out[k] for k in range(51, 60))
    assert all(out[k] == t for k, t, _ in rows if k is not None and k not in flagged)
    assert pd_.remove(df, found).columns == df.columns
    # What is cut is what the spans say, and only that.
    texts = {k: t for k, t, _ in rows}
    for k in range(51, 60):
        gone = sum(r.end_word - r.start_word for r in got if r.doc_id == k and not r.kept)
        assert len(out[k].split()) == len(texts[k].split()) - gone and gone >= pd_.SIZE


def test_paragraphs_by_brute_force(spark):
    """All paragraphs of the data, compared by an index of their shingles: nothing else is found, and hardly any is missed."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parts, places, sets = pd_.Paragraphs(), {}, {}
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    for doc, text in texts.items():
        at, whole, _ = parts.of(text)
        shingles = windows(words(text)[2], 5)
        for s, w in zip(at.tolist(), whole.tolist()):
            places.setdefault(w, []).append((doc, s))
            sets[w] = set(shingles[s : s + 20].tolist())
    holders, up = {}, {w: w for w in sets}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for w, shingles in sets.items():
        shared = {}
        for x in shingles:
            for other in holders.setdefault(x, []):
                shared[other] = shared.get(other, 0) + 1
            holders[x].append(w)
        for other, n in shared.items():
            if n >= 0.8 * (len(shingles) + len(sets[other]) - n) - 1e-9:
                up[root(w)] = root(other)
    clusters = {}
    for w, at in places.items():
        clusters.setdefault(root(w), []).extend(at)
    want = {x for at in clusters.values() if len({d for d, _ in at}) > 1 or max(s for _, s in at) - min(s for _, s in at) >= pd_.SIZE for x in at}
    exact = {x for at in places.values() if len({d for d, _ in at}) > 1 or max(s for _, s in at) - min(s for _, s in at) >= pd_.SIZE for x in at}
    rows = pd_.duplicates(df).collect()
    of = {(w, x) for w, at in places.items() for x in at}
    found = {(r.doc_id, r.start) for r in rows if r.words == pd_.SIZE and (r.paragraph, (r.doc_id, r.start)) in of}
    assert exact <= found <= want and len(found) >= 0.95 * len(want)
    # What is cut occurs before, but for edits: at least 0.8 of its shingles are at an earlier place.
    first = {}
    for doc in sorted(texts):
        for k, x in enumerate(windows(words(texts[doc])[2], 5).tolist()):
            first.setdefault(x, (doc, k))
    for r in (r for r in rows if not r.kept):
        own = windows(words(texts[r.doc_id])[2], 5)[r.start : r.start + r.words - 4].tolist()
        assert sum(first[x] < (r.doc_id, r.start + k) for k, x in enumerate(own)) >= 0.8 * len(own)


def test_empty_and_cut(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert pd_.spans(pd_.duplicates(df), df).collect() == []
    text = " ".join(prose(80))
    whole = windows(words(text.encode())[2], 24).view(np.int64).tolist()
    assert pd_.without(text, [0, 10], [whole[0], whole[10]], 24) == " ".join(text.split()[34:])
    assert pd_.without(text, [5], [whole[6]], 24) == text


def test_exact_copies_go_whole(spark):
    passages, rows = [prose(n) for n in (55, 55, 55, 60, 83, 100, 200, 30, 24, 800)], []
    for k, p in enumerate(passages):
        rows.append((2 * k, " ".join(prose(37 + k) + p + prose(29))))
        rows.append((2 * k + 1, " ".join(prose(20) + p + prose(3 * k))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = pd_.duplicates(df)
    out, texts = {r.doc_id: r.text for r in pd_.remove(df, found).collect()}, dict(rows)
    got = {(r.doc_id, r.kept): (r.start_word, r.end_word) for r in pd_.spans(found, df).collect()}
    for k, p in enumerate(passages):
        assert out[2 * k] == texts[2 * k]
        start, end = got[2 * k + 1, False]
        # Similar paragraphs, and those similar to them, may stand out by some words.
        assert 12 <= start <= 20 and 0 <= end - 20 - len(p) <= 8
        kept_start, kept_end = got[2 * k, True]
        assert kept_start <= 37 + k and kept_end >= 37 + k + len(p)
        words_ = texts[2 * k + 1].split()
        assert out[2 * k + 1].split() == words_[:start] + words_[end:]


def test_edited_passages_at_every_place(spark):
    cases = [(60, [k]) for k in range(60)] + [(49, [24]), (100, [20, 75]), (100, [33, 66]), (100, [5, 94]), (150, [30, 70, 110])]
    rows, places = [], {}
    for k, (n, edits) in enumerate(cases):
        p = prose(n)
        changed = ["x" + w if i in edits else w for i, w in enumerate(p)]
        a, b = ({tuple(q[i : i + 5]) for i in range(n - 4)} for q in (p, changed))
        assert len(a & b) >= 0.8 * len(a | b)
        rows += [(2 * k, " ".join(prose(31) + p + prose(26))), (2 * k + 1, " ".join(prose(23) + changed + prose(30)))]
        # Less than a shingle between an edit and the end of the passage stays.
        places[2 * k + 1] = (23 + max([e + 1 for e in edits if e < 5], default=0), 23 + min([e for e in edits if n - e <= 5], default=n))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    gone = {}
    for r in pd_.spans(pd_.duplicates(df), df).filter("not kept").collect():
        gone.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert {k for k, (a, b) in places.items() if not set(range(a, b)) <= gone.get(k, set())} == set()
    assert all(k % 2 for k in gone)


def test_large_bands_keep_every_pair(spark):
    r = np.random.default_rng(3)
    sets, rows = [], []
    for k in range(300):  # pairs at 16 / 20 = 0.8, far from all others, in one band
        shared, own = r.integers(0, 1 << 63, 16), r.integers(0, 1 << 63, 4)
        for tail in (own[:2], own[2:]):
            sets.append(np.unique(np.concatenate((shared, tail)).astype(np.uint64)))
            rows.append((len(rows), sets[-1].tobytes()))
    lists = spark.createDataFrame([(k, bytearray(s)) for k, s in rows], "paragraph bigint, shingles binary")
    pairs = lists.selectExpr("7L band", "paragraph")
    got = {tuple(sorted(e)) for e in pd_.near_edges(pairs, lists, 0.8, 100, 64).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(300)}


def test_rows_are_judged_not_ids(spark):
    """Rows that share an id or have none, at any distance of the passage's places; equal rows go whole but for one."""
    passage = prose(80)
    for at in (0, 3, 5, 12, 23, 24, 60):
        rows = [(4, " ".join(prose(10) + passage + prose(30)), "a"), (4, " ".join(prose(10 + at) + passage + prose(30)), "b")]
        rows += [(9, " ".join(prose(50)), "c")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        found = pd_.duplicates(df)
        out = {r.lang: r.text for r in pd_.remove(df, found).collect()}
        left = [len(out[k].split()) for k in "ab"]
        assert sorted(x - n for x, n in zip(left, (40, 40 + at))) == [0, 80] and out["c"] == rows[2][1]
        assert sorted((r.doc_id, r.kept, r.end_word - r.start_word) for r in pd_.spans(found, df).collect()) == [(4, False, 80), (4, True, 80)]
    same = " ".join(prose(120))
    rows = [(None, same, "y"), (None, same, "x"), (None, same, "z"), (None, "few words", "p"), (None, "few words", "q"), (7, " ".join(prose(40)), "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    found = pd_.duplicates(df)
    assert sorted(r.lang for r in pd_.remove(df, found).collect()) == ["p", "q", "r", "x"]
    assert sorted((r.doc_id, r.kept, r.start_word, r.end_word) for r in pd_.spans(found, df).collect()) == [(None, False, 0, 120), (None, False, 0, 120), (None, True, 0, 120)]


def test_seeds_are_dealt_once_and_looked_up_without_a_sort(spark):
    found = spark.createDataFrame([(1, 0, 7, 0), (2, 5, 7, 0), (3, 0, 8, 0)], "doc_id bigint, start int, seed bigint, around bigint")
    rows = pd_.repeated_seeds(found)
    assert [(r.doc_id, r.start, tuple(r.place)) for r in rows.collect()] == [(2, 5, (1, 0, 7))]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [seed" in plan and plan.count("strategy=shuffle_hash") >= 2


def test_runs_by_their_ends(spark):
    place = lambda k: (9, k, 100 + k)
    starts = [0, 5, 12, 24, 40, 52, 90]
    rows = spark.createDataFrame([(1, 0, s, place(s)) for s in starts], "doc_id bigint, text bigint, start int, place struct<r_doc: bigint, r_start: int, seed: bigint>")
    got = sorted((r.start, r.end, tuple(r.low), tuple(r.high)) for r in pd_.runs(rows).collect())
    assert got == [(0, 36, place(0), place(24)), (40, 64, place(40), place(52)), (90, 102, place(90), place(90))]


def test_seeds_that_occur_once_are_left_out(spark):
    """Rows of a key stay together over the borders of batches and tasks, however often the key occurs; the sort is of that number alone."""
    r = np.random.default_rng(4)
    keys = [*r.integers(-40, 40, 60).tolist(), *range(1000, 1300), *[7] * 90]
    df = spark.createDataFrame([(k, int(x)) for k, x in enumerate(keys)], "row bigint, seed bigint").repartition(3)
    want = sorted(k for k, x in enumerate(keys) if keys.count(x) > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = pd_.recurring(df, "seed")
        assert sorted(x.row for x in found.collect()) == want
        assert pd_.recurring(df.filter("false"), "seed").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [seed" in plan and "RepartitionByExpression [seed" in plan


def test_shingles_of_wanted_paragraphs_come_from_one_text(spark):
    """Texts are read together and not sorted; a run of words that reaches from one into the next is no paragraph."""
    texts = [" ".join(prose(40)), None, " ".join(prose(30)), "few words", " ".join(["same"] * 30)]
    hashes = [words((t or "").encode())[2] for t in texts]
    whole = [windows(h, 24).view(np.int64) for h in hashes]
    across = int(windows(np.concatenate((hashes[0], hashes[2])), 24).view(np.int64)[30])
    wanted = [(int(whole[0][16]), 0), (int(whole[2][0]), 2), (int(whole[4][3]), 4), (across, 0), (5, 1), (6, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    lists = pd_.shingle_lists(docs, spark.createDataFrame(wanted, "paragraph bigint, doc_id bigint"), pd_.Paragraphs())
    got = {r.paragraph: bytes(r.shingles) for r in lists.collect()}
    own = lambda k, at: np.unique(windows(hashes[k], 5)[at : at + 20]).tobytes()
    assert got == {int(whole[0][16]): own(0, 16), int(whole[2][0]): own(2, 0), int(whole[4][3]): own(4, 3)}
    assert len(own(4, 3)) == 8 and "strategy=shuffle_hash" in lists._jdf.queryExecution().optimizedPlan().toString()


def test_few_sets_are_linked_as_many_are():
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 40, (3, 20))
    for n in range(1, 25):
        sets = []
        for k in r.integers(0, 3, n):
            x = base[k].copy()
            x[: r.integers(0, 4)] = r.integers(0, 1 << 40)
            sets.append(np.unique(x).astype(np.uint64))
        near = pd_.similar(sets, 0.8)
        edges = pd_.few_edges([frozenset(x.tolist()) for x in sets], 0.8)
        many = pd_.forest(n, lambda i, others: near[i, others])
        label = lambda pairs: [min(c) for k in range(n) for c in [_reached(k, pairs)]]
        assert all(near[i, j] for i, j in edges) and len(edges) == len(many) and label(edges) == label(many)


def _reached(k, pairs):
    seen = {k}
    while more := {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in seen} - seen:
        seen |= more
    return seen


def test_reach_passes_the_fewest_words():
    """Of all ways over an edit the one with the fewest words passed by on both sides, then the most even, then the fewest of the first text."""

    def plainly(a, b, shingle=5, gap=8):
        same = lambda i, j: next((n for n in range(60) if i + n >= len(a) or j + n >= len(b) or a[i + n] != b[j + n]))
        n = same(0, 0)
        out, i, j, won = [(n, n, n)], n, n, n
        while True:
            ways = [(x + y, abs(x - y), x) for x in range(gap + 1) for y in range(gap + 1) if x + y and len(a[i + x : i + x + shingle]) == shingle and a[i + x : i + x + shingle] == b[j + y : j + y + shingle]]
            if not ways:
                return out
            t, _, x = min(ways)
            n = same(i + x, j + t - x)
            i, j, won = i + x + n, j + t - x + n, won + n - shingle + 1
            out.append((i, j, won))

    r = random.Random(3)
    for k in range(500):
        a = [r.randrange(3 if k % 2 else 40) for _ in range(r.randrange(48))]
        b = list(a)
        for _ in range(r.randrange(5)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(4)] = [r.randrange(40) for _ in range(r.randrange(4))]
        assert pd_.reach(a, b) == plainly(a, b)
