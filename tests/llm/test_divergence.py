import random
import re
from collections import Counter, defaultdict

import numpy as np

from brindle.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, least, top):
    docs = [(l or "", s or "", [lowered(t) for t in TERM.findall(x or "")]) for x, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for l, _, ts in docs if l == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for l, s, ts in docs:
            if l == lang:
                counts[s].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in counts:
            pairs = [(-sum((p(counts[s], t) - p(counts[o], t)) ** 2 // p(counts[o], t) for t in kept), o) for o in counts if o != s]
            terms = [(-((p(counts[s], t) - p(whole, t)) ** 2 // p(whole, t)), t) for t in kept if counts[s][t] and p(counts[s], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, -v, rank))
    return sorted(out)


def rows_of(spark, rows, **options):
    df = spark.createDataFrame([(x, l, s, "clash", 1) for x, l, s in rows], "text string, lang string, source string, term string, n int")
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def made(n=120):
    rng = random.Random(4)
    words = ["Élan", "élan", "STRASSE", "strasse", "naïve", "a", "b-c", "x1y", "漢字", "d" * 300, "e" * 9, "e" * 8, "e" * 16, "e" * 17]
    rows = [(" ".join(rng.choices(words + [f"w{'abcdefgh'[k]}{'xyz'[j]}" for k in range(8) for j in range(3)], k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "s4"])) for _ in range(n)]
    return rows + [(None, "en", "s9"), ("", "only", "s1"), (None, "two", "a"), ("1 2 3", "two", "b"), ("Rare", "one", "z"), ("q" * 5000 + " q", "en", "s1")] + [rows[0]] * 3


def test_audit_by_brute_force(spark):
    rows = made()
    assert rows_of(spark, rows) == brute(rows, 3, 200)
    # Small buckets and blocks: sources of one language fall in several cells; few terms are listed.
    assert rows_of(spark, rows, top=3, bucket=7, block=2) == brute(rows, 3, 3)
    assert rows_of(spark, rows, least=200) == brute(rows, 200, 200)


def test_no_rows(spark):
    assert rows_of(spark, []) == []


def test_bounds_and_slices():
    texts = ["ab", "CD ef", "", "é1é", "x" * 1000, "x" * 999 + "y"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    low, starts, ends = divergence.term_bounds(np.frombuffer(data, np.uint8), offsets)
    want = [lowered(w).encode() for t in texts for w in TERM.findall(t)]
    assert [low[a:b].tobytes() for a, b in zip(starts, ends)] == want


def test_slices_of_equal_hashes_are_told_apart():
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 300]))) for _ in range(400)] + ["a" * 16, "a" * 17] * 3
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    low, starts, ends = divergence.term_bounds(data, np.array([0, len(data)]))
    for digest in (lambda b: 7, lambda b: len(b), lambda b: hash(b) & 0xFFFF):
        code, slices = divergence.grouped_slices(low, starts, ends, digest)
        names = [low[starts[i] : ends[i]].tobytes().decode() for i in slices]
        assert [names[c] for c in code] == words and len(set(names)) == len(names) == len(set(words))


def test_shares_are_exact_for_great_counts(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (5, 7, 3), (8 * 10**14, 9 * 10**14, 10**9), (3, 9 * 10**14, 10**12)]
    df = spark.createDataFrame(cases, "n bigint, total bigint, v bigint")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in cases]
