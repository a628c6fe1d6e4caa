import itertools
import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import license_rules, rule_ensemble, string_tiling
from brindle.llm.queries_text import op8_rule_ensemble


# --- string tiling -------------------------------------------------------------------------------
def brute_tiles(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best, places = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n >= least and n > best:
                    best, places = n, [(i, j)]
                elif n == best and n:
                    places.append((i, j))
        if best < least:
            return out
        for i, j in sorted(places):
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_by_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        a = [rng.randint(1, 3) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(1, 3) for _ in range(rng.randint(0, 20))]
        assert string_tiling.tiles(a, b, 2) == brute_tiles(a, b, 2)


ITEM = "alpha beta gamma delta epsilon. zeta eta theta iota kappa, lambda mu nu xi omicron"
HALVES = ("zeta eta theta iota kappa lambda mu nu xi omicron", "alpha beta gamma delta epsilon")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "tiny item", "x")], "item_id bigint, text string, doc_id string")


@pytest.fixture(scope="module")
def leaks(spark):
    rows = [
        (1, f"before words {ITEM.upper()} after", "k"),
        (2, f"noise {HALVES[0]} and {HALVES[1]} end", "k"),  # reordered
        (3, "alpha beta gamma delta epsilon alone is a third", "k"),
        (4, None, "k"),
        (5, "", "k"),
        (6, "a tiny item here", "k"),
        (7, "nothing " * 30_000, "k"),
        (1, f"before words {ITEM.upper()} after", "k"),
        (None, ITEM, "k"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, coverage string")


def test_contaminated_by_both_ways(bench, leaks):
    want = [(-1, 1), (1, 1), (1, 1), (2, 1), (6, 3)]
    for limit in (1 << 20, 0):
        got = string_tiling.contaminated(leaks, bench, broadcast_bytes=limit).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == want
        kept = string_tiling.decontaminate(leaks, bench, broadcast_bytes=limit)
        assert kept.columns == leaks.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
        assert string_tiling.contaminated(leaks.limit(0), bench, broadcast_bytes=limit).count() == 0
        assert string_tiling.contaminated(leaks, bench.limit(0), broadcast_bytes=limit).count() == 0


def test_rows_not_ids_are_judged_by_both_ways(spark, bench):
    rows = [(None, ITEM), (None, "clean words that no item holds"), (4, "x " + ITEM), (4, "also clean words"), (4, "also clean words"), (5, None), (5, ITEM)]
    docs = spark.createDataFrame([(*r, "k", "m") for r in rows], "doc_id bigint, text string, key string, __row string")
    items = bench.unionByName(spark.createDataFrame([(None, "one item without an identifier has words", "x"), (1, ITEM, "x")], bench.schema))
    for limit in (1 << 20, 0):
        kept = string_tiling.decontaminate(docs, items, broadcast_bytes=limit)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
        found = string_tiling.contaminated(docs.unionByName(spark.createDataFrame([(6, "one item without an identifier has words", "", "")], docs.schema)), items, broadcast_bytes=limit)
        assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted([(None, 1), (None, 1), (4, 1), (4, 1), (5, 1), (5, 1), (6, None)], key=str)


def test_many_items_of_one_document_by_both_ways(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 5, 9]))) for _ in range(150)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(texts)), (2, " - ".join(texts[:70])), (3, "none of them")], "doc_id bigint, text string")
    got = [sorted(tuple(r) for r in string_tiling.contaminated(docs, items, broadcast_bytes=limit).collect()) for limit in (1 << 20, 0)]
    assert got[0] == got[1] and [r[:2] for r in got[0]] == [(1, k) for k in range(150)] + [(2, k) for k in range(70)]


def test_a_word_repeated_a_million_times():
    import resource
    import time

    bench = string_tiling.Benchmark([(1, "na " * 100), (2, "na na na na na batman")])
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert bench.matches("na " * 1_000_000, 0.6) == [(1, 1.0, 100, 100), (2, 5 / 6, 5, 5)]
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_contaminated_data_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in string_tiling.contaminated(docs, bench).collect()}
    want = set()
    items = [(r.item_id, string_tiling.words_of(r.text)) for r in bench.collect()]
    for r in docs.collect():
        w = string_tiling.words_of(r.text or "")
        seeds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for item_id, i in items:
            if any(tuple(i[k : k + 5]) in seeds for k in range(len(i) - 4)):
                t = brute_tiles(i, w, 5)
                if sum(n for _, _, n in t) >= 0.6 * len(i):
                    want.add((r.doc_id, item_id))
    assert got == want and got


# --- licences ------------------------------------------------------------------------------------
def test_licences():
    s = license_rules.Scanner()
    look = lambda t: [x for x, _ in s.licences(s.identifiers(t))]
    assert look("Some text.\nReleased under the MIT License.\nMore.") == ["MIT"]
    assert look("words before Licensed under CC BY-NC 4.0. words after") == ["CC-BY-NC-4.0"]
    assert look("This work is licensed under the GNU General Public License,  VERSION 3.") == ["GPL-3.0"]
    assert look("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at x") == ["Apache-2.0"]
    full = ". ".join(license_rules.SENTENCES[k][0] for k in ("bsd.use", "bsd.source", "bsd.binary", "bsd.endorse"))
    assert look(full) == ["BSD-3-Clause"] and look(full.rsplit(". ", 1)[0]) == ["BSD-2-Clause"]
    reordered = ". ".join(license_rules.SENTENCES[k][0] for k in ("bsd.binary", "bsd.source", "bsd.use"))
    assert look(reordered) == []
    assert look("All rights reserved. Released under the MIT License. Released under the MIT License.") == ["MIT", "All-Rights-Reserved"]
    for none in ("", "he reserved a licensed table", "mit license"):
        assert look(none) == []


@pytest.mark.parametrize("width", [20, 40, 72])
def test_wrapped_licences(width):
    s = license_rules.Scanner()
    look = lambda t: [x for x, _ in s.licences(s.identifiers(t))]
    texts = {
        "MIT": ("mit.grant", "mit.notice", "as.is"),
        "BSD-3-Clause": ("bsd.use", "bsd.source", "bsd.binary", "bsd.endorse"),
        "BSD-2-Clause": ("bsd.use", "bsd.source", "bsd.binary"),
        "GPL-3.0-or-later": ("gpl.free", "v3.later"),
        "LGPL-2.1-or-later": ("lgpl.free", "v2.1.later"),
        "AGPL-3.0-or-later": ("agpl.free", "v3.later"),
        "MPL-2.0": ("mpl.subject", "mpl.copy"),
        "ISC": ("isc.grant", "author.disclaims"),
        "Zlib": ("zlib.held", "zlib.origin"),
        "Unlicense": ("unlicense.free", "unlicense.anyone"),
    }
    for licence, names in texts.items():
        text = "Copyright (c) 2024 Some Holder. " + ". ".join(license_rules.SENTENCES[k][0] for k in names)
        assert look("\n".join("# " + line for line in textwrap.wrap(text, width))) == [licence]
        assert look("\r\n".join(textwrap.wrap(text, width))) == [licence]
    assert look("Copyright (c) 2024 X, All rights reserved") == ["All-Rights-Reserved"]


def test_licences_by_brute_force():
    """Sentences by search in the normalised text, rules by trying all places."""
    s, known, rng = license_rules.Scanner(), license_rules.known_sentences(), random.Random(6)
    forms = [(license_rules.normalised(t), name) for name, texts in known.items() for t in texts]

    def identifiers(text):
        padded, found = f" {license_rules.normalised(text)} ", []
        for form, name in forms:
            at = padded.find(f" {form} ")
            while at >= 0:
                found.append((at, -len(form), name))
                at = padded.find(f" {form} ", at + 1)
        out, end = [], -1
        for at, n, name in sorted(found):
            if at >= end:
                before = padded[:at].split()
                if before and before[-1] in ("be", "been", "currently", "yet", "also"):
                    before.pop()
                if not (name in license_rules.NAMES and (before[-1:] in (["not"], ["never"], ["nor"]) or before[-2:] in (["no", "longer"], ["isn", "t"]))):
                    out.append(name)
                end = at - n + 1
        return out

    def licences(ids):
        left, out = list(range(len(ids))), []
        for licence, kind, wanted in license_rules.RULES:
            while True:
                fits = [c for c in itertools.combinations(left, len(wanted)) if tuple(ids[k] for k in c) == wanted]
                if not fits:
                    break
                left = [k for k in left if k not in min(fits)]
                if (licence, kind) not in out:
                    out.append((licence, kind))
        return out

    names, texts = list(known), list(known.values())
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 7)):
            words = rng.choice(rng.choice(texts) or ("x",)).split()
            if rng.random() < 0.2:
                words = words[: len(words) // 2]
            if rng.random() < 0.5:
                words = [w.upper() if rng.random() < 0.5 else w for w in words]
            parts.append(rng.choice([" ", "\n# ", "\n"]).join(words) + rng.choice([".", "", " and", ";"]))
        text = rng.choice(["\n", " "]).join(parts)
        ids = identifiers(text)
        assert s.identifiers(text) == ids, text
        assert s.licences(ids) == licences(ids)
    for name, listed in known.items():
        for t in listed:
            assert s.identifiers(f"Some words. {t}, more words") == [name] and name in names
    own = license_rules.Scanner({"a": ("zebras may graze here",), "b": ("zebras are free",)}, (("Z", "restricted", ("a", "b")),))
    assert own.licences(own.identifiers("Zebras may graze\nhere; zebras are free!")) == [("Z", "restricted")]


LICENCE_CASES = [
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"], ["MIT OR Apache-2.0"]),
    ("// spdx-license-identifier: (mit AND (bsd-2-clause OR GPL-2.0+)) */", ["BSD-2-Clause", "GPL-2.0-or-later", "MIT"], ["(MIT AND (BSD-2-Clause OR GPL-2.0-or-later))"]),
    ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0\nint main", ["GPL-2.0"], ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("SPDX-License-Identifier: MIT OR", ["MIT"], ["MIT"]),
    ("SPDX-License-Identifier: NASA-1.3 OR Zlib.", ["Zlib"], ["NASA-1.3 OR Zlib"]),
    ("SPDX-License-Identifier: ((((MIT", ["MIT"], []),
    ("use it (MIT OR Apache-2.0) as you like", ["MIT", "Apache-2.0"], ["MIT OR Apache-2.0"]),
    ("use it (NICE OR EASY) as you like", [], []),
    ("GPL-3.0+ is a name alone", [], []),
    ("It is dual licensed under the MIT License and the Apache License, Version 2.0.", ["MIT", "Apache-2.0"], []),
    ("Licensed under either the MIT License, the ISC License or the BSD 3-Clause License", ["MIT", "ISC", "BSD-3-Clause"], []),
    ("Released under the MIT License. I read the Apache License, Version 2.0 once.", ["MIT"], []),
    ("This is not licensed under the MIT License.", [], []),
    ("It is no longer released under the MIT License or the ISC License. It is licensed under the zlib License.", ["Zlib"], []),
    ("Not only licensed under the MIT License", ["MIT"], []),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", ["GPL-3.0"], []),
    ("                 Apache License\n           Version 2.0, January 2004", ["Apache-2.0"], []),
    ("# MIT License\n#\n# Copyright (c) 2020 Someone", ["MIT"], []),
    ("THE ISC LICENSE (ISC)\r\nCopyright", ["ISC"], []),
    ("I like the MIT License a lot", [], []),
]


@pytest.mark.parametrize("text,licences,expressions", LICENCE_CASES)
def test_expressions_lists_negation_and_titles(text, licences, expressions):
    s = license_rules.Scanner()
    ids, said = s.found(text)
    assert sorted(x for x, _ in s.licences(ids)) == sorted(licences) and said == expressions


def test_expressions_by_brute_force():
    """Random expressions between other words: the longest prefix that a grammar of whole expressions accepts."""
    known, rng = license_rules.short_names(), random.Random(8)

    def whole(tokens):  # by taking expressions apart at every operator
        if len(tokens) == 1:
            return tokens[0] not in ("(", ")", *license_rules.OPERATORS)
        if tokens and tokens[0] == "(" and tokens[-1] == ")" and whole(tokens[1:-1]):
            return True
        if len(tokens) == 3 and tokens[1] == "WITH":
            return whole(tokens[:1]) and whole(tokens[2:])
        return any(t in ("AND", "OR") and whole(tokens[:k]) and whole(tokens[k + 1 :]) for k, t in enumerate(tokens))

    for _ in range(400):
        tokens = [rng.choice(["MIT", "Apache-2.0", "Zlib", "X-1", "(", ")", "AND", "OR"]) for _ in range(rng.randint(1, 9))]
        longest = max((k for k in range(1, len(tokens) + 1) if whole(tokens[:k])), default=0)
        _, found, names = license_rules.expression_at(" ".join(tokens), 0, known)
        assert found == tokens[:longest] and names == [t for t in tokens[:longest] if t.lower() in known]
    assert license_rules.expression_at("(" * 100_000, 0, known)[1] == []


def test_sentences_from_a_table(spark):
    table = spark.createDataFrame([("a", "zebras may graze here"), ("b", "zebras are free"), ("b", None), ("c", "...")], "identifier string, sentence string")
    df = spark.createDataFrame([(1, "Zebras may graze here. Zebras are free. Released under the MIT License"), (2, None)], "doc_id bigint, text string")
    got = license_rules.scan(df, license_rules.sentences_of(table), (("Z", "restricted", ("a", "b")),))
    assert sorted((r.doc_id, r.licences, r.kind) for r in got.collect()) == [(1, "Z", "restricted"), (2, "", None)]


def test_licence_table(spark):
    rows = [(1, None, "a"), (2, "All rights reserved.", "b"), (2, "All rights reserved.", "b"), (3, "x " * 50_000 + "Released under the MIT License.", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, licences string")
    got = sorted((r.doc_id, r.licences, r.kind, r.n_sentences) for r in license_rules.scan(df).collect())
    assert got == [(1, "", None, 0), (2, "All-Rights-Reserved", "restricted", 1), (2, "All-Rights-Reserved", "restricted", 1), (3, "MIT", "permissive", 1)]
    assert license_rules.scan(df.limit(0)).count() == 0


# --- rule ensemble -------------------------------------------------------------------------------
def test_fit_and_compiled_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(int)
    rules = rule_ensemble.fit_rules(x[:1500], y[:1500])
    assert ((rules.scores(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], ", ".join(f"{k} double" for k in rule_ensemble.STATISTICS))
    got = df.select(rules.column(F.struct(*rule_ensemble.STATISTICS)).alias("s")).collect()
    assert np.allclose([r.s for r in got], rules.scores(x[:200]))


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "some words here", "q"), (3, "some words here", "q"), (4, "w " * 80_000, "q")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, None)], "doc_id bigint, quality int")
    for some in (labels, labels.limit(0)):
        rules = rule_ensemble.train(docs, some, "quality", F.lit(True))
        got = [r.score for r in rule_ensemble.score(docs, rules).collect()]
        assert len(got) == 5 and all(0 <= s <= 1 for s in got) and len(set(got)) == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op8_rule_ensemble(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null"), "doc_id").filter("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert right > 0.93 and auc > 0.95, (right, auc)
