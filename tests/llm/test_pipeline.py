import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import paragraph_dedup, string_tiling
from brindle.llm.common import written
from brindle.llm.quality_rules import judge
from brindle.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == out[0].columns and [f.dataType for f in docs.schema] == [f.dataType for f in out[0].schema]
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_stage(kept):
    want = {r.doc_id: r.cleaned for r in judge(kept[0]).filter("quality.kept").select("doc_id", "quality.cleaned").collect()}
    assert texts(kept[1]) == want and all(r.n_chars == len(r.text) for r in kept[1].collect())


def test_jaccard_stage(kept):
    before, after = texts(kept[1]), texts(kept[2])
    sets = {k: set(shingle_set(t.encode()).tolist()) for k, t in before.items()}
    up = {k: k for k in sets}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and sets[a]:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert after == {k: before[k] for k in ids if root(k) == k}


def test_passage_stage(kept):
    before, after = texts(kept[2]), texts(kept[3])
    parts, seen = paragraph_dedup.Paragraphs(), {}
    for k, t in after.items():
        for w in parts.of(t.encode())[1].tolist():
            seen.setdefault(w, set()).add(k)
    # Cutting can bring new neighbours together, but no document keeps a paragraph that another held before it.
    first = {}
    for k in sorted(before):
        for w in parts.of(before[k].encode())[1].tolist():
            first.setdefault(w, k)
    for w, holders in seen.items():
        assert w not in first or holders <= {first[w]}
    assert set(after) <= set(before)


def test_benchmark_stage(spark, kept):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in string_tiling.contaminated(kept[3], bench).collect()}
    assert texts(kept[4]) == {k: t for k, t in texts(kept[3]).items() if k not in bad}


def test_run(spark, kept):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    want = {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts(kept[4]).items()}
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert sum(r.length for r in got) == sum(want.values())
    assert np.max(list(by_sequence(got).values())) <= 4096


def by_sequence(rows):
    out = {}
    for r in rows:
        out[r.sequence_id] = out.get(r.sequence_id, 0) + r.length
    return out
