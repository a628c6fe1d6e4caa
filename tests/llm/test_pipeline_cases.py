import pytest

import corpus_pipeline
from brindle.llm.common import written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, cluster int, kept string, quality string, shard int, start string, path string, band string, members int"


def good(tag, n=40):
    return "\n".join(f"Line {tag}{i} holds words a{tag}{i} b{tag}{i} and says c{tag}{i} more d{tag}{i} here." for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cases")
    rest = (None,) * 12
    shared = " ".join(f"shared{i}" for i in range(60)) + "."
    rows = [
        (1, good("x"), *rest), (1, good("x"), *rest), (2, good("x"), *rest), (3, None, *rest), (4, "", *rest), (5, "short", *rest), (None, good("n"), *rest),
        (6, good("p") + "\n" + shared, *rest), (7, good("q") + "\n" + shared, *rest), (8, good("r") + "\nleaked words of a test item that nobody should have seen.", *rest),
        (9, good("long", 6000), "en", "s", 5, "a", 1, "b", "c", 2, "d", "e", "f", 3),
    ]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "Leaked words of a test item that nobody should have seen"), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return f"file://{d}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        ids.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
    assert ids[0] == sorted([1, 1, 2, None, 6, 7, 8, 9], key=str)
    assert ids[1] == ids[2] == sorted([1, None, 6, 7, 8, 9], key=str)
    assert ids[3] == sorted([1, None, 6, 7, 9], key=str)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert "shared30" in texts[6] and "shared30" not in texts[7] and texts[1] == good("x") and texts[None] == good("n")
    assert docs.filter("doc_id = 9").first().band == "f"
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(texts)


def test_rows_without_ids(spark, folder):
    rest = (None,) * 12
    rows = [(1, good("a"), *rest), (None, good("a"), *rest), (None, good("b"), *rest), (None, good("b"), *rest), (None, good("c"), *rest)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.jaccard(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, good("a")), (None, good("b")), (None, good("c"))], key=str)


def test_large_benchmark(spark, folder, tmp_path, monkeypatch):
    from functools import partial

    monkeypatch.setattr(corpus_pipeline, "decontaminate", partial(corpus_pipeline.decontaminate, broadcast_bytes=0))
    leak = "\nleaked words of a test item that nobody should have seen."
    rows = [(k, good(f"n{i}") + (leak if i % 2 else ""), *(None,) * 12) for i, k in enumerate([None, None, 4, 4])]
    out = corpus_pipeline.benchmark(spark, spark.createDataFrame(rows, SCHEMA), folder)
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("None", good("n0")), ("4", good("n2"))])


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
