import random
import re

from pyspark.sql import functions as F

from brindle.llm.quality_rules import clean, judge, repeated_window_words, words_of

GOOD = "\n".join(f"Line a{i} has words b{i} c{i} and says d{i} more e{i}." for i in range(12))


def brute_repeats(text, window=8):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, hit = {}, set()
    for i in range(len(w) - window + 1):
        seen.setdefault(tuple(w[i : i + window]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(k for i in at for k in range(i, i + window))
    return len(hit)


def test_repeats_by_brute_force(spark):
    rng = random.Random(5)
    texts = ["", "a", "a " * 7, "a " * 8, "a " * 9, "x y " * 40] + [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", repeated_window_words(words_of(F.col("t"))).alias("n")).collect():
        assert r.n == brute_repeats(r.t), r.t


def one(spark, text):
    df = spark.createDataFrame([(1, text, "keep")], "doc_id bigint, text string, n_words string")
    return judge(df).select("quality.*").first()


def test_rules(spark):
    good = GOOD
    r = one(spark, good)
    assert r.kept and not r.base_failed and r.cleaned == good and r.n_failed_lines == 0
    bad_lines = ["Home | About | News | Shop | Help", "a$$$ b%%% c&&& d###", "BUY NOW THIS THING TODAY", "Click here to go on.", "Menu", "Oh! No! Why! Ha! Go!", "na " * 12]
    others = ["Startseite Kontakt Impressum Suche und anderes mehr.", "Voir https://a.example et www.b.example www.c.example.", "Tous droits réservés par nous.", "Haga clic aquí para ver."]
    r = one(spark, good + "\n" + "\n".join(others))
    assert r.n_failed_lines == len(others) and r.kept and r.cleaned == good
    r = one(spark, good + "\n" + "\n".join(bad_lines))
    assert r.n_failed_lines == len(bad_lines) and r.kept and r.cleaned == good
    r = one(spark, "\n".join(bad_lines * 3) + "\n" + good[:330])
    assert not r.kept
    assert not one(spark, "too short").kept and one(spark, "too short").base_failed
    for empty in (None, "", " \n\t "):
        r = one(spark, empty)
        assert r.base_failed and not r.kept and r.n_words == 0 and r.cleaned == ""


def test_clean_keeps_columns_rows_and_long_texts(spark):
    good = GOOD
    long = " ".join(f"w{i}" for i in range(60_000)) + "."
    df = spark.createDataFrame([(1, good, "a"), (1, good, "a"), (2, None, None), (3, long, "b")], "doc_id bigint, text string, quality string")
    got = clean(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 3] and got[0].asDict().keys() == {"doc_id", "text", "quality"} and got[0].quality in ("a", "b")
    assert clean(df.limit(0)).count() == 0


def test_labelled_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    got = judge(docs).join(labels, "doc_id").groupBy("quality.base_failed", "quality.kept", "label").count().collect()
    n = {(r.base_failed, r.kept, r.label): r["count"] for r in got}
    assert n.get((False, False, 1), 0) == 0, n
    assert n.get((False, True, 0), 0) <= 0.1 * sum(v for (_, _, q), v in n.items() if q == 0), n
