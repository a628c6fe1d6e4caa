import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm.token_counts import MergeCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = MergeCounter(PATH, max_remembered=50)


def truth(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "a  b", " lead", "trail ", "x\n y", "a\tb", "it's we'll 12 345", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
     "x\x1cy \x1dz", "\x85 a\xa0b", "ééé ñandú über", "日本語 テスト", "a 　b", "aaaa" * 300, "!!! ??? ...\r\n\r\nx", "a.\nB c", "é f"],
)
def test_fixed(text):
    assert OWN.count(text) == truth(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t ab'sé.1<|>\x1c\xa0"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    assert OWN.count(text) == truth(text)


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two two", "y"), (3, "one two two", "y"), (None, "w " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).collect())
    assert got == sorted((a or 0, len((t or "").encode()), truth(t or ""), truth(t or "") > 1024) for a, t, _ in rows)
    assert count_tokens(df.limit(0), PATH).collect() == []


def test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, PATH).collect()}
    assert got == {r.doc_id: truth(r.text or "") for r in df.collect()}
