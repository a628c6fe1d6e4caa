"""Queries over pairs of documents: n-gram Jaccard join and substring dedup."""

from __future__ import annotations

from brindle.llm.chosen_path import near_duplicates
from brindle.llm.common import plain_table
from brindle.llm.paragraph_dedup import duplicates, spans
from brindle.llm.registry import query


@query("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    """Class and number of links of every document at 0.8 on five-word shingles; tested against all pairs."""
    return near_duplicates(plain_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_paragraph_dedup")
def op5_paragraph_dedup(spark, sf_dir):
    """Passages that occur again, in runs of words; those not kept are removals. Tested against brute force."""
    docs = plain_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans(duplicates(docs), docs)
