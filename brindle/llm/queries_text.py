"""Queries over texts: token counts, record files, packing, rules, licences, scores and decontamination."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from brindle.llm.common import plain_table
from brindle.llm.license_rules import scan
from brindle.llm.packing import pack
from brindle.llm.quality_rules import BOILERPLATE, LINK, MENU, judge
from brindle.llm.record_files import records_of
from brindle.llm.registry import query
from brindle.llm.rule_ensemble import score, train
from brindle.llm.string_tiling import contaminated
from brindle.llm.token_counts import count_tokens


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """Tokens of every text under the byte-level vocabulary; no SQL form, tested against the library."""
    docs = plain_table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op6_record_files")
def op6_record_files(spark, sf_dir):
    """Every document's ids with the end id, written as record files and read back; an exact round trip is its test."""
    docs = plain_table(spark, sf_dir, "documents")
    found = records_of(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")


@query("op10_packing")
def op10_packing(spark, sf_dir):
    """Pieces of every document in sequences of at most 4096 tokens; tested against brute force on small streams."""
    docs = plain_table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


QUALITY_COLUMNS = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_failed_lines lost_chars".split()

QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (
  SELECT doc_id, sum(least(8, i - last)) AS n
  FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM again) GROUP BY doc_id),
l AS (
  SELECT doc_id, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (
  SELECT doc_id, line, len(lw) AS n, len(list_distinct(lw)) AS dist,
         length(line) - length(translate(line, '#*$%&|<>', '')) AS sym,
         length(line) - length(translate(line, '|»›', '')) AS bars,
         length(line) - length(translate(line, '!', '')) AS shouts,
         length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) AS caps,
         len(list_filter(lw, lambda x: lower(x) IN (MENU))) AS menu, len(list_filter(lw, lambda x: LINKS)) AS links
  FROM l WHERE len(lw) > 0),
b AS (
  SELECT *, (sym * 2 > n) OR (shouts >= 4 AND shouts * 4 > n)
         OR (NOT regexp_matches(line, '\p{Ll}') AND caps >= 10)
         OR (n < 4 AND NOT regexp_matches(line, '[.!?:;,…"''”’»)\]]$'))
         OR (bars >= 3 AND bars * 4 > n) OR (menu >= 3 AND menu * 2 > n) OR (links * 2 > n)
         OR (n <= 30 AND (PHRASES))
         OR (n >= 10 AND dist * dist < n) AS bad
  FROM m),
s AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(bad::INT) AS failed, sum(length(line)) AS chars,
         sum(CASE WHEN bad THEN length(line) ELSE 0 END) AS lost, sum(CASE WHEN bad THEN 0 ELSE n END) AS kept_words
  FROM b GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w) AS n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(dup, 0) AS dup, coalesce(rep.n, 0) AS rep_words,
         coalesce(failed, 0) AS failed, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost, coalesce(kept_words, 0) AS kept_words
  FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * rep_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       dup::BIGINT AS n_dup_lines, rep_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND lost * 100 <= chars * 30 AND kept_words >= 20 AS kept,
       failed::BIGINT AS n_failed_lines, lost::BIGINT AS lost_chars
FROM v
"""
QUALITY_SQL = QUALITY_SQL.replace("PHRASES", " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)).replace("(MENU)", "(" + ", ".join(f"'{w}'" for w in MENU) + ")")
QUALITY_SQL = QUALITY_SQL.replace("LINKS", " OR ".join(f"starts_with(lower(x), '{k}')" for k in LINK))


@query("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark, sf_dir):
    """Measures and verdict of the line-first rules for every document."""
    docs = plain_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *[f"quality.{c}" for c in QUALITY_COLUMNS])


@query("op7_license_rules")
def op7_license_rules(spark, sf_dir):
    """Licences of every document; tested against texts of known licences."""
    return scan(plain_table(spark, sf_dir, "documents"))


@query("op8_rule_ensemble")
def op8_rule_ensemble(spark, sf_dir):
    """Quality scores of every document by rules learned from rows that are not held out; tested on those held out."""
    docs = plain_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = plain_table(spark, sf_dir, "labels")
    # Rows without an id have no labels to learn from: they are held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    rules = train(docs, labels, "quality", ~held_out)
    scored = score(docs, rules)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_string_tiling")
def op9_string_tiling(spark, sf_dir):
    """Documents that cover a benchmark item, with the share of it; tested against brute force."""
    docs, benchmark = plain_table(spark, sf_dir, "documents"), plain_table(spark, sf_dir, "benchmark")
    return contaminated(docs, benchmark)
