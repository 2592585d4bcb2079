"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokenizers
from .common import table
from .compression import score_quality
from .decontaminate import benchmark_matches
from .jaccard import jaccard_components
from .mixing import mix
from .oracle_sql import JACCARD, MIX, SIMHASH, TRIE
from .rules import judge
from .sharding import shard_documents
from .simhash import near_duplicates
from .spans import remove_repeats
from .tokenbin import token_documents
from .toxicity import score_toxicity
from .trie import conversation_trie
from .warc import archived_pages


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuilt=True)


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_shards, op3_quality, op4_simhash, op5_suffix_dedup, op6_toxicity, op7_warc, op8_quality_rules, op9_tokens, op10_mix, op11_jaccard, op12_align, op13_trie)
}
#: Learned models, differencing, edit matching and tokenizer ids are beyond SQL; their tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
copies AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> p.page_id THEN top END AS refers_to
FROM p LEFT JOIN copies USING (h)""",
    "op10_mix": MIX,
    "op11_jaccard": JACCARD,
    "op13_trie": TRIE,
    "op4_simhash": SIMHASH,
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
-- windows of 100 bytes, cut from pieces of the text so that long texts cost no more a window
pieces AS (SELECT doc_id, n, base, substring(x, 2 * base + 1, 2198) AS piece FROM (SELECT doc_id, n, x, unnest(range(0, n - 99, 1000)) AS base FROM d)),
windows AS (SELECT doc_id, base + k AS lo, substring(piece, 2 * k + 1, 200) AS w FROM (SELECT doc_id, base, piece, unnest(range(0, least(1000, n - 99 - base))) AS k FROM pieces)),
late AS (SELECT doc_id, lo FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, lo) > 1),
runs AS (SELECT doc_id, lo, sum(CAST(gap AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM (SELECT doc_id, lo, coalesce(lo > lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) + 100, true) AS gap FROM late)),
spans AS (SELECT doc_id, min(lo) AS lo, max(lo) + 100 AS hi FROM runs GROUP BY doc_id, run),
kept AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS done, string_agg(substring(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
  FROM (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
