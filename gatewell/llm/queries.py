"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm import common, decontam, fingerprint, html_text, langid, neardup, pieces, quality, secrets, sql, token_counts, warc


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs), out="language")
    return found.select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "language.lang_pred", "language.score", "language.bits")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.select("doc_id", "text"), net, out="q")
    return scored.select("doc_id", common.held_out("doc_id", 3, 1).alias("held_out"), "q.score", "q.predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    found = decontam.contamination(docs, items, ["doc_id"])
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.fingerprint_edits(common.table(spark, sf_dir, "documents"))
    like = fingerprint.resemblance
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.serialize("sketch").alias("fingerprint"),
        fingerprint.serialize("edited_sketch").alias("edited_fingerprint"),
        like("sketch", "edited_sketch").alias("near_edited"),
        like("sketch", "next_sketch").alias("near_next"),
        fingerprint.distinct_shingles("sketch").alias("distinct_shingles"),
        fingerprint.containment("edited_sketch", "sketch").alias("edited_contained"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda ok: F.size(F.filter("spans", ok)).cast("long")
    of_kind = lambda rank: count(lambda s: s["rank"] == rank)
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("n_tokens", "ids_sha256", "decoded_sha256"))
    return made.select("doc_id", "encoded.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc"))
    records = warc.read(index, payload=False)
    return records.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("text")
    lengths = token_counts.histogram(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(lengths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; the others are held against brute force in tests/llm/test_queries.py."""
    return {"op3_decontamination": sql.DECONTAMINATION, "op5_near_duplicates": sql.NEAR_DUPLICATES, "op8_warc": sql.WARC}
