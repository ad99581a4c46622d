"""A training-corpus pipeline over the documents table, in five stages that each work on all their predecessor kept.

language_id drops documents without a language, near_duplicates keeps one document of each group, decontamination
drops documents that the benchmark covers to a twentieth or more, secrets blanks out credentials that look live, and
pieces encodes what is left. Every stage is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewell.llm import common, decontam, langid, neardup, pieces, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # SQL has no byte context trees


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a 128-bit key of id and text, the same for repeated rows."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-"))]
    return docs.select(*COLUMNS, F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary"))).alias("__key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no language: null texts and texts without a letter. Repeated rows stay; an empty table stays empty."""
    found = langid.identify(docs.select(*COLUMNS), langid.fit(docs), out="__language")
    return found.filter(F.col("__language.lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: that with the smallest id.

    Rows of one id with different texts are judged as documents of their own, in order of id and then of a digest of
    the text; rows equal in both are cut to one. Rows without an id stay, and so do empty texts. An empty table stays
    empty; columns beside those of documents are dropped.
    """
    docs, key = docs.select(*COLUMNS), "doc_id"
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        order = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
        docs, key = docs.withColumn("__id", F.concat(order, F.md5(F.coalesce("text", F.lit("")).cast("binary")))), "__id"
        first = F.row_number().over(Window.partitionBy("__id").orderBy("text", "source", "lang"))
        ranked = docs.filter("doc_id is not null").withColumn("__n", first).filter("__n = 1").drop("__n")
        docs = common.materialize(ranked.unionByName(docs.filter("doc_id is null")), "once")
    gone = neardup.near_duplicates(docs, key).filter(~F.col("kept")).select(key)
    return docs.join(gone.hint("shuffle_hash"), key, "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents. Null texts have no words and stay; rows repeated in id and text share their fate."""
    keyed = _keyed(docs)
    found = decontam.contamination(keyed, common.table(spark, sf_dir, "benchmark"), ["__key"])
    gone = found.filter("contaminated").select("__key").distinct()
    return keyed.join(gone.hint("shuffle_hash"), "__key", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blank out the secrets that look live; widely copied examples stay. n_chars follows the text. No row goes; null texts stay null."""
    keyed = _keyed(docs)
    found = secrets.scan(keyed, ["__key"]).select("__key", F.filter("spans", lambda s: s["live"]).alias("spans"))
    live = found.filter(F.size("spans") > 0).dropDuplicates(["__key"])
    joined = keyed.join(live.hint("shuffle_hash"), "__key", "left")
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col("spans")))
    joined = joined.withColumn("__masked", masked)
    n_chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("__masked").cast("long"))
    return joined.select("doc_id", F.col("__masked").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their number, and digests of the ids and of what they decode to. Null texts have no ids."""
    made = pieces.encode_decode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("piece_bpe_32k.model"), keep=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    return made.select("doc_id", "lang", "source", "encoded.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("pieces", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table of sf_dir.

    Each stage is written before the next begins, and what it and its predecessor have written besides is deleted then.
    Columns that documents has beside COLUMNS are left out, whatever their names; an empty table gives an empty result.
    """
    docs = common.table(spark, sf_dir, "documents")
    before = set(common.written())
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(*[path for path in common.written() if path not in before and path != docs._scratch])
    return docs
