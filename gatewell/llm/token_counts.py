"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by their number of tokens. A row per length, with suffix sums over longer lengths, answers
totals, quantiles and totals under truncation for every context limit: documents of at least `limit` tokens give
`limit` each, shorter ones all they have.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gatewell.llm import common

BLOCK = 1024  # lengths in a block of the suffix sums
_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """A worker's encoder of a byte-level vocabulary file, loaded once."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def token_count(spark, path: str, pattern: str):
    """A column function text -> number of tokens; strings of special tokens are ordinary text, null has none."""
    common.ship(spark)

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        own, out = encoding(path, pattern), []
        for at in range(0, len(texts), 64):
            out += map(len, own.encode_ordinary_batch([t or "" for t in texts.slice(at, 64).to_pylist()], num_threads=1))
        common.tidy()
        return pa.array(out, pa.int64())

    return counted


def histogram(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, docs): how many documents have each length. Rows are counted as often as they occur."""
    counted = docs.select(token_count(docs.sparkSession, path, pattern)(F.col(text_col)).alias("n_tokens"))
    return counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """The histogram with docs_from and tokens_from (this length or longer) and truncated_total (n_tokens as the limit).

    Sums run inside blocks of lengths; what lies beyond a block is added from the blocks' totals, of which there are
    as many as the longest document has thousands of tokens. An empty histogram stays empty.
    """
    lengths = common.materialize(lengths, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = lengths.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = totals.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    docs_in, tokens_in = F.sum("docs").over(inside), F.sum(F.col("docs") * F.col("n_tokens")).over(inside)
    summed = lengths.withColumns({"docs_in": docs_in, "tokens_in": tokens_in}).join(beyond, "block")
    whole = totals.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("all_docs"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_tokens")).first()
    docs_from, tokens_from = F.col("docs_in") + F.col("d"), F.col("tokens_in") + F.col("t")
    all_docs, all_tokens = F.lit(whole["all_docs"]).cast("long"), F.lit(whole["all_tokens"]).cast("long")
    shorter = all_tokens - tokens_from
    return summed.select("n_tokens", "docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), (shorter + docs_from * F.col("n_tokens")).alias("truncated_total"), (all_docs - docs_from + F.col("docs")).alias("docs_upto"), all_docs.alias("all_docs"), all_tokens.alias("all_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that all documents give when each is cut to limit: two rows of the sums at most are looked at."""
    row = sums.filter(F.col("n_tokens") >= limit).orderBy("n_tokens").select("docs_from", (F.col("all_tokens") - F.col("tokens_from")).alias("below")).first()
    if row is not None:
        return row["below"] + row["docs_from"] * limit
    last = sums.select("all_tokens").first()
    return last["all_tokens"] if last else 0


def quantile(sums: DataFrame, share: float) -> int | None:
    """The least length that at least this share of the documents does not exceed."""
    enough: Column = F.col("docs_upto") >= F.lit(share) * F.col("all_docs")
    row = sums.filter(enough).orderBy("n_tokens").select("n_tokens").first()
    return row[0] if row else None
