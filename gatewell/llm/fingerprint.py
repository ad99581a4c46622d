"""Document fingerprints: bottom-k sketches of shingle hashes, in native DataFrame functions only.

A text's words are runs of characters other than ASCII white space; its shingles are w consecutive words. A text of
fewer than FEW words, as one without spaces, has shingles of w consecutive code points instead, white space included (of
fewer, but not none, one shingle). The sketch holds the k smallest distinct 64-bit shingle hashes in order.
Sketches of parts merge into the sketch of the whole; two sketches estimate resemblance and containment, and one
alone the number of distinct shingles. Null counts as the empty text, whose sketch is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewell.llm.common import let

K, WORDS, FEW = 128, 5, 16
MAX_BUCKETS = 16_384


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shingle_hashes(text: Column | str, w: int = WORDS) -> Column:
    """array<bigint>: the hash of every shingle, in order."""
    whole = F.coalesce(_column(text), F.lit(""))
    points = F.when(F.length(whole) > 0, F.transform(F.split(whole, ""), lambda x: F.xxhash64(F.lit("point"), x))).otherwise(F.array().cast("array<bigint>"))
    found = F.transform(F.array_remove(F.split(whole, "[ \\t\\n\\x0B\\f\\r]+"), ""), lambda x: F.xxhash64(x))
    hashes = let(found, lambda h: F.when(F.size(h) >= FEW, h).otherwise(points))

    def of(h: Column) -> Column:
        slid = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (w - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, w)]))
        none = F.slice(h, F.lit(1), F.lit(0))
        return F.when(F.size(h) >= w, slid).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    return let(hashes, of)


def sketch(text: Column | str, k: int = K, w: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, w))), 1, k)


def merge(a: Column | str, b: Column | str, k: int = K) -> Column:
    """The sketch of the union; associative, so it also serves in aggregate() or a reduce over parts."""
    return F.slice(F.sort_array(F.array_union(_column(a), _column(b))), 1, k)


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    a, b = _column(a), _column(b)
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)))


def distinct_shingles(a: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    a = _column(a)
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    a, b = _column(a), _column(b)
    together = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), together / distinct_shingles(a, k)))


def serialize(a: Column | str) -> Column:
    return F.array_join(F.transform(_column(a), lambda h: F.lpad(F.hex(h), 16, "0")), "")


def sketch_of_parts(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One merged sketch a group, in two steps: the k smallest of each of 64 slices of the hashes, then of those.

    A group of any size costs a task at most one slice of it, and the last step 64 * k hashes.
    """
    parts = df.select(*keys, F.explode(sketch_col).alias("__h")).distinct().withColumn("__slice", F.pmod("__h", F.lit(64)))
    for by in ([*keys, "__slice"], keys):
        parts = parts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).filter(F.col("__r") <= k)
    return parts.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def _boundaries(ids: DataFrame, id_col: str, buckets: int) -> list:
    shares = [k / buckets for k in range(1, buckets)]
    row = ids.agg(F.percentile_approx(id_col, shares, 20 * buckets)).first()
    return sorted(set(row[0] or []), reverse=True)


def with_next(df: DataFrame, id_col: str, carried: dict[str, Column], order_col: str, buckets: int | None = None) -> DataFrame:
    """df with the columns of `carried`, and `next_<name>` of each: its value at the next row by descending id.

    After the last row comes the first; ties go by order_col, null ids last. Rows are dealt once into buckets of
    consecutive ids. What crosses a bucket's edge is its first row, which is dealt to the bucket before it as well, so
    no task holds more than a bucket and only ids of bucket heads reach the driver.
    """
    spark = df.sparkSession
    buckets = min(MAX_BUCKETS, max(8, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = _boundaries(df.select(id_col), id_col, buckets)
    bucket = F.lit(0)
    if bounds:  # the bucket is the number of boundaries above the id; found by groups of about sqrt(n) boundaries
        size = max(1, math.isqrt(len(bounds)))
        groups = [bounds[k : k + size] for k in range(0, len(bounds), size)]
        ends, fine = F.array(*[F.lit(g[-1]) for g in groups]), F.array(*[F.array(*map(F.lit, g)) for g in groups])
        passed = F.size(F.filter(ends, lambda b: b > F.col(id_col)))
        inside = F.size(F.filter(F.get(fine, passed), lambda b: b > F.col(id_col)))
        bucket = F.when(F.col(id_col).isNull(), F.lit(len(groups) * size)).otherwise(passed * size + F.coalesce(inside, F.lit(0)))
    placed = df.withColumn("__bucket", bucket)
    heads = {r[0]: r[1] for r in placed.groupBy("__bucket").agg(F.max(id_col)).collect()}
    if not heads:
        return df.select("*", *[c.alias(n) for n, c in carried.items()], *[c.alias(f"next_{n}") for n, c in carried.items()])
    filled = sorted(heads)
    before = {b: filled[k - 1] for k, b in enumerate(filled)}  # of the first, the last
    id_type = df.schema[id_col].dataType
    head = F.array(*[F.lit(heads.get(b)).cast(id_type) for b in range(filled[-1] + 1)])
    target = F.array(*[F.lit(before.get(b)).cast("int") for b in range(filled[-1] + 1)])
    here, there = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("ghost")), F.struct(F.get(target, F.col("__bucket")).alias("b"), F.lit(True).alias("ghost"))
    ways = F.when(F.get(head, F.col("__bucket")).eqNullSafe(F.col(id_col)), F.array(here, there)).otherwise(F.array(here))
    dealt = placed.withColumn("__way", F.explode(ways)).repartition(F.col("__way.b"))
    dealt = dealt.select("*", *[c.alias(n) for n, c in carried.items()])
    window = Window.partitionBy(F.col("__way.b")).orderBy(F.col("__way.ghost"), F.col(id_col).desc_nulls_last(), F.col(order_col))
    led = dealt.select("*", *[F.lead(n).over(window).alias(f"next_{n}") for n in carried])
    return led.filter(~F.col("__way.ghost")).drop("__way", "__bucket")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WORDS) -> DataFrame:
    """Sketch each text, its next document's and its edited text's: the last third of the characters replaced by the
    next document's first as many. Columns: id, n_chars, edited, sketch, edited_sketch, next_sketch.

    Null texts count as empty; an empty table stays empty; other columns are left out, whatever their names. Rows of one
    id, or without one, stand side by side in order of text; equal rows tie, which changes no result. A lone row is its
    own next. A long text costs memory in proportion to its words.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next(slim, "id", {"sketch": sketch("text", k, w), "body": F.col("text")}, "text")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", F.length("text") - third), F.left("next_body", third))
    out = paired.select(F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next_sketch"))
    return out.withColumn("edited_sketch", sketch("edited", k, w))
