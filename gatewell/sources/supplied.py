"""A supplied contact table: a CSV file with its columns in order, checked by digest and size, as records."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.operators import giving

# Fixed value: the columns, in order.
COLUMNS = "donor_id string, donor_name string, first_name string, last_name string, tier string, region string, gifts string, largest_gift int, lifetime_total int, last_gift_year int, volunteer boolean"


def read(spark: SparkSession, path: str, sha256: str | None = None, rows: int | None = None) -> DataFrame:
    """The table with gift lists, aggregates, segment and `consistent`. A local file may be held to its digest and size.

    Raises ValueError for another header, digest or number of rows.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    if sha256 is not None and hashlib.sha256(Path(path).read_bytes()).hexdigest() != sha256:
        raise ValueError("the table is not the one that was agreed")
    header = spark.read.option("header", False).csv(path).first()
    if header is None or list(header) != names:
        raise ValueError("the table has other columns")
    found = giving.summarized(spark.read.csv(path, schema=COLUMNS, header=True, mode="FAILFAST", enforceSchema=False))
    if rows is not None and found.count() != rows:
        raise ValueError("the table has another number of rows")
    return found


def check(spark: SparkSession, path: str, expected: str, **of) -> bool:
    """Whether the records made of a table, one JSON line each in order of donor_id, are byte for byte those of a file."""
    made = read(spark, path, **of).orderBy("donor_id").select(F.to_json(F.struct("donor_id", "first_name", "last_name", "segment", "gift_largest", "gift_lifetime", "gift_last_year", "consistent")).alias("line"))
    return "".join(r["line"] + "\n" for r in made.toLocalIterator()) == Path(expected).read_text(encoding="utf-8")


def manifest(spark: SparkSession, path: str) -> str:
    """Digest, number of rows and of rows by segment of a local table, as JSON."""
    found = read(spark, path)
    counts = {r["segment"]: r["count"] for r in found.groupBy("segment").count().collect()}
    return json.dumps({"sha256": hashlib.sha256(Path(path).read_bytes()).hexdigest(), "rows": sum(counts.values()), "segments": dict(sorted((str(k), v) for k, v in counts.items()))})
