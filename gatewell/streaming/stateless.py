"""The record pipeline over a stream of JSON lines; each record is judged alone, so no state is kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.functions import shipping
from gatewell.plans import engine
from gatewell.sources import jsonl

LINES = T.StructType([T.StructField("line_number", T.LongType()), T.StructField("raw", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("error_code", T.StringType())])


def _strict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [line for line in batch.column(0).to_pylist() if line.strip()]
        columns = [[None] * len(held), [x.decode("utf-8", "replace") for x in held], [hashlib.sha256(x + b"\n").hexdigest() for x in held], [jsonl.refusal(x) for x in held]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], LINES.names)


def results(spark: SparkSession, folder: str, campaign: dict) -> DataFrame:
    """A streaming DataFrame of results for files that appear in folder; line numbers do not exist on a stream.

    Each line is judged by the strict parse of the batch command. A byte order mark is refused, as a stream does not know
    which line is a file's first.
    """
    shipping.send(spark)
    lines = spark.readStream.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary").alias("line"))
    return engine.run(lines.mapInArrow(_strict, LINES), campaign)
