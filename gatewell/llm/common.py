"""Shared helpers of the training-data operators: tables, shared scratch space, bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHORT = 64  # elements of an array that are gone through in the plain way
_libc = ctypes.CDLL(None)
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, so that its Python functions can be imported there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="gatewell-code-")  # of the driver, which serves it to executors as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(at := os.path.join(folder, f"{top.name}.zip"), "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def broadcast(spark: SparkSession, value):
    ship(spark)
    return spark.sparkContext.broadcast(value)


def tidy() -> None:
    """Give back what a Python worker has freed; workers live on between tasks, so each batch function ends with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary folder of this machine only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="gatewell-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/gatewell-{uuid.uuid4().hex}-{tag}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df to the shared scratch folder and read it back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def written() -> list[str]:
    """The paths of scratch tables that have not been released yet."""
    return [path for _, path in _written]


def release(*frames: DataFrame | str) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for x in frames:
        path = x if isinstance(x, str) else getattr(x, "_scratch", None)
        for spark, known in [w for w in _written if w[1] == path]:
            _written.remove((spark, known))
            try:
                jvm = spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(known)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            except (Py4JError, OSError, AttributeError):  # the session may be gone; the folder then stays for the cluster's own clean-up
                pass


@atexit.register
def _release_all() -> None:
    release(*[path for _, path in _written])


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def held_out(id_col: str, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(id_col, modulus) == F.lit(value), F.lit(False))


def sample_by_label(df: DataFrame, label_col: str, keys: list[str], per_label: int) -> list[Row]:
    """Of each non-null label the per_label distinct rows (by keys) whose hashes are least, or all if there are fewer.

    A scan keeps the rows below a bar, a share of the hashes that holds four times as many rows as are wanted; where
    repeated rows leave too few distinct ones, it is run again with a share sixteen times as large. The driver gets a
    count and at most per_label rows a label. The choice depends on neither partitioning nor row order.
    """
    df = df.filter(F.col(label_col).isNotNull()).withColumn("__hash", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *keys), 1))
    counts = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}
    share = 4 * per_label
    while True:
        bar = F.lit(-1).cast("long")
        for label, n in counts.items():
            bar = F.when(F.col(label_col) == F.lit(label), F.lit(min(2**63 - 1, share * 2**63 // n)).cast("long")).otherwise(bar)
        distinct = df.filter(F.col("__hash") <= bar).dropDuplicates([label_col, *keys])
        order = Window.partitionBy(label_col).orderBy("__hash", *keys)
        rows = distinct.withColumn("__turn", F.row_number().over(order)).filter(F.col("__turn") <= per_label).drop("__turn", "__hash").collect()
        got = Counter(r[label_col] for r in rows)
        if all(got[label] >= min(n, per_label) or share >= n for label, n in counts.items()):
            return rows
        share *= 16


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that it is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, fold=lambda a, n: a + n) -> Column:
    """array<bigint>: the sum (or another fold from 0) of values (array<bigint>) up to and with each element.

    Beyond SHORT elements folds are made in stretches of about the square root of the array's size, so that a long array
    costs that root a time its size, not its square.
    """
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def folds(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), none.alias("ends"))
        return F.aggregate(part, start, lambda s, n: let(fold(s["at"], n), lambda now: F.struct(now.alias("at"), F.concat(s["ends"], F.array(now)).alias("ends"))), lambda s: s["ends"])

    def whole(part: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(part))).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(part) - 1) / step).cast("int")), lambda k: F.slice(part, k * step + 1, step))
        return let(stretches, lambda them: let(folds(F.transform(them, lambda x: F.aggregate(x, zero, fold)), zero), lambda ends: F.flatten(F.transform(them, lambda x, k: folds(x, F.coalesce(F.get(ends, k - 1), zero))))))

    return let(values, lambda part: F.when(F.size(part) > SHORT, whole(part)).otherwise(folds(part, zero)))


_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


STRETCH = 500_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _G)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and sizes of the words of bytes that are parted by spaces and end with one.

    They are hashed in stretches of about STRETCH that end at a space, so long data cost their words at 24 bytes each,
    not temporaries of their size.
    """
    parts, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while at < len(data):
        end = data.find(b" ", min(len(data) - 1, at + STRETCH)) + 1
        hashes, starts, sizes = _stretch(np.frombuffer(data, np.uint8, end - at, at))
        parts.append((hashes, starts + at, sizes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _stretch(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = data == 0x20
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    power = np.cumprod(np.full(int(sizes.max()), _M2, np.uint64))
    weighed = power[place]
    weighed *= _BYTE[data[~blank]]
    return mix(np.add.reduceat(weighed, first) + sizes.astype(np.uint64)), starts, sizes
