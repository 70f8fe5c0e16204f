"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.session import ensure_checkpoint_dir


def importable(spark: SparkSession) -> None:
    """Python workers that see this folder find the package in it; on other machines install it, or send it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    importable(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose rows grow with the corpus: the join is shuffled and merged.

    Spark takes a side for small by the size of its files or by what an explode
    had before it, and would collect it on the driver, many times that size, to broadcast it.
    """
    return df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, amount: float, each: float, least: int | None = None) -> int:
    """Number of buckets of about ``each`` units; never fewer than the shuffle width (or ``least``)."""
    return max(least if least is not None else shuffle_width(spark), math.ceil(amount / each), 1)


_held: dict[str, list] = {}
_owner: list[str] = [""]


def holds_tables(owner: str):
    """Marks a cached function whose tables serve the tasks of one operator; see ``task_of``."""
    def mark(cached):
        _held.setdefault(owner, []).append(cached.cache_clear)
        return cached
    return mark


def task_of(owner: str) -> None:
    """Called by a task as it begins: a Python worker that turns to another operator gives back the last one's tables."""
    if _owner[0] == owner:
        return
    for name, clear in _held.items():
        if name != owner:
            for c in clear:
                c()
    _owner[0] = owner
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def binary_rows(x: np.ndarray) -> pa.Array:
    """The rows of an array as a binary column of their bytes."""
    raw = np.ascontiguousarray(x)
    size = raw[0].nbytes if len(raw) else 0
    off = pa.py_buffer((np.arange(len(raw) + 1) * size).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, off, pa.py_buffer(raw.tobytes())])


#: A group with at least this share of the rows is joined by broadcast: there are 1 / HEAVY such groups at most.
HEAVY = 0.001


def join_groups(rows: DataFrame, key: str, groups: DataFrame, count: str) -> DataFrame:
    """``rows`` with the columns of their group, where ``groups`` has a row for each ``key`` and its ``count`` of rows.

    Nulls are one group; rows without a group are left out. Groups with a
    ``HEAVY`` share of the counted rows, at most 1 / HEAVY of them, are joined
    by broadcast and all others by a shuffle, so no key of it is hot.
    """
    groups = groups.withColumnRenamed(key, "__g")
    every = groups.agg(F.sum(count).alias("__all"))  # one row
    sized = groups.join(F.broadcast(every)).withColumn("__heavy", F.col(count) >= F.col("__all") * F.lit(HEAVY)).drop("__all", count)
    heavy, light = (sized.filter(c).drop("__heavy") for c in ("__heavy", "not __heavy"))
    more = [c for c in heavy.columns if c != "__g"]
    met = rows.join(F.broadcast(heavy.withColumn("__met", F.lit(True))), F.col(key).eqNullSafe(F.col("__g")), "left").drop("__g")
    rest = met.filter("__met is null").drop("__met", *more).join(light, F.col(key).eqNullSafe(F.col("__g"))).drop("__g")
    return met.filter("__met").drop("__met").unionByName(rest)


def slices_by_bytes(off: np.ndarray, most: int):
    """Row ranges (i, j) of at most ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
