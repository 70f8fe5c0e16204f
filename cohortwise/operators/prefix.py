"""Ordered prefix counts without pulling a group into one task.

``row_number``/``rank`` windows put a whole partition-by group on one task, so
a search holding a third of all rows would be sorted by a single core. Here
the rows are range-partitioned on (group, order) instead, so a hot group is
cut across many partitions, pinned with a reliable checkpoint (partition ids
must not change between uses), numbered inside each partition, and shifted by
a small table of per-partition offsets.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.session import ensure_checkpoint_dir



# The functions below run inside Python workers: ship them by value so an
# executor needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _pinned(df: DataFrame, group_cols: list[str], order: list[Column], partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + order
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return ranged.checkpoint(eager=True).withColumn("_pid", F.spark_partition_id())


def _offsets(per_part: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per (partition, group): rows of the group in earlier partitions, and the group total.

    One row per (partition, group) pair, so at most partitions + groups rows;
    no broadcast hint -- AQE broadcasts it from its measured size.
    """
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    return (per_part
            .withColumn("_off", F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)).cast("bigint"))
            .withColumn("_group_total", F.sum("_w").over(Window.partitionBy(*group_cols)).cast("bigint"))
            .drop("_w"))


def row_position(df: DataFrame, group_cols: list[str], order: list[Column],
                 partitions: int | None = None) -> DataFrame:
    """Add ``_before`` (rows of the group strictly ahead in ``order``) and ``_group_total``.

    ``order`` must be a total order within a group (add a unique tie-breaker).
    Numbering inside a partition comes from ``monotonically_increasing_id``,
    which counts records in partition order, so it stays in the JVM.
    """
    pinned = _pinned(df, group_cols, order, partitions)
    pinned = pinned.withColumn("_idx", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    per_part = pinned.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_w"), F.min("_idx").alias("_lo"))
    out = pinned.join(_offsets(per_part, group_cols), ["_pid", *group_cols])
    return (out.withColumn("_before", F.col("_off") + F.col("_idx") - F.col("_lo"))
            .drop("_pid", "_idx", "_lo", "_off"))


def _running(group_cols: list[str], weight: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry_key, carry = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            w = pdf[weight].astype("int64")
            cum = w.groupby([pdf[c] for c in group_cols], sort=False).cumsum() - w
            first_key = tuple(pdf[group_cols].iloc[0])
            if carry_key is not None and first_key == carry_key:
                same = (pdf[group_cols] == pd.Series(first_key, index=group_cols)).all(axis=1)
                cum = cum + same.astype("int64") * carry
            last_key = tuple(pdf[group_cols].iloc[-1])
            carry = int(cum.iloc[-1] + w.iloc[-1])
            carry_key = last_key
            yield pdf.assign(_in=cum.astype("int64"))
    return run


def weighted_before(df: DataFrame, group_cols: list[str], order_col: str, weight: str,
                    partitions: int | None = None) -> DataFrame:
    """Add ``_before`` = sum of ``weight`` over rows of the group with a smaller ``order_col``,
    and ``_group_total``.

    Rows must be unique on (group, order_col), e.g. a value -> count table.
    Inside a partition (sorted by group, then value) the running sum is a
    vectorised pandas cumsum over Arrow batches, carried across batches.
    """
    pinned = _pinned(df, group_cols, [F.col(order_col)], partitions)
    schema = T.StructType(pinned.schema.fields + [T.StructField("_in", T.LongType(), False)])
    inner = pinned.mapInPandas(_running(group_cols, weight), schema)
    per_part = pinned.groupBy("_pid", *group_cols).agg(F.sum(weight).alias("_w"))
    out = inner.join(_offsets(per_part, group_cols), ["_pid", *group_cols])
    return out.withColumn("_before", F.col("_off") + F.col("_in")).drop("_pid", "_in", "_off")
