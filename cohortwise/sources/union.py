"""Union of every enabled source; one failing source does not fail the rest.

``union_sources`` isolates sources that fail while their plan is made and stays
lazy. ``read_sources`` also isolates those that fail while they are read: each
is a job of its own, written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortwise.session import stored


def union_sources(sources: dict[str, Callable[[], DataFrame]],
                  development: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Build each source's frame; a source that raises while planning is recorded in the
    status table instead of failing the job. A development source is dropped when any
    live source is enabled. Returns (rows, status(source, ok, error))."""
    names = [n for n in sources if not (development and n == development and len(sources) > 1)]
    frames, status = [], []
    spark: SparkSession | None = None
    for name in names:
        try:
            df = sources[name]()
            spark = df.sparkSession
            frames.append(df.withColumn("source_name", F.lit(name)))
            status.append((name, True, None))
        except Exception as exc:  # noqa: BLE001 - one source must not sink the others
            status.append((name, False, f"{type(exc).__name__}: {exc}"))
    if not frames:
        raise RuntimeError(f"every source failed: {status}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    st = spark.createDataFrame(status, "source string, ok boolean, error string")
    return rows, st


#: The column in which Spark's text readers put a record that they cannot parse.
CORRUPT = "_corrupt_record"


def read_sources(sources: dict[str, Callable[[], DataFrame]], development: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Reads every source now; one that fails, while it is planned or read, gives no rows and an error.

    Returns (rows of all others or None, status(source, ok, error, listings,
    malformed)). A source is written once to the shared folder and counted on
    the way by an observation, so nothing is read twice. Records that a
    reader sets apart (in ``_corrupt_record``) are counted as malformed and left out of
    the rows.
    """
    names = [n for n in sources if not (development and n == development and len(sources) > 1)]
    frames, status = [], []
    spark = SparkSession.active()
    for name in names:
        try:
            df = sources[name]()
            bad = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
            seen = Observation()
            rows = stored(df.observe(seen, F.count_if(~bad).alias("listings"), F.count_if(bad).alias("malformed")).where(~bad).drop(CORRUPT))
            counts = seen.get
            frames.append(rows.withColumn("source_name", F.lit(name)))
            status.append((name, True, None, counts["listings"], counts["malformed"]))
        except Exception as exc:  # noqa: BLE001 - one source must not sink the others
            status.append((name, False, f"{type(exc).__name__}: {exc}"[:500], 0, 0))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
    return rows, spark.createDataFrame(status, "source string, ok boolean, error string, listings bigint, malformed bigint")


def source_errors(status: DataFrame) -> DataFrame:
    """F6 of ``read_sources``: listings of each source, and its errors: 1 if it failed, and one for each malformed record."""
    return status.select(F.col("source").alias("source_name"), "listings", (F.when(F.col("ok"), 0).otherwise(1) + F.col("malformed")).cast("bigint").alias("errors"))
