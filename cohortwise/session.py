"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE for runtime re-planning (partition
# coalescing, skew-join splitting, broadcast conversion), UTC for dates.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # HotSpot does not JIT methods over 8000 bytes of bytecode; past that, use
    # per-operator code instead of one huge (interpreted) fused method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Stage checkpoints are scratch: delete each once its DataFrame is garbage-collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# What the queries need of a session that others made, too; all may be set while it runs.
RUNTIME_CONF = {
    # see above: a method that stays interpreted takes several times as long
    "spark.sql.codegen.hugeMethodLimit": BASE_CONF["spark.sql.codegen.hugeMethodLimit"],
    # Stage tables are Parquet files many times smaller than their rows in memory; by their plain
    # size Spark would collect and broadcast sides of joins of any number of rows.
    "spark.sql.sources.fileCompressionFactor": "10.0",
}


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with ``RUNTIME_CONF``."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortwise") -> SparkSession:
    """A local session for tests and the benchmark (a cluster passes its own)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("COHORTWISE_DRIVER_MEM", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a folder that the driver and
    all executors share, and is used as is. Only a ``local[...]`` session
    (tests, where there are no other machines) gets a scratch folder when it
    is unset; any other master raises instead of writing where executors
    cannot read.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder shared by all executors (master is {master})")
        conf_dir = tempfile.mkdtemp(prefix="cohortwise-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table to the shared checkpoint folder and read back.

    Cuts the lineage like a checkpoint, but its readers prune columns, push
    filters down and know its size.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
