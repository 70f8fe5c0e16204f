"""K1/K2: incremental message ingest and an incremental, idempotent snapshot upsert.

K1 reads new message files with the ``binaryFile`` stream source; each
micro-batch goes through the same decode -> windows -> fields plan as the
batch job, with no join and so no stream state. K2 folds each micro-batch into
the listing snapshot inside ``foreachBatch``.

A snapshot is never overwritten. Its rows lie in hash buckets; a batch writes
the buckets it touches to a folder of its own and then appends one small file
to ``versions``, which says for each bucket of the new version where its rows
are. A failure before that leaves the old version as it was; a batch that is
replayed merges the same rows again and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.session import stored
from cohortwise.sources.messages import MESSAGE_GLOB, decode, detail_link_pattern, link_windows, message_listings

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """K1 source: new message files in ``folder`` as a stream of binary rows.

    A file counts as new whatever its modification time (the source's age limit
    would lose files that arrive late), so the stream's record of files it has
    seen grows with the inbox; ``cleanSource`` bounds the inbox if wanted.
    """
    return (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
            .option("pathGlobFilter", MESSAGE_GLOB).option("maxFileAge", "36500d").load(folder))


def messages_to_rows(files: DataFrame, link: str | None = None, area: str = "") -> DataFrame:
    """Decode -> link windows -> listing fields, keyed by (path, modificationTime).

    The message's own date is the listing date (an alert means "new as of when
    it was sent"). A message has no coordinates: ``lat`` and ``lon`` are null
    until the geocode join (D10) fills them.
    """
    keys = ["path", "modificationTime", "sent_date"]
    text = decode(files, keys[:2])
    pattern = link or detail_link_pattern()
    wins = link_windows(text, keys, pattern, id_group=1)
    wins = (wins.withColumn("slug", F.regexp_extract("window", pattern, 2))
            .withColumn("url", F.regexp_extract("window", pattern, 0)))
    rows = message_listings(wins, keys, area)
    city = area.split(",")[0].strip() if area else ""
    return (rows.withColumn("list_date", F.col("sent_date"))
            .withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double"))
            .withColumn("city", F.lit(city)).withColumn("source", F.lit("email")))


SNAPSHOT_BUCKETS = 64
SOURCE_COLS = ("source", "url", "price", "beds", "baths", "sqft", "address", "city", "list_date", "lat", "lon")
# A later file (by path, then time), and a later place in it, is newer: the order of the batch job.
ORDER_COLS = ("path", "modificationTime", "pos")


def _version(spark: SparkSession, root: str, buckets: int | None = None) -> tuple[int, dict[int, str]]:
    """The latest version and the folder of each of its buckets (at most a row for each bucket)."""
    try:
        rows = spark.read.parquet(f"{root}/versions")
    except AnalysisException:
        return -1, {}
    last, held = rows.agg(F.max("version"), F.max("buckets")).first()
    if buckets not in (None, held):
        raise ValueError(f"the snapshot has {held} buckets, not {buckets}")
    return last, {r.bucket: r.folder for r in rows.filter(F.col("version") == last).collect()}


def _rows_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.parquet(*sorted(set(folders)))


def snapshot_upsert(batch: DataFrame, batch_id: int, root: str, buckets: int = SNAPSHOT_BUCKETS,
                    source_cols: tuple[str, ...] = SOURCE_COLS, order_cols: tuple[str, ...] = ORDER_COLS, seen_col: str = "modificationTime") -> None:
    """K2: fold one micro-batch into the listing snapshot (J1 rules), touching only
    the hash buckets of the listings in the batch.

    Within a batch the latest message wins (A7). A row of the snapshot is
    replaced by rows of later files only, whatever the order in which the files
    arrive, so the stream ends as the batch job does. Columns of the snapshot
    that messages don't have (enrichment, scores) stay as they are. The batch is
    stored first, so its messages are decoded once. A snapshot keeps the number
    of buckets that it began with.
    """
    from cohortwise.operators.state import upsert_into

    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(F.col("listing_id")), F.lit(buckets)).cast("int")
    new = stored(batch.select("listing_id", *order_cols, F.col(seen_col).alias("seen_at"), *source_cols).withColumn("bucket", bucket))
    version, folders = _version(spark, root, buckets)
    touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # buckets at most
    if not touched:
        return
    cols = (*source_cols, *order_cols, "bucket")
    old = [folders[b] for b in sorted(touched) if b in folders]
    if old:
        held = _rows_of(spark, old)
        # the stored row takes part, so that an older file that arrives late does not win
        again = held.select("listing_id", *order_cols, F.col("last_seen").alias("seen_at"), *source_cols, "bucket")
        seen = new.select("listing_id").distinct()
        rows = new.unionByName(again.join(seen, "listing_id", "left_semi"))
        merged = upsert_into(held, rows, "listing_id", order_cols, cols, "seen_at")
    else:
        from cohortwise.operators.state import upsert
        merged = upsert(new, "listing_id", order_cols, cols, "seen_at")
    folder = f"{root}/data-{version + 1:09d}-{uuid.uuid4().hex}"
    (merged.withColumn("part", F.col("bucket")).repartition("bucket").write.partitionBy("part").parquet(folder))
    now = {**folders, **{b: f"{folder}/part={b}" for b in touched}}
    rows = [(version + 1, b, f, buckets) for b, f in sorted(now.items())]
    spark.createDataFrame(rows, "version long, bucket int, folder string, buckets int").coalesce(1).write.mode("append").parquet(f"{root}/versions")


def run_ingest(spark: SparkSession, inbox: str, root: str, checkpoint: str, link: str | None = None):
    """Process every message currently in ``inbox`` (availableNow) into the snapshot."""
    rows = messages_to_rows(message_stream(spark, inbox), link)
    q = (rows.writeStream.foreachBatch(lambda df, bid: snapshot_upsert(df, bid, root))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_sightings(spark: SparkSession, folder: str, root: str, checkpoint: str, schema: str, files_per_batch: int, order_cols: tuple[str, ...], source_cols: tuple[str, ...]):
    """Folds every Parquet file of sightings now in ``folder`` (availableNow, so many files a batch) into the snapshot.

    The first of ``order_cols`` is the time of a sighting.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    q = (stream.writeStream.foreachBatch(lambda df, bid: snapshot_upsert(df, bid, root, source_cols=source_cols, order_cols=order_cols, seen_col=order_cols[0]))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_snapshot(spark: SparkSession, root: str, order_cols: tuple[str, ...] = ORDER_COLS) -> DataFrame:
    """The rows of the latest version."""
    _, folders = _version(spark, root)
    return _rows_of(spark, list(folders.values())).drop("bucket", "part", *order_cols)
