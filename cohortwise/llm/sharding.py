"""Operator 8 (native): two-pass external shuffle into shards.

Pass 1 scatters whole records uniformly into buckets that fit in memory, by a
seeded hash; there are as many buckets as the table's bytes ask for. Pass 2
gathers each bucket, gives it a Fisher-Yates permutation (Spark's ``shuffle``
of an array is that algorithm) and lays the buckets end to end; the resulting
global order is cut into shards, which are written. Beside the records only
counts of buckets travel.

Law ``rows``: the shard of global position g of N is floor(g * shards / N), so
the shards' row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.llm.common import buckets_for, shared_folder, shuffle_width, table

#: Bytes of a bucket, about; what a bucket holds beyond that is cut into runs of so many bytes.
BUCKET_BYTES = 8 << 20


def _bytes(df: DataFrame) -> Column:
    """What a record takes, about: its texts and bytes, nested values as JSON, and 8 for every other column."""
    def one(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(F.col(f"`{f.name}`"))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        return F.lit(8)
    total = F.lit(16).cast("bigint")
    for f in df.schema.fields:
        total = total + F.coalesce(one(f), F.lit(0))
    return total


def _scattered(df: DataFrame, by: list[str], buckets: int, seed: int) -> DataFrame:
    """``df`` with __bucket, __draw and __tie, which order a bucket, and __bytes."""
    h = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in by])
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if any(isinstance(f.dataType, T.MapType) for f in df.schema.fields) else F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return (df.withColumn("__bytes", _bytes(df)).withColumn("__tie", F.xxhash64(F.lit(seed), whole))
            .withColumn("__bucket", F.pmod(h, F.lit(buckets)).cast("int")).withColumn("__draw", F.xxhash64(F.lit(seed + 1), h)))


def _with_runs(rows: DataFrame, bucket_bytes: int) -> DataFrame:
    """``rows`` with __run, the run of its bucket: only repeats, which share a bucket, or long records make a second one."""
    order = Window.partitionBy("__bucket").orderBy("__draw", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__run", F.floor((F.sum("__bytes").over(order) - F.col("__bytes")) / F.lit(bucket_bytes)).cast("int"))


def two_pass_shuffle(df: DataFrame, by: list[str], shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard), in a random order.

    ``by`` names the columns that tell records apart; the draw depends on them,
    the seed and the number of buckets only, so a task that runs again after a
    lost executor gives every record its place again. Records equal in all of them,
    nulls included, stand in the same bucket; a bucket of over ``bucket_bytes``
    (only such repeats or long records make one) is cut into runs, each with its own
    permutation, so what a task gathers at once is bounded by that and one record. Rows
    are neither dropped nor merged. An empty table gives an empty table; more
    shards than rows leave shards empty. Columns of ``df`` named ``shard`` or
    ``slot`` are replaced. Whole records are shuffled once.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    total, size = df.agg(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    buckets = buckets_for(spark, size or 0, bucket_bytes / 2, least=16)
    rows = _scattered(df, by, buckets, seed)
    # runs, their places and permutations come from a pass over hashes and sizes alone
    runs = _with_runs(rows.select("__bucket", "__draw", "__tie", "__bytes"), bucket_bytes).groupBy("__bucket", "__run").agg(F.count(F.lit(1)).alias("__n"))
    # a row for each bucket is summed up; runs are placed within their bucket
    starts = runs.groupBy("__bucket").agg(F.sum("__n").alias("__all")).select("__bucket", (F.sum("__all").over(Window.orderBy("__bucket")) - F.col("__all")).alias("__start"))
    first = F.col("__start") + F.sum("__n").over(Window.partitionBy("__bucket").orderBy("__run")) - F.col("__n")
    places = (runs.join(starts, "__bucket").withColumn("__first", first).repartition(shuffle_width(spark), "__bucket", "__run").sortWithinPartitions("__bucket", "__run")
              .select("__bucket", F.col("__run").alias("__own"), "__first", F.expr(f"shuffle(sequence(0, cast(__n - 1 as int)), {seed})").alias("__perm"), F.lit(0).cast("bigint").alias("__bytes")))
    # a run's permutation travels with its records, so no join shuffles them again; neighbouring buckets
    # stay together, so files come in the order of the slots
    record = F.struct("__draw", "__tie", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
    every = rows.select("__bucket", "__draw", "__tie", "__bytes", record.alias("__rec")).unionByName(places, allowMissingColumns=True)
    dealt = _with_runs(every.repartitionByRange(buckets_for(spark, size or 0, 64 << 20), "__bucket"), bucket_bytes)
    gathered = dealt.groupBy("__bucket", F.coalesce("__own", "__run").alias("__run")).agg(
        F.collect_list("__rec").alias("__rows"), F.max("__first").alias("__first"), F.max("__perm").alias("__perm"))  # bucket_bytes and one record at most
    # in an order that any rerun gives, then as the permutation has it
    by_draw = F.array_sort("__rows", lambda a, b: F.when(a["__draw"] < b["__draw"], -1).when(a["__draw"] > b["__draw"], 1).when(a["__tie"] < b["__tie"], -1).when(a["__tie"] > b["__tie"], 1).otherwise(0))
    mixed = gathered.withColumn("__rows", by_draw).withColumn("__rows", F.expr("transform(__perm, i -> __rows[i].r)"))
    placed = mixed.select("__first", F.posexplode("__rows").alias("__at", "r"))
    at = F.col("__first") + F.col("__at")
    return (placed.withColumn("__at", at).select("r.*", "__at")
            .withColumn("shard", F.expr(f"cast(({shards}L * __at) div {max(total, 1)}L as int)"))
            .withColumn("slot", F.expr(f"__at - ((cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L)")).drop("__at"))


def write_shards(df: DataFrame, path: str, by: list[str], shards: int, seed: int = 42, fmt: str = "parquet") -> None:
    """Write the shuffled records, whole, one folder for each shard, each file sorted by slot.

    A shard is dealt over several files by ranges of its slots, so a shard may
    be larger than a task's memory; names sort in the order of the slots.
    """
    out = two_pass_shuffle(df, by, shards, seed)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").format(fmt).save(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written, whole, into 16 shards under the law of equal row counts; the digests are of what is read back."""
    path = shared_folder(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    write_shards(docs, path, ["doc_id"], 16)
    back = spark.read.schema(docs.drop("shard", "slot").schema.add("slot", T.LongType()).add("shard", T.IntegerType())).parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return back.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": (op8_sharding, None)}
