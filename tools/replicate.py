"""Write an N-times replica of the driver's tables (keys offset per copy) for scaling runs.

Usage: python tools/replicate.py SRC_DIR DST_DIR N
Every row is a copy of a given row with its keys shifted, so the data keeps
the same distributions and grows N-fold.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from cohortwise.session import local_session  # noqa: E402
from cohortwise.sources.tables import BASE_TABLES  # noqa: E402

KEYS = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey"], "part": ["p_partkey"],
        "events": ["event_id", "user_id"], "pages": ["page_id"]}


def main():
    src, dst, n = sys.argv[1], sys.argv[2], int(sys.argv[3])
    spark = local_session()
    for t in BASE_TABLES:
        df = spark.read.parquet(f"{src}/{t}.parquet")
        if t in KEYS:
            span = df.agg(*[F.max(k).alias(k) for k in KEYS[t]]).first()
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_copy", F.col("_copy").cast("bigint"))
            for k in KEYS[t]:
                df = df.withColumn(k, (F.col(k) + F.col("_copy") * (span[k] + 1)).cast(df.schema[k].dataType))
            df = df.drop("_copy")
        df.write.mode("overwrite").parquet(f"{dst}/{t}.parquet")


if __name__ == "__main__":
    main()
