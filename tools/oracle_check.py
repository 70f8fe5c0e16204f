"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and the order-insensitive multiset of rows
(floats rounded to 6 decimals).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cohortwise.plans.catalog import REGISTRY  # noqa: E402
from cohortwise.session import local_session  # noqa: E402
from cohortwise.sources.tables import BASE_TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "array<string>": "VARCHAR[]"}


def type_mismatches(sdtypes, dcols, dtypes):
    d = dict(zip(dcols, (str(t) for t in dtypes)))
    return [(c, t, d.get(c)) for c, t in sdtypes if SPARK_TO_DUCK.get(t, t) != d.get(c)]


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    if os.environ.get("ORACLE_PLAIN"):  # the driver's kind of session: no settings of ours
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ok = 0
    for name in names:
        fn, sql = REGISTRY[name]
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:300]}")
            continue
        dt = time.time() - t0
        if sql is None:
            print(f"ROWS {name}: {len(srows)} rows ({dt:.1f}s)")
            ok += 1
            continue
        try:
            rel = con.sql(sql)
            dcols = rel.columns
            dtypes = rel.types
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(scols)} vs {sorted(dcols)}")
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        tm = type_mismatches(df.dtypes, dcols, dtypes)
        if tm:
            print(f"TYPE {name}: {tm}")
        if a == b:
            print(f"OK   {name}: {len(a)} rows ({dt:.1f}s)")
            ok += 1
        else:
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: spark {len(a)} rows, duckdb {len(b)} rows; "
                  f"only-spark e.g. {list(sa - sb)[:2]} only-duckdb e.g. {list(sb - sa)[:2]}")
    print(f"{ok}/{len(names)} passed")


if __name__ == "__main__":
    main()
