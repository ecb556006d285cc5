"""Compare registered queries with their SQL twins on the test tables.

python tests/oracle.py [folder] [name or prefix* ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def kinds(rows, width):
    out = []
    for i in range(width):
        out.append(sorted({type(r[i]).__name__ for r in rows if r[i] is not None}))
    return out


def compare(spark, con, folder, name, fn, sql):
    """None when equal, else what differs; also the seconds Spark took."""
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    secs = time.time() - t0
    if sql is None:
        return (None if got else "no rows"), secs, len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", secs, len(got)
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", secs, len(got)
    if a and kinds(a, len(names)) != kinds(b, len(names)):
        return f"types {kinds(a, len(names))} != {kinds(b, len(names))}", secs, len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", secs, len(got)
    return None, secs, len(got)


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .appName("watchtide-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main():
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(
            name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted
        ):
            continue
        try:
            diff, secs, n = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            diff, secs, n = f"{type(e).__name__}: {str(e)[:400].splitlines()}", 0.0, 0
        tag = "ok " if diff is None else "BAD"
        kind = "" if name in sqls else " (rows only)"
        print(f"{tag} {name} {n} rows {secs:.2f}s{kind}" + (f"  {diff}" if diff else ""), flush=True)
        failed += diff is not None
    print("failed", failed)
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
