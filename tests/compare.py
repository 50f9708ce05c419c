"""Run the registered queries next to their SQL and report differences.

    python tests/compare.py [name ...]      SF_DIR picks the tables
"""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else ("f", repr(v + 0.0))
        if isinstance(v, int) and not isinstance(v, bool):
            return ("i", str(v))
        return v if v is None else (type(v).__name__, str(v))

    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    """None when both give the same rows, else what differs."""
    df = fn(spark, folder)
    got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; e.g. {list(set(got) - set(want))[:2]} / {list(set(want) - set(got))[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return None if got else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con, sqls = connect(folder), entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001  (report and go on)
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
