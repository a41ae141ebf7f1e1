"""Run registered queries next to their SQL and compare names, types, rows and values.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAMILIES = {"int": "int", "bigint": "int", "long": "int", "hugeint": "int", "integer": "int", "double": "double",
            "float": "double", "string": "string", "varchar": "string", "boolean": "boolean", "date": "date",
            "smallint": "int", "tinyint": "int"}


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.sql(sql)
    names, types = result.columns, [str(t).lower() for t in result.types]
    mine = dict(df.dtypes)
    if sorted(names) != sorted(mine):
        return f"columns {sorted(mine)} != {sorted(names)}"
    for n, t in zip(names, types):
        a, b = FAMILIES.get(mine[n], mine[n]), FAMILIES.get(t, t)
        if a != b or (mine[n] == "int") != (t == "integer"):
            return f"type of {n}: {mine[n]} != {t}"
    order = sorted(names)
    rows = result.fetchall()
    index = [names.index(n) for n in order]
    theirs = sorted(tuple(_key(r[i]) for i in index) for r in rows)
    ours = sorted(tuple(_key(r[n]) for n in order) for r in df.select(*[f"`{n}`" for n in order]).collect())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pomelo-oracle-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s"
              f"{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
