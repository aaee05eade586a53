"""Run registered queries next to their SQL checks and report differences.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loanloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/loanloom-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value else 0.0
    return value


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark, con, folder: str, fn, sql: str | None) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    rows = df.collect()
    if sql is None:
        return None if rows else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = dict(zip(names, (str(d[1]) for d in cur.description)))
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = [f"{c}: {t} / {kinds[c]}" for c, t in df.dtypes if TYPE_NAMES.get(t, t) != kinds[c].upper()]
    if len(rows) != len(theirs):
        return f"rows {len(rows)} != {len(theirs)}"
    a, b = rows_of(df.columns, rows), rows_of(names, theirs)
    for x, y in zip(a, b):
        if x != y:
            n = sum(p != q for p, q in zip(a, b))
            return f"{n} of {len(a)} rows differ, first {x} != {y} ({sorted(names)})"
    if not rows:
        return "equal but empty"
    return f"types {odd}" if odd else None


def main() -> None:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), database(folder)
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = difference(spark, con, folder, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - reported per query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {time.time() - start:6.2f}s {name}{'' if name in oracles else ' (rows)'} {found or ''}", flush=True)
    print(f"{bad} of {len(wanted) or len(queries)} differ")


if __name__ == "__main__":
    main()
