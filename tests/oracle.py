"""Runs queries beside their SQL in DuckDB: python tests/oracle.py DIR [NAME-PREFIX...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, names included; else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(n) for n in names]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if ours == theirs:
        return ""
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(a.items())[:3]}; only SQL {list(b.items())[:3]}"


def main(args: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    from catalogq.session import build_session

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(args[0]), e.oracle_sql()
    for name, q in e.queries().items():
        if args[1:] and not any(name.startswith(x) for x in args[1:]):
            continue
        t = time.time()
        try:
            if name in sqls:
                said = difference(spark, con, q, sqls[name], args[0]) or "same"
            else:
                said = f"no SQL, {q(spark, args[0]).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__} {str(x)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
