"""Runs queries and their oracle SQL over one data directory and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(columns: list[str], data: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if the query and the SQL agree in columns and rows."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours = rows(df.columns, [tuple(r.asDict(recursive=True).values()) for r in df.collect()])
    theirs = rows(names, cur.fetchall())
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gaitloom.plans.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            if sql:
                said = differences(spark, sf_dir, query, sql) or "agrees"
            else:
                said = f"{len(query(spark, sf_dir).collect())} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
