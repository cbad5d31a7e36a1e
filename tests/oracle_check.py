"""Run registered queries beside their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""
from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else round(value, 6))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir: str, build, sql: str | None) -> tuple[str, int]:
    df = build(spark, sf_dir)
    data = [tuple(r) for r in df.collect()]
    if sql is None:
        return "rows only", len(data)
    con.execute(sql)
    names = [c[0] for c in con.description]
    want = rows(names, con.fetchall())
    got = rows(df.columns, data)
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", len(got)
    if got == want:
        return "ok", len(got)
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return f"DIFF spark {len(got)} rows, sql {len(want)}\n   columns {sorted(names)}\n   spark {str(only_got)[:1500]}\n   sql   {str(only_want)[:1500]}", len(got)


def main() -> None:
    import __spark_entry__ as entry
    from pagewright.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, build, oracles.get(name))
        except Exception as e:
            verdict, n = f"ERROR {type(e).__name__}: {str(e)[:1200]}", -1
        bad += verdict not in ("ok", "rows only")
        print(f"{name:24} {n:7} {time.time() - began:6.2f}s {verdict}", flush=True)
    print("bad:", bad, "of", len(queries))


if __name__ == "__main__":
    main()
