"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, directory: str) -> str | None:
    """None when equal, otherwise what differs."""
    df = query.run(spark, directory)
    got = rows_of(df.columns, df.collect())
    if query.sql is None:
        return None if got else "no rows"
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not want:
        return "oracle is empty"
    if got == want:
        return None
    got_set, want_set = set(got), set(want)
    only_got = [r for r in got if r not in want_set][:3]
    only_want = [r for r in want if r not in got_set][:3]
    return f"rows {len(got)} != {len(want)}\n   spark {str(only_got)[:900]}\n   duck  {str(only_want)[:900]}"


def main(argv: list[str]) -> int:
    from corpus_engine import registry
    from tests.session import make_session

    directory = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    areas = [a for a in argv if a in registry.AREAS]
    if areas:
        registry.AREAS = tuple(areas)
    spark = make_session()
    con = connect(directory)
    bad = 0
    for name, q in registry.all_queries().items():
        if argv and not areas and name not in argv:
            continue
        if areas and q.run.__module__.rsplit(".", 1)[-1] not in areas:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, q, directory)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
