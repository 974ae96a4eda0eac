"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows.

python tests/oracle.py sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = Path("/root/testdata")


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def compare(spark, name: str, folder: str, con) -> str:
    """'' when the results agree, else what differs."""
    import __spark_entry__ as entry

    frame = entry.queries()[name](spark, folder)
    rows = frame.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if rows is not None else "no result"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    expected = cursor.fetchall()
    order = sorted(names)
    left = Counter(tuple(plain(r[c]) for c in order) for r in rows)
    right = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in expected)
    if left == right:
        return "" if rows else "both sides are empty"
    return (
        f"{len(rows)} rows against {len(expected)}\n  columns {order}"
        f"\n  only in Spark: {list((left - right).items())[:2]}\n  only in SQL: {list((right - left).items())[:2]}"
    )


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pagetables.session import session

    folder = str(TESTDATA / sys.argv[1])
    spark, con = session(), connect(folder)
    failed = 0
    for name in sys.argv[2:] or list(entry.queries()):
        start = time.time()
        try:
            problem = compare(spark, name, folder, con)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += bool(problem)
        mark = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok':5}{mark:5}{time.time() - start:6.1f}s {name} {problem}", flush=True)
    print(f"{failed} failed")
