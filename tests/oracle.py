"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foldsafe.plans import REGISTRY  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, type(v).__name__, str(v)) for v in r))


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]"}


def compare(spark, con, name: str, folder: str) -> str | None:
    """None if both engines agree, else what differs."""
    q = REGISTRY[name]
    df = q.build(spark, folder)
    ours = df.collect()
    if q.sql is None:
        return None if ours else "no rows"
    found = con.execute(q.sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    theirs = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if _KINDS.get(t, t) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    left, right = _sorted_rows(df.columns, ours), _sorted_rows(names, theirs)
    if len(left) != len(right):
        return f"{len(left)} rows and {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"columns {sorted(names)}: {a} and {b}"
    return None


if __name__ == "__main__":
    from conftest import session

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(REGISTRY)
    spark = session()
    con = connect(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # a broken query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
