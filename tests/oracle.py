"""Compare a registered query with its SQL check on the same parquet files.

    python -m tests.oracle [-s FOLDER] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from cutlake.plans.base import BASE

DEFAULT = "/root/testdata/sf0.001"
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> tuple[int, list[str]]:
    """Row count and the list of differences (empty when equal)."""
    frame = entry.queries()[name](spark, folder)
    cols = sorted(frame.columns)
    kinds = dict(frame.dtypes)
    mine = ordered(tuple(r[c] for c in cols) for r in frame.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(mine), []
    rel = con.sql(sql)
    theirs_kinds = dict(zip(rel.columns, map(str, rel.types)))
    problems = []
    if sorted(rel.columns) != cols:
        return len(mine), [f"columns {cols} vs {sorted(rel.columns)}"]
    for c in cols:
        if SAME.get(kinds[c], kinds[c]) != theirs_kinds[c]:
            problems.append(f"type of {c}: {kinds[c]} vs {theirs_kinds[c]}")
    theirs = ordered(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    if mine != theirs:
        a, b = set(mine), set(theirs)
        problems.append(f"rows {len(mine)} vs {len(theirs)}; cols {cols}")
        problems += [f"  only ours   {r}" for r in sorted(a - b, key=repr)[:4]]
        problems += [f"  only theirs {r}" for r in sorted(b - a, key=repr)[:4]]
    return len(mine), problems


def main(argv: list[str]) -> int:
    from cutlake.session import local_session

    folder = DEFAULT
    if argv[:1] == ["-s"]:
        folder, argv = argv[1], argv[2:]
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in entry.queries():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        began = time.time()
        try:
            n, problems = compare(spark, con, name, folder)
        except Exception as error:  # a report line per query, not a stop
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        tag = "ok " if not problems else "BAD"
        print(f"{tag} {name} rows={n} {time.time() - began:.1f}s{'' if name in entry.oracle_sql() else ' (no sql)'}", flush=True)
        for p in problems:
            print("    ", p)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
