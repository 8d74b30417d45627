"""Compare every registered query with its SQL on the same Parquet tables.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from postweave.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name and values in one spelling, sorted."""
    columns = sorted(frame.columns)
    rows = []
    for record in frame[columns].itertuples(index=False):
        rows.append(tuple("null" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
                          for v in record))
    return sorted(rows)


def differences(ours, con, name: str) -> list[str]:
    """What differs between a query's result and its SQL; empty if nothing does."""
    theirs = con.sql(entry.oracle_sql()[name])
    mine = pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns, dtype=object)
    other = pd.DataFrame(theirs.fetchall(), columns=theirs.columns, dtype=object)
    found = []
    if sorted(mine.columns) != sorted(other.columns):
        return [f"columns {sorted(mine.columns)} against {sorted(other.columns)}"]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
             "boolean": "BOOLEAN"}
    for column, kind in zip(theirs.columns, theirs.types):
        own = dict(ours.dtypes)[column]
        if kinds.get(own) != str(kind):
            found.append(f"type of {column}: {own} against {kind}")
    a, b = normal(mine), normal(other)
    if len(a) != len(b):
        found.append(f"rows {len(a)} against {len(b)}")
    unequal = [(x, y) for x, y in zip(a, b) if x != y]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return found


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in entry.oracle_sql():
                found = differences(fn(spark, folder), con, name)
                state = "same" if not found else "; ".join(found)
            else:
                state = f"rows only: {len(fn(spark, folder).collect())}"
                found = []
        except Exception as error:  # report all queries, not only the first that fails
            found = [type(error).__name__]
            state = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{name:26s} {time.time() - start:6.2f}s  {state[:900]}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
