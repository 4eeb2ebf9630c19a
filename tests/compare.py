"""Compare every registered query with its SQL equivalent: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in a fixed order."""
    frame = frame[sorted(frame.columns)].copy()
    order = frame.map(lambda v: "" if pd.isna(v) else str(v))
    return frame.loc[order.sort_values(list(order.columns)).index].reset_index(drop=True)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> list[str]:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return [f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"]
    if len(spark_rows) != len(sql_rows):
        return [f"rows {len(spark_rows)} / {len(sql_rows)}"]
    ours, theirs = canonical(spark_rows), canonical(sql_rows)
    found = []
    for name in ours.columns:
        a, b = ours[name], theirs[name]
        if str(a.dtype).lower() != str(b.dtype).lower() and not a.isna().any():
            found.append(f"{name}: type {a.dtype} / {b.dtype}")
        x, y = a.to_numpy(dtype=object), b.to_numpy(dtype=object)
        same = np.array([(pd.isna(p) and pd.isna(q)) or (not pd.isna(p) and not pd.isna(q) and p == q) for p, q in zip(x, y)], dtype=bool)
        if not same.all():
            at = int(np.argmin(same))
            found.append(f"{name}: {int((~same).sum())} differ, first {x[at]!r} / {y[at]!r}")
    return found


def main() -> int:
    import __spark_entry__ as entry
    from dawnchorus.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        at = time.time()
        try:
            rows = query(spark, folder).toPandas()
            took = time.time() - at
            found = differences(rows, con.sql(sql[name]).df()) if name in sql else []
        except Exception as error:  # report and go on with the other queries
            took, rows, found = time.time() - at, [], [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name:32s} {len(rows):8d} rows {took:6.2f}s", *found, sep="  ", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
