"""Run catalog queries and their SQL on the same tables and compare the rows.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def differences(df, con, sql: str) -> str:
    """Empty text if rows, column names and value kinds agree."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    expected = [tuple(plain(v) for v in (dict(zip(names, r))[c] for c in order)) for r in answer.fetchall()]
    actual = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    key = lambda row: tuple((v is None, str(type(v)), v) for v in row)
    expected.sort(key=key)
    actual.sort(key=key)
    if len(expected) != len(actual):
        return f"rows {len(actual)} vs {len(expected)}"
    for a, b in zip(actual, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return ""


def main(folder: str, chosen: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from faultlens.session import local_session

    spark, con = local_session(), connect(folder)
    sqls, failed = oracle_sql(), 0
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                trouble = differences(df, con, sqls[name])
                state = "ok" if not trouble else "DIFF " + trouble
            else:
                state = f"no SQL, rows={df.count()}"
        except Exception as e:  # noqa: BLE001
            state = "ERROR " + str(e)[:1500]
        failed += state.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
