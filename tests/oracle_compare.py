"""Run named queries against their SQL oracles: ``python tests/oracle_compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

DATA = "/root/testdata"


def connect(sf: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(f"{DATA}/{sf}")):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{name}'")
    return con


def canonical(rows, columns):
    """Rows as sorted tuples in column-name order, floats at 9 significant digits."""

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.9g}".replace("-0", "0") if v == 0 else f"{v:.9g}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str, fn, sql: str | None):
    start = time.time()
    df = fn(spark, f"{DATA}/{sf}")
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return took, len(got), "rows only" if got else "EMPTY"
    start = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    took_sql = time.time() - start
    if sorted(df.columns) != sorted(want_cols):
        return took, len(got), f"COLUMNS {sorted(df.columns)} != {sorted(want_cols)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    loose = [c for c, t in df.dtypes if expected.get(t, t) != kinds[c]]
    note = f" TYPES {[(c, dict(df.dtypes)[c], kinds[c]) for c in loose]}" if loose else ""
    a, b = canonical(got, df.columns), canonical(want, want_cols)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return took, len(got), f"VALUES {len(a)} vs {len(b)}: {bad}"
    return took, len(got), f"ok (sql {took_sql:.1f}s){note}"


def main() -> int:
    from vecsnap import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark = local_session()
    con, oracles, failed = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            took, n, verdict = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as error:
            took, n, verdict = 0.0, 0, f"ERROR {str(error)[:600]}"
        failed += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28s} {took:7.2f}s {n:7d} rows  {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
