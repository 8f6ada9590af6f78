"""Compare registered queries with their DuckDB text. Usage: python tests/oracle.py [sf] [key prefix ...]"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def data_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def connect(path: str):
    import duckdb

    from folioscan.plans.fixtures import BASE_TABLES

    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def compare(spark, con, q, path: str) -> str:
    """Empty when equal, else what differs."""
    df = q.run(spark, path)
    order = sorted(df.columns)
    got_types = {f.name: f.dataType.simpleString() for f in df.schema}
    got = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    if not q.oracle:
        return "" if got else "no rows"
    cur = con.execute(q.oracle)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != order:
        return f"columns {order} vs {sorted(names)}"
    bad = [f"{c}: {got_types[c]} vs {kinds[c]}" for c in order if TYPES.get(got_types[c]) != kinds[c]]
    at = [names.index(c) for c in order]
    want = sorted(tuple(_norm(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        missing = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return f"rows {len(got)} vs {len(want)}; only oracle {missing}; only spark {extra}; types {bad}"[:1500]
    if bad:
        return f"types {bad}"
    return "" if got else "empty on both sides"


def main() -> None:
    from folioscan.plans import load
    from folioscan.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(data_dir(sf))
    fails = 0
    keys = [k for k in load() if not prefixes or k.startswith(prefixes)]
    for key in keys:
        start = time.time()
        try:
            note = compare(spark, con, load()[key], data_dir(sf))
        except Exception as exc:  # report and go on
            note = f"{type(exc).__name__}: {str(exc)[:700]}"
        fails += bool(note)
        print(f"{'FAIL' if note else 'ok  '} {key} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(keys) - fails}/{len(keys)} ok")


if __name__ == "__main__":
    main()
