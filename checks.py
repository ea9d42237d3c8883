"""Run queries and compare them with their SQL twins: python checks.py [--sf DIR] [name ...]"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from ringsift.queries import ORACLES, QUERIES
from ringsift.queries.bindings import BASE
from ringsift.session import local_session

_DUCK = {
    "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int", "DATE": "date",
}


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _clean(v: object) -> object:
    return None if isinstance(v, float) and math.isnan(v) else v


def compare(spark, con, name: str, folder: str) -> tuple[bool, str, float]:
    started = time.time()
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    mine = [tuple(_clean(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - started
    if name not in ORACLES:
        return len(mine) > 0, f"rows only: {len(mine)}", took
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}", took
    types = {d[0]: _DUCK.get(str(d[1]), str(d[1])) for d in cur.description}
    own = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = {c: (own[c], types[c]) for c in cols if own[c] != types[c]}
    at = [names.index(c) for c in cols]
    theirs = [tuple(_clean(r[i]) for i in at) for r in cur.fetchall()]
    if len(mine) != len(theirs):
        return False, f"{len(mine)} rows against {len(theirs)}; types {odd}", took
    a, b = sorted(mine, key=_key), sorted(theirs, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ on {cols}: {bad[0]}", took
    if odd:
        return False, f"values equal, types differ {odd}", took
    return len(a) > 0, f"{len(a)} rows equal", took


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    wanted = [q for q in QUERIES if not args.names or any(q.startswith(n) for n in args.names)]
    failed = 0
    for name in wanted:
        try:
            ok, note, took = compare(spark, con, name, args.sf)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:900]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {note}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} pass")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
