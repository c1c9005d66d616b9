"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        n = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def rows_of(table) -> tuple[list[str], list[tuple]]:
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, sorted(tuple(norm(v) for v in r) for r in zip(*data)) if data else []


def compare(spark, con, name: str, sf_dir: str) -> str:
    from voxloom.catalog import ORACLES, QUERIES

    t = time.time()
    got = QUERIES[name](spark, sf_dir).toArrow()
    took = time.time() - t
    if name not in ORACLES:
        return f"rows-only {got.num_rows} {took:.1f}s"
    want = con.execute(ORACLES[name]).to_arrow_table()
    gc, g = rows_of(got)
    wc, w = rows_of(want)
    if gc != wc:
        return f"FAIL columns {gc} vs {wc}"
    if g != w:
        only_g, only_w = sorted(set(g) - set(w))[:3], sorted(set(w) - set(g))[:3]
        return f"FAIL rows {len(g)} vs {len(w)}\n   {gc}\n   spark {only_g}\n   sql   {only_w}"
    gt = {f.name: str(f.type) for f in got.schema}
    wt = {f.name: str(f.type) for f in want.schema}
    bad = {c: (gt[c], wt[c]) for c in gc if gt[c] != wt[c] and {gt[c], wt[c]} != {"string", "large_string"}}
    note = f" TYPES {bad}" if bad else ""
    return f"ok {len(g)} rows {took:.1f}s{note}{' EMPTY' if not g else ''}"


if __name__ == "__main__":
    from voxloom.catalog import QUERIES
    from voxloom.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    fails = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf)
        except Exception as e:  # report and go on with the other queries
            r = f"FAIL {type(e).__name__}: {str(e)[:700]}"
        if r.startswith("FAIL") or "TYPES" in r or "EMPTY" in r:
            fails += 1
        print(f"{n:28s} {r}", flush=True)
    print("problems:", fails)
