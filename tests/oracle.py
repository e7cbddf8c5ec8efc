"""Runs registered queries and their SQL side by side.

    python tests/oracle.py [-s sf_dir] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return v if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=str)


SPARK_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


def compare(spark, con, sf_dir, name, build, sql) -> list[str]:
    """Differences between the two results; empty when they agree."""
    df = build(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return [] if got else ["no rows"]
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want_names, want = rows_of(list(types), cur.fetchall())
    out = []
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    for n, t in df.dtypes:
        if SPARK_TYPES.get(types[n].upper(), types[n]) != t:
            out.append(f"type of {n}: {t} != {types[n]}")
    if got != want:
        a, b = set(got), set(want)
        only_got, only_want = sorted(a - b, key=str)[:3], sorted(b - a, key=str)[:3]
        out.append(f"rows {len(got)} vs {len(want)}; only spark {only_got}; only sql {only_want}")
    if not got:
        out.append("no rows")
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", "--sf-dir", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from statwitness.plans import all_queries
    from statwitness.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(args.sf_dir)
    bad = 0
    for name, q in all_queries().items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, args.sf_dir, name, q.build, q.sql)
        except Exception as e:  # report and go on with the next query
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(diff)
        kind = "sql " if q.sql else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {name} {time.time() - t:.1f}s", *[d[:1800] for d in diff], sep="\n     " if diff else " ")
        sys.stdout.flush()
    print("failed:", bad)
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
