"""Compare queries with their SQL definitions: python tests/oracle_check.py [-s 0.01] [key ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(entry, spark, con, sf_dir):
    """(rows, problem): problem is None where both sides agree."""
    df = entry(spark, sf_dir)
    columns, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    if entry.oracle is None:
        return len(rows), None
    cursor = con.execute(entry.oracle)
    names = [d[0] for d in cursor.description]
    want_columns, want = normal(names, cursor.fetchall())
    if columns != want_columns:
        return len(rows), f"columns {columns} != {want_columns}"
    if len(rows) != len(want):
        return len(rows), f"{len(rows)} rows, expected {len(want)}: only here {sorted(set(rows) - set(want), key=repr)[:2]} only there {sorted(set(want) - set(rows), key=repr)[:2]}"
    for got, expected in zip(rows, want):
        if got != expected:
            return len(rows), f"{dict(zip(columns, got))}\n   != {dict(zip(columns, expected))}"
        if [type(g) for g in got] != [type(e) for e in expected]:
            return len(rows), f"types {[type(g).__name__ for g in got]} != {[type(e).__name__ for e in expected]} for {columns}"
    return len(rows), None


def main(argv):
    from partner_analytics.catalog import load
    from partner_analytics.session import build_session

    sf, keys = "0.01", []
    while argv:
        word = argv.pop(0)
        if word == "-s":
            sf = argv.pop(0)
        else:
            keys.append(word)
    sf_dir = f"/root/testdata/sf{sf}"
    entries = load()
    chosen = [k for k in entries if not keys or any(k == w or (w.endswith("*") and k.startswith(w[:-1])) for w in keys)]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for key in chosen:
        start = time.time()
        try:
            rows, problem = compare(entries[key], spark, con, sf_dir)
        except Exception as error:  # noqa: BLE001
            rows, problem = -1, "".join(traceback.format_exception_only(error))[:1500]
            if "-v" in sys.argv:
                traceback.print_exc()
        empty = " EMPTY" if rows == 0 else ""
        print(f"{'ok ' if problem is None else 'BAD'} {key:30s} {rows:7d} rows {time.time() - start:6.2f}s{empty}"
              + (f"\n   {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
