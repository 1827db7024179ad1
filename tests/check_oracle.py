"""Run registered queries next to their SQL on DuckDB and report differences.

    python tests/check_oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return str(v)[:26].removesuffix(".000000")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(row[i]) for i in order) for row in rows)


def compare(spark_rows, duck_rows):
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    return "" if not bad else f"{len(bad)} rows differ, e.g. {bad[0]}"


def duck(sf):
    import duckdb
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def main(argv):
    from barweave.session import build_session
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, fails = duck(sf), []
    queries, oracle = e.queries(), e.oracle_sql()
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            got = df.collect()
            ts = time.time() - t
            if name not in oracle:
                print(f"{name:34s} rows-only {len(got):7d} spark {ts:6.2f}s", flush=True)
                if not got:
                    fails.append(name)
                continue
            t = time.time()
            cur = con.execute(oracle[name])
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            td = time.time() - t
            msg = f"columns {sorted(df.columns)} vs {sorted(names)}" if sorted(names) != sorted(df.columns) else compare(
                rows_of(df.columns, got), rows_of(names, want))
            print(f"{name:34s} {'OK ' if not msg else 'BAD'} {len(got):7d} spark {ts:6.2f}s duck {td:6.2f}s {msg[:700]}", flush=True)
            if msg:
                fails.append(name)
        except Exception as ex:
            print(f"{name:34s} ERR {time.time() - t:6.2f}s {str(ex)[:600]}", flush=True)
            fails.append(name)
    print("FAILED", len(fails), fails)
    return fails


if __name__ == "__main__":
    main(sys.argv[1:])
