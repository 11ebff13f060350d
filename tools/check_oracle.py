"""Compare every registered query with its SQL: columns, types and values.

    python tools/check_oracle.py [sf dir] [name or prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from sieveline.plans import ORACLE, QUERIES  # noqa: E402
from sieveline.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}


def key(row):
    return tuple((v is None, str(v)) for v in row)


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            cols = df.columns
            note = ""
            if name in ORACLE:
                t1 = time.time()
                cur = con.execute(ORACLE[name])
                want_cols = [d[0] for d in cur.description]
                want_types = [str(d[1]) for d in cur.description]
                want = cur.fetchall()
                sql_took = time.time() - t1
                if sorted(cols) != sorted(want_cols):
                    note = f"COLUMNS {sorted(cols)} vs {sorted(want_cols)}"
                else:
                    pos = [want_cols.index(c) for c in cols]
                    want = [tuple(r[i] for i in pos) for r in want]
                    types = [(c, d, want_types[i]) for (c, d), i in zip(df.dtypes, pos) if TYPES.get(want_types[i]) != d]
                    a, b = sorted(rows, key=key), sorted(want, key=key)
                    if len(a) != len(b):
                        note = f"ROWS {len(a)} vs {len(b)}"
                    elif a != b:
                        diff = [(x, y) for x, y in zip(a, b) if x != y]
                        note = f"VALUES {len(diff)} differ, e.g. {diff[:2]}"
                    elif types:
                        note = f"TYPES {types}"
                    if sql_took > 20:
                        note += f" SLOW SQL {sql_took:.0f}s"
            else:
                note = "(no SQL)"
            if note and note != "(no SQL)":
                bad += 1
            print(f"{'ok ' if note in ('', '(no SQL)') else 'BAD'} {name:34s} {len(rows):7d} rows {took:6.2f}s {note}", flush=True)
            if not rows:
                print(f"    note: {name} is empty")
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{len(names)} queries, {sum(n in ORACLE for n in names)} with SQL, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
