"""Run every query against its SQL and compare rows: ``python -m checks.gate [folder] [names]``."""

from __future__ import annotations

import sys
import time

import duckdb

from tidemark.session import get_session

from .data import TABLES
from .oracle import ORACLE
from .queries import QUERIES


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def main(folder: str, names: list[str]) -> int:
    spark = get_session(
        "gate",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names or sorted(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            found = rows_of(df.columns, [tuple(r) for r in df.collect()])
            types = {f.name: f.dataType.simpleString() for f in df.schema}
            seconds = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name:26} {len(found):7} {seconds:6.2f}s")
                continue
            result = db.execute(ORACLE[name])
            columns = [d[0] for d in result.description]
            kinds = {d[0]: str(d[1]) for d in result.description}
            wanted = rows_of(columns, result.fetchall())
            same = sorted(df.columns) == sorted(columns) and found == wanted
            print(f"{'ok   ' if same else 'DIFF '} {name:26} {len(found):7} {seconds:6.2f}s")
            print("      ", {c: (types[c], kinds.get(c)) for c in sorted(types)})
            if not same:
                bad += 1
                print(sorted(df.columns), sorted(columns), len(found), len(wanted))
                for f, w in list(zip(found, wanted)):
                    if f != w:
                        print("   spark ", f[:400], "\n   sql   ", w[:400])
                        break
        except Exception as error:
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:600]}")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(min(main(args[0] if args else "/root/testdata/sf0.01", args[1:]), 1))
