"""Run registered queries next to their SQL in DuckDB.

``python tests/oracle.py [folder] [name-prefix …]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def _lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, db, folder: str, run, sql: str | None) -> tuple[bool, str]:
    result = run(spark, folder)
    rows = [tuple(r) for r in result.collect()]
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    expected = answer.fetchall()
    if sorted(names) != sorted(result.columns):
        return False, f"columns {sorted(result.columns)} != {sorted(names)}"
    got, want = _lines(result.columns, rows), _lines(names, expected)
    if got != want:
        extra, lacking = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return False, f"{len(got)} rows vs {len(want)}; only here {extra}; only SQL {lacking}"
    return True, f"{len(got)} rows"


def main() -> None:
    from netloom.plans import ENTRIES
    from netloom.runtime import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                          "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = database(folder)
    bad = 0
    for name, entry in ENTRIES.items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, db, folder, entry.run, entry.sql)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
