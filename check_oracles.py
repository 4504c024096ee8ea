"""Compare registered queries with their oracles: python tools_check.py SF [key-prefix ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from ballast import catalog
from ballast.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda n: names[n])

    def cell(value):
        if isinstance(value, float):
            return f"{value:.9g}"
        return str(value)

    return sorted(tuple(cell(row[n]) for n in order) for row in rows)


def compare(spark, duck, folder, key):
    started = time.time()
    frame = catalog.QUERIES[key](spark, folder)
    got = rows_of(frame.columns, frame.collect())
    spent = time.time() - started
    if key not in catalog.ORACLES:
        return f"rows-only {len(got)}", spent
    cursor = duck.execute(catalog.ORACLES[key])
    names = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} vs {sorted(names)}", spent
    kinds = {
        "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE",
    }
    odd = [
        f"{name}:{dtype}/{types[name]}"
        for name, dtype in frame.dtypes
        if kinds.get(dtype, dtype) != types[name]
    ]
    note = f" TYPES {odd}" if odd else ""
    if got != want:
        missing = [row for row in want if row not in set(got)][:3]
        extra = [row for row in got if row not in set(want)][:3]
        return f"DIFF {len(got)} vs {len(want)} want {missing} got {extra}{note}", spent
    return f"ok {len(got)}{note}", spent


def main() -> None:
    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    catalog.load()
    keys = [
        key
        for key in catalog.QUERIES
        if not sys.argv[2:] or any(key.startswith(prefix) for prefix in sys.argv[2:])
    ]
    bad = 0
    for key in keys:
        try:
            verdict, spent = compare(spark, duck, folder, key)
        except Exception as error:  # report and go on with the next key
            verdict, spent = f"ERROR {str(error)[:700]}", 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{key:34s} {spent:6.2f}s {verdict}", flush=True)
    print(f"{len(keys)} queries, {bad} bad")


if __name__ == "__main__":
    main()
