"""Run registered queries and compare them with their SQL: ``python tools/check.py [sf] [name | module:]...``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from epispan.registry import load_all  # noqa: E402


SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, normal(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "as_tuple"):
        return ("decimal", str(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(normal(r[i]) for i in order)) for r in rows))


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    duck = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    bad = 0
    for name, entry in load_all().items():
        if args and not any(a in (name, entry.module + ":") for a in args):
            continue
        start = time.time()
        try:
            frame = entry.run(spark, sf_dir)
            got = [tuple(r) for r in frame.collect()]
            took = time.time() - start
            if entry.sql is None:
                print(f"ROWS {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            cursor = duck.execute(entry.sql)
            names = [d[0] for d in cursor.description]
            types = {d[0]: str(d[1]) for d in cursor.description}
            want = cursor.fetchall()
            a, b = rows_of(frame.columns, got), rows_of(names, want)
            if sorted(frame.columns) != sorted(names):
                print(f"COLS {name} {sorted(frame.columns)} vs {sorted(names)}", flush=True)
                bad += 1
            elif a != b:
                bad += 1
                print(f"DIFF {name} {len(a)} vs {len(b)}", flush=True)
                sa, sb = set(a), set(b)
                print("   spark:", [x for x in a if x not in sb][:3])
                print("   duck :", [x for x in b if x not in sa][:3])
            else:
                odd = [
                    f"{c}: {kind} / {types[c]}"
                    for c, kind in frame.dtypes
                    if SAME_TYPE.get(types[c], types[c].lower()) != kind
                ]
                note = f" types {odd}" if odd else ""
                print(f"ok   {name} {len(a)} rows {took:.1f}s{note}", flush=True)
        except Exception:
            bad += 1
            print(f"FAIL {name}", flush=True)
            print("   " + "\n   ".join(traceback.format_exc().strip().splitlines()[-8:])[:3000], flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
