"""Run registered queries next to their SQL and report differences.

    python -m checks.compare [--dir FOLDER] [query ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from checks.oracles import oracles
from checks.registry import queries
from quadrat.session import local_session


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v)) if float(v) != int(float(v)) else str(int(v))
        return str(v)

    rows = [tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in Path(args.dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    sql, bad = oracles(), 0
    for name, make in queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            mine = make(spark, args.dir)
            kinds = dict(mine.dtypes)
            mine = mine.toPandas()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - start
        if name not in sql:
            print(f"rows {name}: {len(mine)} rows, {spent:.1f} s", flush=True)
            continue
        start = time.time()
        try:
            result = con.execute(sql[name])
            types = {c[0]: str(c[1]) for c in result.description}
            theirs = result.df()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} SQL: {str(error)[:600]}", flush=True)
            continue
        sql_spent = time.time() - start
        problems = []
        if sorted(mine.columns) != sorted(theirs.columns):
            problems.append(f"columns {set(mine.columns) ^ set(theirs.columns)}")
        elif len(mine) != len(theirs):
            problems.append(f"rows {len(mine)} / {len(theirs)}")
        else:
            a, b = _canonical(mine), _canonical(theirs)
            differing = [(x, y) for x, y in zip(a, b) if x != y]
            if differing:
                problems.append(f"{len(differing)} rows differ, first {differing[0]}")
        wide = {c: (kinds[c], types.get(c)) for c in kinds}
        mixed = {
            c: t
            for c, t in wide.items()
            if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}.get(
                t[0]
            )
            != t[1]
        }
        if mixed and len(mixed) < 12:
            problems.append(f"types {mixed}")
        bad += bool(problems)
        state = "DIFF" if problems else "ok  "
        print(f"{state} {name}: {len(mine)} rows, {spent:.1f} s / {sql_spent:.1f} s "
              + "; ".join(problems)[:900], flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
