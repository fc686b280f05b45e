"""Run registered queries and their SQL side by side and compare every value.

    python tools/check_oracle.py [folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from plumbline.queries import ORACLES, QUERIES
from plumbline.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def row_key(row):
    return tuple((v is None, str(type(v).__name__ == "str"), str(v)) for v in row)


def compare(spark, con, name, folder, queries=QUERIES, oracles=ORACLES):
    df = queries[name](spark, folder)
    names = sorted(df.columns)
    ours = [tuple(canonical(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    if name not in oracles:
        return "rows", len(ours), ""
    result = con.execute(oracles[name])
    cols = [c[0] for c in result.description]
    theirs_raw = result.fetchall()
    if sorted(cols) != names:
        return "COLUMNS", len(ours), f"{names} vs {sorted(cols)}"
    order = [cols.index(c) for c in names]
    theirs = [tuple(canonical(r[i]) for i in order) for r in theirs_raw]
    if len(ours) != len(theirs):
        return "COUNT", len(ours), f"{len(ours)} vs {len(theirs)}"
    a, b = sorted(ours, key=row_key), sorted(theirs, key=row_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y or any(type(p) is not type(q) for p, q in zip(x, y) if p is not None)]
    if bad:
        only_a, only_b = set(ours) - set(theirs), set(theirs) - set(ours)
        shown = f"{len(bad)} differ; {names}; ours {sorted(only_a, key=row_key)[:2]} theirs {sorted(only_b, key=row_key)[:2]}"
        if not only_a and not only_b:
            shown = f"types differ: {bad[0]}"
        return "VALUES", len(ours), shown
    return "ok", len(ours), ""


def main() -> int:
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    parts = args[1:]
    spark = local_session(8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    failures = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            state, rows, note = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001  (report and go on)
            state, rows, note = "ERROR", -1, "".join(traceback.format_exception_only(error))[:900]
        failures += state not in ("ok", "rows")
        print(f"{state:8} {name:34} rows={rows:<7} {time.time() - start:5.1f}s {note}", flush=True)
    print(f"{failures} failures", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
