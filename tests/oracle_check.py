"""Run registered queries next to their SQL and compare the rows. Usage: oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from landpulse.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", v + 0.0)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return ("f", float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


def check(spark, con, sf_dir, name):
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(rows), took, df.columns, rows[:2]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    got_c, got_r = normalise(df.columns, rows)
    want_c, want_r = normalise(want_cols, want)
    if got_c != want_c:
        return "COLUMNS", len(rows), took, got_c, want_c
    if got_r != want_r:
        only_got = sorted(set(got_r) - set(want_r))[:4]
        only_want = sorted(set(want_r) - set(got_r))[:4]
        return "VALUES", len(rows), took, (len(got_r), len(want_r), len(set(got_r) - set(want_r))), got_c, only_got, only_want
    return "ok", len(rows), took


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    known = entry.queries()
    picked = [n for n in known if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    bad = 0
    for name in picked:
        try:
            result = check(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            result = ("ERROR", str(error)[:1500] if not isinstance(error, KeyError) else traceback.format_exc()[-800:])
        if result[0] in ("ok",):
            flag = "" if result[1] else "  <-- empty"
            print(f"ok        {name:32s} rows={result[1]:<7d} {result[2]:.2f}s{flag}", flush=True)
        else:
            bad += result[0] != "rows-only"
            print(f"{result[0]:9s} {name:32s}", *[f"\n    {x}" for x in result[1:]], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
