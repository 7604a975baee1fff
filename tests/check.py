"""Runs queries next to their SQL and compares rows: python -m tests.check [sf_dir] [name ...]"""

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if v is None:
        return "\0"
    if isinstance(v, (bool, int)):
        return str(int(v))
    if hasattr(v, "is_finite"):
        return repr(round(float(v), 6))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(same, note)"""
    got_cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got == want:
        return True, f"{len(got)} rows"
    only_got = sorted(set(got) - set(want))[:1]
    only_want = sorted(set(want) - set(got))[:1]
    return False, f"{len(got)} vs {len(want)} rows; cols {got_cols}\n  spark {only_got}\n  sql   {only_want}"


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from vacantia.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session("8", "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), []
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                same, note = compare(df, con, oracles[name])
            else:
                same, note = True, f"{df.count()} rows, no SQL"
        except Exception as e:  # report and go on
            same, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not same:
            bad.append(name)
        print(f"{'ok  ' if same else 'FAIL'} {name} {time.time() - start:.1f}s {note[:6000]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
