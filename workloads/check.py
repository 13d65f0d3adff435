"""Compare Spark results with the SQL oracle: python -m workloads.check [--sf 0.01] [name-prefix ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from workloads import ORACLES, QUERIES
from workloads.base import BASE_TABLES


def session(cores: int = 8, shuffle: int = 8):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master(f"local[{cores}]").appName("raytable")
         .config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "12g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, str]:
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLES:
        return ("rows", f"{len(got)} rows")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return ("FAIL", f"columns {sorted(df.columns)} vs {sorted(cols)}")
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
    if a == b:
        return ("ok" if a else "EMPTY", f"{len(a)} rows")
    sa, sb = set(a), set(b)
    only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
    return ("FAIL", f"{len(a)} vs {len(b)} rows, {len(sa - sb)}/{len(sb - sa)} differ, cols {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}")


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    names = [n for n in QUERIES if not argv or any(n.startswith(p) for p in argv)]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            state, note = compare(spark, con, sf_dir, n)
        except Exception as e:  # report and go on with the next query
            state, note = "ERROR", str(e).strip()[:700]
        bad += state not in ("ok", "rows")
        print(f"{state:5} {n:32} {time.time() - t:6.1f}s  {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} pass")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
