"""Run queries and their SQL twins side by side: python tests/compare.py [-s sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, sorted((tuple(norm(v) for v in r) for r in zip(*cols)), key=repr)


KIND = {"string": "str", "large_string": "str", "int32": "int32", "int64": "int64", "double": "double"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    got = fn(spark, sf_dir).toArrow()
    t1 = time.time()
    if sql is None:
        return "rows", f"{got.num_rows} rows", t1 - t0, 0
    want = con.execute(sql).to_arrow_table()
    want = want.read_all() if hasattr(want, "read_all") else want
    t2 = time.time()
    gn, gr = rows_of(got)
    wn, wr = rows_of(want)
    if gn != wn:
        return "FAIL", f"columns {gn} vs {wn}", t1 - t0, t2 - t1
    types = [
        f"{n}: {got.schema.field(n).type} vs {want.schema.field(n).type}"
        for n in gn
        if KIND.get(str(got.schema.field(n).type), str(got.schema.field(n).type))
        != KIND.get(str(want.schema.field(n).type), str(want.schema.field(n).type))
    ]
    if gr != wr:
        gs, ws = set(gr), set(wr)
        a = [r for r in gr if r not in ws][:2]
        b = [r for r in wr if r not in gs][:2]
        return "FAIL", f"{len(gr)} vs {len(wr)} rows {gn}\n   spark {str(a)[:1500]}\n   duck  {str(b)[:1500]}", t1 - t0, t2 - t1
    if types:
        return "TYPE", "; ".join(types), t1 - t0, t2 - t1
    return "ok", f"{len(gr)} rows", t1 - t0, t2 - t1


def main():
    from clausegrid.catalog import ORACLES, QUERIES
    from clausegrid.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "20g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    chosen = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = []
    for name in chosen:
        try:
            state, info, t, u = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            state, info, t, u = "ERR", f"{type(e).__name__}: {str(e)[:900]}", 0, 0
        if state not in ("ok", "rows"):
            bad.append(name)
        print(f"{state:5} {name:28} {t:6.2f}s duck {u:5.2f}s {info}", flush=True)
    print("bad:", bad, "of", len(chosen))


if __name__ == "__main__":
    main()
