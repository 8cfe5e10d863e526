"""Compare registered queries with their SQL on one data folder: python tools/check.py SF_DIR [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """'' when equal, else the first difference."""
    cur = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(desc):
        return f"columns {sorted(df.columns)} != {sorted(desc)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    types = [f"{c}: {t} / {desc[c]}" for c, t in df.dtypes if kinds.get(t, t) != desc[c]]
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(list(desc), want)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"rows {len(a)} / {len(b)}; spark only {only_a}; sql only {only_b}; types {types}"
    if not b:
        return "no rows"
    return f"types {types}" if types else ""


def main():
    from bindings import QUERIES, SQL
    from slideloom.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf)
    bad = 0
    for n in names or QUERIES:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            msg = compare(df, con, SQL[n]) if n in SQL else f"(rows only) {df.count()}"
        except Exception as e:  # report and go on
            msg = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        ok = not msg or msg.startswith("(rows")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n:26s} {time.time()-t:6.2f}s {msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
