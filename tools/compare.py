"""Compare registered queries with their SQL: python tools/compare.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from stitchspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: str = "8"):
    return (SparkSession.builder.master(f"local[{cores}]").appName("compare")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v) else v)
    keys = df.astype(str).apply("\x1f".join, axis=1) if len(df.columns) else None
    return df.iloc[keys.argsort()].reset_index(drop=True)


def compare(spark, con, folder: str, name: str) -> str:
    t = time.time()
    got = plans.RUN[name](spark, folder)
    types = dict(got.dtypes)
    got = got.toPandas()
    took = time.time() - t
    if name not in plans.SQL:
        return f"rows-only {len(got)} ({took:.1f}s)"
    rel = con.sql(plans.SQL[name])
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    want = rel.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"FAIL rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    notes = [f"{c}:{types[c]}/{want_types[c]}" for c in types if same.get(types[c]) != want_types[c]]
    for c in a.columns:
        bad = [i for i in range(len(a)) if not (a[c][i] == b[c][i] or (a[c][i] is None and b[c][i] is None)
                                                or (pd.isna(a[c][i]) and pd.isna(b[c][i])))]
        if bad:
            i = bad[0]
            return f"FAIL {c}: {len(bad)} of {len(a)} differ, first {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
    return f"ok {len(got)} rows ({took:.1f}s)" + (f" TYPES {notes}" if notes else "")


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(plans.RUN)
    names = [m for n in names for m in (plans.RUN if n == "all" else [n])]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        try:
            res = compare(spark, con, folder, name)
        except Exception as e:
            res = "FAIL " + type(e).__name__ + " " + str(e)[:600]
        if res.startswith("FAIL"):
            failed.append(name)
        print(f"{name}: {res}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
