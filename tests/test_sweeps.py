"""Sweeps whose means lie on ties of the last digit: the order in which doubles are added decides them."""

import datetime

import duckdb
import pandas as pd
import pytest

from stitchspark import plans

# Added up one by one, 1 less these has a mean that rounds to 0.9638; added up in two halves, to 0.9637.
TIE = (0.0, 0.07, 0.04, 0.03, 0.09, 0.01, 0.05, 0.0)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Lines in two files, which are read by two tasks; a group's rows lie in both."""
    row = lambda supplier, status, discount, quantity: {
        "l_orderkey": 1, "l_partkey": 3, "l_suppkey": supplier, "l_linenumber": 1, "l_quantity": quantity, "l_extendedprice": 100.0, "l_discount": discount, "l_tax": 0.02,
        "l_returnflag": "A", "l_linestatus": status, "l_shipdate": datetime.datetime(1996, 5, 1)}
    tie = [row(1, "F", d, 5.0) for d in TIE]
    others = [row(1, "O", 0.0, 5.0), row(2, "F", 0.0362, 40.0), row(2, "O", 0.0, 40.0)]
    out = tmp_path_factory.mktemp("sweeps")
    (out / "lineitem.parquet").mkdir()
    for i, rows in enumerate((tie[:4] + others, tie[4:])):
        pd.DataFrame(rows).astype({"l_linenumber": "int32", "l_shipdate": "datetime64[us]"}).to_parquet(out / "lineitem.parquet" / f"part-{i}.parquet")
    return out


def rows_of_sql(folder, name):
    con = duckdb.connect()
    con.sql("SET threads = 1")  # with more, the order of its sums is open
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return sorted(map(tuple, con.sql(plans.SQL[name]).fetchall()))


def test_robust_policies_add_in_the_order_of_rows(spark, folder):
    got = sorted(map(tuple, plans.RUN["robust_policies"](spark, str(folder)).collect()))
    assert got == rows_of_sql(folder, "robust_policies")
    assert {(r[1], r[6]) for r in got} == {(1, 0.9638), (2, 0.9638)}


def test_robust_picks_where_a_tie_decides(spark, folder):
    got = sorted(map(tuple, plans.RUN["robust_picks"](spark, str(folder)).collect()))
    assert got == rows_of_sql(folder, "robust_picks")
    assert ("A", "best_min_coverage", 1, 1996, 1) in got
