import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stitchspark.functions import ordered, semantics


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    rng = np.random.default_rng(3)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.integers(0, 50, 400))]
    rows += [(f"k{j}", i, float(v)) for j in range(5) for i, v in enumerate(rng.integers(0, 50, 9 + j))]
    return spark.createDataFrame(rows, "k string, seq bigint, v double").repartition(5), pd.DataFrame(rows, columns=["k", "seq", "v"])


@pytest.mark.parametrize("rows", [1, 7, 400, 10000])
def test_previous_values_cross_block_borders(skewed, rows):
    df, pdf = skewed
    got = ordered.previous_values(df, ["k"], "seq", {"p": "v"}, rows).toPandas().sort_values(["k", "seq"])
    want = pdf.sort_values(["k", "seq"]).groupby("k")["v"].shift(1)
    assert len(got) == len(pdf)
    np.testing.assert_array_equal(got["p"].fillna(-1).to_numpy(), want.fillna(-1).to_numpy())


@pytest.mark.parametrize("rows", [7, 10000])
def test_running_totals(skewed, rows):
    df, pdf = skewed
    got = ordered.running_totals(df, ["k"], "seq", {"t": F.col("v")}, rows).toPandas().sort_values(["k", "seq"])
    want = pdf.sort_values(["k", "seq"]).groupby("k")["v"].cumsum()
    np.testing.assert_allclose(got["t"].to_numpy(), want.to_numpy())


def test_order_number_is_a_dense_position(skewed):
    df, pdf = skewed
    got = ordered.order_number(df, ["k"], [F.col("v").desc(), F.col("seq")], F.floor(-F.col("v") / 10), "n").toPandas()
    s = pdf.sort_values(["k", "v", "seq"], ascending=[True, False, True])
    s["n"] = s.groupby("k").cumcount() + 1
    m = got.merge(s, on=["k", "seq"])
    assert len(m) == len(pdf) and (m["n_x"] == m["n_y"]).all()


@pytest.mark.parametrize("width", [0.5, 10.0, 1000.0])
def test_grouped_quantiles(skewed, width):
    df, pdf = skewed
    got = ordered.grouped_quantiles(df, ["k"], "v", {"med": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}, width).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["med", "p99", "lo", "hi"]].to_numpy(float), np.percentile(g["v"], [50, 99, 0, 100]))


def test_number_dialects(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("True",), ("1.0d",), ("nan",), ("inf",), ("",), (None,), ("1e3",), ("-.5",)], "c string")
    rows = df.select(semantics.num("c", -1.0).alias("sane"), semantics.num("c", dialect="strict").alias("strict"), semantics.flag("c").alias("f")).toPandas()
    assert rows["sane"].tolist() == [1.5, 2.0, -1.0, -1.0, -1.0, -1.0, -1.0, -1.0, 1000.0, -0.5]
    assert rows["strict"].tolist()[2:4] == [0.0, 0.0] and np.isnan(rows["strict"][4]) and np.isinf(rows["strict"][5])
    assert rows["f"].tolist()[2] and not rows["f"].tolist()[6]


def test_half_even_and_norms(spark):
    r = spark.range(1).select(semantics.half_even(F.lit(0.125), 2).alias("a"), semantics.half_even(F.lit(2.5)).alias("b"),
                              semantics.clipped(F.lit(5.0), 0).alias("c"), semantics.minmax_norm(F.lit(3.0), F.lit(1.0), F.lit(1.0)).alias("d"),
                              semantics.minmax_norm(F.lit(3.0), F.lit(1.0), F.lit(5.0), invert=True).alias("e")).first()
    assert tuple(r) == (0.12, 2.0, 0.0, 0.0, 0.5)
