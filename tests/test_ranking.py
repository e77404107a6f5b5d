"""Distributed exact ranking vs the single-partition built-ins and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators.ranking import (
    exact_quantiles, first_row_per_key, global_rank, ntile_score, quantile_bin, quantile_bins,
)


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 50, n).astype(float)
    x[rng.random(n) < 0.5] = 7.0           # one value holds half of the rows
    x[rng.random(n) < 0.1] = np.nan        # and some nulls
    pdf = pd.DataFrame({"id": np.arange(n), "x": x})
    return spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))


def test_global_rank_is_row_number(spark):
    df = _skewed(spark)
    ours = global_rank(df, ["x", "id"], "rk").select("id", "rk")
    ref = df.withColumn("rn", F.row_number().over(
        Window.orderBy(F.col("x").asc_nulls_last(), "id"))).select("id", "rn")
    bad = ours.join(ref, "id").filter(F.col("rk") != F.col("rn")).count()
    assert bad == 0 and ours.count() == df.count()


@pytest.mark.parametrize("tiles", [5, 7, 4000])
def test_ntile_matches_builtin(spark, tiles):
    df = _skewed(spark)
    ours = ntile_score(df, "x", "id", tiles, out="t").select("id", "t")
    ref = df.withColumn("b", F.ntile(tiles).over(
        Window.orderBy(F.col("x").asc_nulls_last(), "id"))).select("id", "b")
    assert ours.join(ref, "id").filter(F.col("t") != F.col("b")).count() == 0


def test_ntile_sizes_and_invert(spark):
    df = spark.range(7).withColumn("v", F.col("id") * 10)
    got = {r.id: r.t for r in ntile_score(df, "v", "id", 5, out="t").collect()}
    sizes = pd.Series(got).value_counts().sort_index().tolist()
    assert sizes == [2, 2, 1, 1, 1]
    inv = {r.id: r.t for r in ntile_score(df, "v", "id", 5, out="t", invert=True).collect()}
    assert all(inv[i] == 6 - got[i] for i in got)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "v": rng.normal(10, 4, 2000).round(2)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0]
    got = exact_quantiles(df, "v", probs, by=["g"]).collect()
    for r in got:
        exp = np.quantile(pdf.loc[pdf.g == r.g, "v"], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], exp, rtol=0, atol=1e-9)


def test_quantile_bin_matches_qcut(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(1500), "v": rng.integers(0, 400, 1500).astype(float)})
    df = spark.createDataFrame(pdf)
    got = quantile_bin(df, "v", out="b").toPandas().sort_values("id")
    exp = pd.qcut(pdf["v"], q=5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert (got["b"].to_numpy() == exp.to_numpy()).all()


def test_quantile_bins_two_columns_one_pass(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(800), "a": rng.random(800), "b": rng.random(800) * 7})
    got = quantile_bins(spark.createDataFrame(pdf), {"ba": "a", "bb": "b"},
                        [0.2, 0.4, 0.6, 0.8]).toPandas().sort_values("id")
    for out, col in (("ba", "a"), ("bb", "b")):
        exp = pd.qcut(pdf[col], q=5, labels=False) + 1
        assert (got[out].to_numpy() == exp.to_numpy()).all()


def test_quantile_bin_edges_and_duplicates(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "v double")
    bins = {r.v: r.b for r in quantile_bin(df, "v", out="b").collect()}
    # edges 2.8, 4.6, 6.4, 8.2: minimum in bin 1, right-closed
    assert bins[1.0] == 1 and bins[2.0] == 1 and bins[3.0] == 2 and bins[10.0] == 5
    ties = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "v double")
    with pytest.raises(Exception, match="unique"):
        quantile_bin(ties, "v", out="b").collect()
    dropped = quantile_bin(ties, "v", out="b", on_duplicate="drop").collect()
    assert {r.v: r.b for r in dropped}[1.0] == 1


def test_first_row_per_key_total_order(spark):
    rows = [("p", "2018-01-01 10:00:00", "o2", 1, 9.0), ("p", "2018-01-01 10:00:00", "o1", 2, 5.0),
            ("p", "2018-01-01 10:00:00", "o1", 1, 7.0), ("q", None, "o3", 1, 1.0),
            ("q", "2019-01-01 00:00:00", "o4", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, ts string, o string, i int, v double")
    got = {r.k: (r.o, r.i) for r in first_row_per_key(df, "k", ["ts", "o", "i"]).collect()}
    assert got == {"p": ("o1", 1), "q": ("o4", 1)}  # null timestamp sorts last


def test_quantile_bin_labels_and_describe_by(spark):
    from churnlens.operators.profile import describe_by
    df = spark.createDataFrame([(float(v), v % 2 == 0) for v in range(1, 11)], "v double, g boolean")
    lab = {r.v: r.b_label for r in quantile_bin(df, "v", out="b", labels=list("abcde")).collect()}
    assert lab[1.0] == "a" and lab[10.0] == "e"
    d = {r.g: r for r in describe_by(df, "v", "g").collect()}
    evens = np.array([2, 4, 6, 8, 10], dtype=float)
    assert d[True]["count"] == 5 and d[True].mean == 6.0 and d[True].p50 == 6.0
    assert d[True].std == round(float(evens.std(ddof=1)), 2)
    assert d[True].p25 == float(np.quantile(evens, 0.25))


def test_range_partitions_stay_balanced_under_a_hot_value(spark):
    df = _skewed(spark, n=4000)  # half of the rows hold x = 7
    ranked = global_rank(df, ["x", "id"], "rk", num_partitions=8)
    sizes = [r[1] for r in ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 0.25 * 4000
    q = exact_quantiles(df, "x", [0.5, 0.9])  # ties get a position tiebreak internally
    exp = np.quantile(df.filter(F.col("x").isNotNull()).toPandas()["x"], [0.5, 0.9])
    r = q.first()
    assert np.allclose([r.q0, r.q1], exp)


def test_approx_quantiles_close_to_exact(spark):
    from churnlens.operators.ranking import approx_quantiles
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 5000), "v": rng.normal(50, 10, 5000)})
    got = {r.g: r for r in approx_quantiles(spark.createDataFrame(pdf), "v", [0.25, 0.5, 0.75],
                                            by=["g"]).collect()}
    for g, r in got.items():
        vals = np.sort(pdf.loc[pdf.g == g, "v"].to_numpy())
        for i, p in enumerate([0.25, 0.5, 0.75]):
            # the returned value's rank is within 1 % of the target rank
            rank = np.searchsorted(vals, r[f"q{i}"]) / len(vals)
            assert abs(rank - p) < 0.01
