"""Exact selection: brackets forced small, ties, nulls, several key types."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators import selection
from churnlens.operators.ranking import exact_quantiles, ntile_score
from churnlens.operators.selection import Wanted, counts_of, select_keys, select_ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    # half of the values are equal, a tenth is null
    data = [(i, None if i % 10 == 0 else 7.5 if i % 2 else round(rng.gauss(0, 50), 2), f"k{rng.randrange(10**9):09d}")
            for i in range(3000)]
    return spark.createDataFrame(data, "id long, x double, name string").repartition(5).cache(), data


@pytest.mark.parametrize("inside", [20, 300, 10**6])
def test_selected_ranks(rows, inside):
    df, data = rows
    values = sorted(v for _, v, _ in data if v is not None)
    (n, known), = counts_of(df, [("x", None)])
    assert (n, known) == (3000, len(values))
    wanted = [Wanted("x", r, None, known) for r in (0, 1, 700, 1350, 2000, known - 1, known, n - 1)]
    select_ranks(df, wanted, inside)
    for w in wanted:
        if w.rank < known:
            assert w.value == values[w.rank] and w.below == values.index(w.value)
        else:
            assert w.value is None and w.below == known


@pytest.mark.parametrize("keys", [["x", "id"], ["x", "name"], ["name"]])
def test_selected_keys(rows, keys):
    df, data = rows
    at = {"id": 0, "x": 1, "name": 2}
    order = sorted(tuple((r[at[k]] is None, r[at[k]]) for k in keys) for r in data)
    ranks = [0, 599, 1200, 1500, 2400, 2850, 2999]
    for rank, cut in zip(ranks, select_keys(df, keys, ranks, inside=50)):
        want = [v for _, v in order[rank]][:len(cut)]
        assert list(cut) == want
        before = [k for k in order if k[:len(cut)] < tuple((v is None, v) for v in cut)]
        assert len(before) == rank  # a shorter tuple begins a tie


@pytest.mark.parametrize("tiles", [5, 7, 4000])
@pytest.mark.parametrize("tiebreak", ["id", "name"])
def test_tiles_are_ntile(rows, tiles, tiebreak, monkeypatch):
    monkeypatch.setattr(selection, "INSIDE", 100)
    df, _ = rows
    got = ntile_score(df, "x", tiebreak, tiles)
    order = Window.orderBy(F.col("x").asc_nulls_last(), tiebreak)
    assert got.withColumn("w", F.ntile(tiles).over(order)).filter("tile <> w").count() == 0


def test_quantiles_move_no_rows(rows):
    df, data = rows
    out = exact_quantiles(df.withColumn("g", F.col("id") % 2 == 0), "x", [0.25, 0.5, 0.9], by=["g"], max_groups=2)
    import numpy as np
    for r in out.collect():
        x = [v for i, v, _ in data if v is not None and (i % 2 == 0) == r.g]
        assert r.n == len(x) and np.allclose([r.q0, r.q1, r.q2], np.quantile(x, [0.25, 0.5, 0.9]))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    none = exact_quantiles(df.filter("x > 1e9"), "x", [0.5]).collect()
    assert [(r.n, r.q0) for r in none] == [(0, None)]
