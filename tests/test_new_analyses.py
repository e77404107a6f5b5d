"""Key report, narrow duplicates, survival, rank sum, sketches, publishing."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import keys, profile, ranksum, sketches, survival

SF = "/root/testdata/sf0.001"


def test_key_report_finds_planted_faults(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id int")
    children = spark.createDataFrame([(1, 9)] * 50 + [(2, 8), (7, 8), (7, 8), (None, 8)], "pid int, own int")
    got = {(r.table_name, r.key_column): r for r in keys.key_report(
        {"p": parents, "c": children}, {"p": "id"}, {("c", "pid"): "p"}).collect()}
    p, c = got["p", "id"], got["c", "pid"]
    assert (p.n_rows, p.n_null, p.n_distinct, p.n_duplicate_keys, p.n_orphans) == (5, 1, 3, 1, None)
    assert (c.n_rows, c.n_null, c.n_distinct, c.n_duplicate_keys, c.n_orphans) == (54, 1, 3, 2, 2)
    assert c.refers_to == "p"


@pytest.mark.parametrize("bits", [4, 128])
def test_duplicates_are_exact_under_hash_collisions(spark, bits):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([0.0, -0.0, 1.5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    assert keys.duplicate_rows_by_hash(df, "t", bits).collect() == profile.duplicate_rows(df, "t").collect()
    assert keys.duplicate_rows_by_hash(df.limit(0), "t", bits).first().n_duplicates == 0


def test_narrow_pass_shuffles_two_longs(spark):
    df = spark.range(100).withColumn("wide", F.repeat(F.lit("x"), 500))
    plan = keys.duplicate_rows_by_hash(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    counted = [line for line in plan.split("\n") if "Aggregate [_h1" in line]
    assert counted and not any("wide" in line for line in counted)


def test_survival_matches_plain_product_limit(spark):
    rng = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    events = [(p, start + dt.timedelta(days=rng.randrange(40)), i) for i, p in enumerate(rng.choices(range(60), k=110))]
    df = spark.createDataFrame([*events, (None, start, 999)], "p int, ts timestamp_ntz, o int")
    snap = spark.createDataFrame([(start + dt.timedelta(days=41),)], "snapshot timestamp_ntz")
    times = survival.time_to_kth(df, "p", "ts", "o", snap)
    want = {}
    for p in {e[0] for e in events}:
        at = sorted(t for q, t, _ in events if q == p)
        want[p] = ((at[1] if len(at) > 1 else start + dt.timedelta(days=41)) - at[0]).days, len(at) > 1
    assert {r.p: (r.day, r.happened) for r in times.collect()} == want
    alive, held = {}, 1.0
    for day in sorted({d for d, _ in want.values()}):
        risk = sum(d >= day for d, _ in want.values())
        held *= 1 - sum(d == day and e for d, e in want.values()) / risk
        alive[day] = round(held, 6)
    assert {r.day: r.survival for r in survival.survival_curve(times).collect()} == pytest.approx(alive, abs=1e-6)


def test_rank_sum_with_half_the_values_tied(spark):
    rng = np.random.default_rng(5)
    v = np.where(rng.random(900) < 0.5, 2.0, rng.normal(0, 3, 900).round(1))
    f = rng.random(900) < 0.3
    df = spark.createDataFrame([*zip(v.tolist(), f.tolist()), (None, True), (1.0, None)], "v double, f boolean")
    r = ranksum.rank_sum(df, "v", "f", num_partitions=7).first()
    order = np.sort(v)
    mid = (np.searchsorted(order, v) + np.searchsorted(order, v, side="right") + 1) / 2
    a, b = f.sum(), (~f).sum()
    u = mid[f].sum() - a * (a + 1) / 2
    ties = sum(n ** 3 - n for n in np.unique(v, return_counts=True)[1].tolist())
    z = (u - a * b / 2) / np.sqrt(a * b / 12 * (900 + 1 - ties / (900 * 899)))
    assert (r.n_true, r.n_false, r.u) == (a, b, u) and abs(r.z - z) < 1e-5
    assert abs(r.positive_pct_true - 100 * (v[f] > 0).mean()) < 1e-5
    same = ranksum.rank_sum(spark.createDataFrame([(1.0, True), (1.0, False)], "v double, f boolean"), "v", "f").first()
    assert same.z is None and same.u == 0.5


def test_sketches_unite_and_intersect(spark):
    df = spark.range(60000).select((F.col("id") % 3).cast("int").alias("m"), (F.col("id") % 20011).alias("who"),
                                   F.col("id").alias("o"))
    entities = {"people": "who", "orders": "o"}
    stored = sketches.period_sketches(df, "m", entities, "who")
    got = sketches.union_counts(stored, entities).first()
    whole = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), sketches.HLL_LG)).alias(n)
                     for n, c in entities.items()]).first()
    error = 3 * 1.04 / 2 ** (sketches.HLL_LG / 2)
    for name, exact in (("people", 20011), ("orders", 60000)):
        assert abs(got[name] - whole[name]) <= 0.01 * whole[name] and abs(got[name] - exact) <= error * exact
    shared = {r.m: (r.persons, r.shared_with_next) for r in
              sketches.shared_with_next(stored, "m", lambda m: m + 1).collect()}
    people = {m: {r.who for r in df.filter(f"m = {m}").select("who").distinct().collect()} for m in range(3)}
    assert shared == {m: (len(people[m]), len(people[m] & people[m + 1]) if m < 2 else 0) for m in range(3)}


def test_a_failed_run_leaves_the_old_manifest(spark, tmp_path):
    from churnlens.plans import outputs
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        outputs.published(spark, path)
    some = {"review_retention": ("review_retention", ("csv", "parquet"))}
    run = outputs.run_outputs(spark, SF, path, some)
    rows = outputs.read_output(spark, path, "review_retention", "csv").collect()
    assert rows and sorted(rows) == sorted(outputs.read_output(spark, path, "review_retention", "parquet").collect())
    with pytest.raises(KeyError):
        outputs.run_outputs(spark, SF, path, {**some, "broken": ("no_such_analysis", ("csv",))})
    assert outputs.published(spark, path)["run"] == run
    assert sorted(outputs.read_output(spark, path, "review_retention", "csv").collect()) == sorted(rows)
    assert outputs.run_outputs(spark, SF, path, some) == outputs.published(spark, path)["run"] != run


def test_workers_import_the_package_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
e.entry(spark)
def run(batches):
    import churnlens
    yield from batches
assert spark.range(3).mapInArrow(run, "id long").count() == 3
print("works")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "works" in got.stdout, got.stderr[-2000:]


def test_master_nulls_equal_those_of_the_master_table(spark):
    from churnlens.operators import master
    stamp = "timestamp_ntz'2020-01-01 00:00:00'"
    orders = spark.sql("SELECT * FROM VALUES (1L, 'a', 'delivered'), (2L, 'b', 'shipped'), (3L, 'c', NULL), (NULL, 'd', 'x') "
                       "AS t(order_id, customer_id, order_status)")
    for c in master.ORDER_COLS[3:]:
        orders = orders.selectExpr("*", f"IF(order_id = 2, NULL, {stamp}) AS {c}")
    customers = spark.sql("SELECT *, 1 AS customer_zip_code_prefix, 'x' AS customer_city, 'y' AS customer_state FROM VALUES "
                          "('a', 7L), ('c', NULL), ('c', 8L) AS t(customer_id, customer_unique_id)")
    items = spark.sql(f"SELECT *, 5L AS seller_id, {stamp} AS shipping_limit_date, 1.0 AS freight_value FROM VALUES "
                      "(1L, 1, 10L, 2.5), (1L, 2, 11L, NULL), (3L, 1, NULL, 1.0), (3L, 2, 12L, 1.0), (NULL, 1, 10L, NULL), (9L, 1, 10L, 1.0) "
                      "AS t(order_id, order_item_id, product_id, price)")
    products = spark.sql("SELECT * FROM VALUES (10L, 'p'), (11L, NULL), (12L, 'q') AS t(product_id, product_category_name)")
    labels = spark.sql("SELECT * FROM VALUES ('p', 'P') AS t(product_category_name, product_category_name_english)")
    reviews = spark.sql("SELECT * FROM VALUES ('r', 1L, 4), ('s', 1L, NULL), ('t', NULL, 1) AS t(review_id, order_id, review_score)")
    tables = (orders, customers, items, products, labels, reviews)
    cols = list(master.MASTER_COLS)
    got = master.master_nulls(*tables, cols).first().asDict()
    rows = [r.asDict() for r in master.master_table(*tables).collect()]
    assert got == {"n_rows": len(rows), **{c: sum(r[c] is None for r in rows) for c in cols}}
    none = [t.limit(0) for t in tables]
    assert set(master.master_nulls(*none, cols).first()) == {0}


def test_categories_against_the_rate_of_all(spark):
    from churnlens.operators.drivers import category_against_overall
    rows = [("a", i < 3) for i in range(10)] + [("b", i < 1) for i in range(4)] + [(None, True)] * 2
    fo = spark.createDataFrame([(i, c, f) for i, (c, f) in enumerate(rows)],
                               "person long, product_category_name_english string, is_repeat boolean")
    got = category_against_overall(fo, "person", 5).collect()
    assert [tuple(r) for r in got] == [("a", 10, 3, 30.0, 37.5, -7.5, 0.8)]
    assert category_against_overall(fo.limit(0), "person", 0).count() == 0


def test_source_csvs_come_back(spark, tmp_path):
    from churnlens.sources.files import read_source_csvs, write_source_csvs
    from churnlens.sources.schemas import SCHEMAS, TIMESTAMP_COLUMNS
    from churnlens.sources.testdata import TestTables
    tables = TestTables(spark, "/root/testdata/sf0.001").all()
    write_source_csvs(tables, str(tmp_path))
    back = read_source_csvs(spark, str(tmp_path))
    for name, df in tables.items():
        want = df.select([F.col(f.name) if f.name in TIMESTAMP_COLUMNS.get(name, ()) else F.col(f.name).cast(f.dataType)
                          for f in SCHEMAS[name]])
        got = back[name]
        assert got.columns == SCHEMAS[name].names
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0, name


def test_published_run_stages_delivered_rows_only(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from churnlens.plans import catalog, outputs
    from churnlens.sources.testdata import RAW_SCHEMAS
    day = datetime(2020, 1, 1)
    rows = {"region": [(0, "R")], "nation": [(0, "N", 0)], "customer": [(i, "c", 0, 1.0, "m") for i in range(6)],
            "supplier": [(0, "s", 0, 1.0)], "part": [(0, "p", "b", "SMALL", 2, 1.0)],
            "orders": [(i, i % 6, "FOP"[i % 3], 9.0, day, "1-X") for i in range(30)] + [(99, 0, "F", 9.0, day, "1-X")],
            "lineitem": [(i, 0, 0, 1, 5.0, 10.0 + i, 0.0, 0.1, "R", "F", day) for i in range(30)]}
    for name, values in rows.items():
        spark.createDataFrame(values, RAW_SCHEMAS[name]).write.parquet(f"{tmp_path}/in/{name}.parquet")
    seen, real = [], catalog.write_stage

    def staged(df):
        out = real(df)
        if "order_status" in df.columns:
            seen.extend(r[0] for r in out.select("order_status").collect())
        return out

    monkeypatch.setattr(catalog, "write_stage", staged)
    chosen = {k: outputs.OUTPUTS[k] for k in ("master_delivered", "first_orders_analysis")}
    outputs.run_outputs(spark, f"{tmp_path}/in", f"{tmp_path}/out", chosen)
    assert seen == ["delivered"] * 10  # the other orders' rows are neither joined nor written
    assert outputs.read_output(spark, f"{tmp_path}/out", "master_delivered").count() == 10
    with catalog.suite(spark, f"{tmp_path}/in", stage_master=False) as a:
        assert a.delivered.count() == 10 and a.master.count() == 31
