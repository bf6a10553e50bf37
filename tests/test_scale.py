"""Exactness of the scalable building blocks, on skewed data, against plain Python."""

import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyshop.functions import scale


def hot_frame(spark, n=3000, seed=7):
    """A third of the rows share one key and one value."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 400, n))
    value = np.where(key == 0, 5, rng.integers(0, 100, n))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "key": key, "value": value}))


def test_global_running_matches_cumsum(spark):
    df = hot_frame(spark)
    out = scale.global_running(df, ["value", "id"], {"rn": F.lit(1).cast("long"), "total": "value"}).toPandas()
    expected = df.toPandas().sort_values(["value", "id"])
    out = out.sort_values("rn")
    assert out["id"].tolist() == expected["id"].tolist()
    assert out["rn"].tolist() == list(range(1, len(expected) + 1))
    assert out["total"].tolist() == expected["value"].cumsum().tolist()


def test_global_running_descending(spark):
    df = hot_frame(spark)
    out = scale.with_row_number(df, [F.col("value").desc(), F.col("id")]).orderBy("rn").toPandas()
    expected = df.toPandas().sort_values(["value", "id"], ascending=[False, True])
    assert out["id"].tolist() == expected["id"].tolist()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_percentiles_match_linear_interpolation(spark, values, probabilities):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = scale.percentile_rows(df, "v", sorted(set(probabilities))).collect()
    for row in rows:
        assert row["value"] == pytest.approx(np.quantile(values, row["probability"]), rel=1e-9, abs=1e-6)
    assert len(rows) == len(set(probabilities))


def test_percentiles_per_group(spark):
    df = hot_frame(spark)
    out = {r["key"]: (r["a"], r["b"]) for r in scale.percentile_table(df, "value", {"a": 0.25, "b": 0.9}, ("key",)).collect()}
    expected = df.toPandas().groupby("key")["value"]
    for key, values in expected:
        assert out[key] == pytest.approx((values.quantile(0.25), values.quantile(0.9)))


def test_percentile_of_known_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert scale.percentile_rows(df, "v", [0.25]).first()["value"] == 1.75


def test_average_ranks_with_ties(spark):
    df = hot_frame(spark, 500)
    counts = df.groupBy("value").agg(F.count("*").alias("n"))
    ranks = {r["value"]: r["rank"] for r in scale.value_ranks(counts, "value", "n").collect()}
    plain = df.toPandas()
    assert [ranks[v] for v in plain["value"]] == plain["value"].rank(method="average").tolist()


def test_rank_statistics_with_a_hot_value(spark):
    from tallyshop.operators.statistics import group_ranks, spearman

    df = hot_frame(spark, 1200)
    plain = df.toPandas()
    expected = plain["key"].rank().corr(plain["value"].rank())
    assert spearman(df, "key", "value").first()["r"] == pytest.approx(expected, abs=1e-12)
    sums = {r["key"]: (r["n"], r["rank_sum"]) for r in group_ranks(df, "value", "key").collect()}
    ranks = plain.assign(r=plain["value"].rank()).groupby("key")["r"]
    assert sums == {k: (float(len(v)), pytest.approx(v.sum())) for k, v in ranks}


def test_salted_lookup_equals_plain_join(spark):
    df = hot_frame(spark)
    dimension = spark.range(0, 350).select(F.col("id").alias("key"), (F.col("id") * 2).alias("double_key"))
    plain = df.join(dimension, "key", "left").toPandas().sort_values("id").reset_index(drop=True)
    salted = scale.salted_lookup(df, dimension, "key", share=0.05, salts=8).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, salted[plain.columns])
    assert scale.frequent_keys(df, "key", 0.05) == [0]


def test_order_gaps_of_a_hot_customer(spark):
    from tallyshop.operators.questions import median_order_gap, order_gaps

    rng = np.random.default_rng(3)
    customers = np.where(rng.random(4000) < 1 / 3, 1, rng.integers(2, 300, 4000))
    days = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 200, 4000), unit="D")
    pdf = pd.DataFrame({"customer_id": customers, "order_date": days.date})
    gaps = pdf.assign(order_date=pd.to_datetime(pdf.order_date)).sort_values(["customer_id", "order_date"])
    gaps = gaps.groupby("customer_id")["order_date"].diff().dt.days.dropna()
    orders = spark.createDataFrame(pdf)
    assert median_order_gap(orders).first()[0] == gaps.median()
    counted = {r["gap"]: r["n"] for r in order_gaps(orders).collect()}
    assert counted == gaps.astype(int).value_counts().to_dict()


@pytest.mark.parametrize("parts", [1, 9])
def test_running_totals_of_any_kind_of_order(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else float(rng.choice([0.5, 1.5, -2.0, float("nan")])), None if i % 7 == 0 else int(i % 5), f"k{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x double, n int, s string").repartition(parts)
    for order, plain in (
        ([("x", "desc"), "id"], [F.col("x").desc(), "id"]), ([("n", "desc"), "s", ("id", "desc")], [F.col("n").desc(), "s", F.col("id").desc()]),
        (["s", "x", "id"], ["s", "x", "id"]), ([F.col("n").desc(), F.col("id").asc()], [F.col("n").desc(), "id"]),
    ):
        found = [r.id for r in scale.with_row_number(df, order).orderBy("rn").collect()]
        assert found == [r.id for r in df.orderBy(*plain).collect()]
    with pytest.raises(ValueError):
        scale.with_row_number(df, [("s", "desc"), "id"])
    with pytest.raises(ValueError):
        scale.with_row_number(df, [(F.col("n") + 1).desc(), "id"])
    assert scale.with_row_number(df.limit(0), ["id"]).collect() == []


def test_running_totals_move_rows_once(spark):
    df = spark.range(5000).select("id", (F.col("id") % 17).cast("double").alias("v"))
    plan = scale.global_running(df, [("v", "desc"), "id"], {"total": "v"})._jdf.queryExecution().optimizedPlan().toString()
    found = scale.global_running(df, [("v", "desc"), "id"], {"total": "v"})
    explained = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    main = explained.split("Subqueries")[0]
    assert "CartesianProduct" not in plan and main.count("Exchange hashpartitioning(_part") <= 2 and "rangepartitioning" not in main


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 31, 32])
def test_buckets_are_found_by_binary_search(spark, n):
    """As many edges at or below the key as a scan of all of them finds, nulls first, ties included."""
    edges = [None, *range(3, 3 * n, 3)][:n]
    rows = spark.createDataFrame([(v,) for v in [None, -1, *range(3 * n + 2)]], "v int")
    cells = F.array(*[F.struct(F.lit(e).cast("int").alias("f0")) for e in edges]) if edges else F.array().cast("array<struct<f0:int>>")
    key = F.struct(F.col("v").alias("f0"))
    scan = F.size(F.filter("e", lambda e: e <= key))
    found = rows.withColumn("e", cells).select(scale._edges_passed("e", key, 32).alias("a"), scan.alias("b"))
    assert found.where("a <> b OR a IS NULL").count() == 0


def test_outlier_bounds_read_the_table_once(spark):
    from tallyshop.operators.quality import iqr_outliers

    read = spark.sparkContext.accumulator(0)

    def watched(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    table = spark.createDataFrame([(float(v),) for v in [*range(100), 1000, -1000]], "v double").mapInPandas(watched, "v double")
    row = iqr_outliers(table, ["v"]).first()
    assert (row["below"], row["above"], read.value) == (1, 1, 102)


def test_tasks_get_smaller_shares_of_a_larger_shuffle(spark):
    """More partitions than spark.sql.shuffle.partitions where the rows need them."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        sums = spark.range(300_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count("*").alias("n"))
        parts = sums.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert parts > 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_settings_of_the_session_stay(spark):
    from tallyshop.session import TASK_SETTINGS, tune

    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "5m")
    tune(other)
    assert other.conf.get("spark.sql.files.maxPartitionBytes") == "5m"
    assert all(other.conf.get(key) == value for key, value in TASK_SETTINGS.items() if not key.startswith("spark.sql.files"))


def test_products_listed_twice_count_once_per_snapshot(spark):
    from tallyshop.operators.daily import DailySpec, inventory_snapshots

    rows = [("2000-01-31", p, 1, 1, 1, 1.0, 1.0, 0, 0, 0.5, "A", "S") for p in (1, 1, 2, None, None)] + [("2000-02-29", 1, 1, 1, 1, 1.0, 1.0, 0, 0, 0.5, "A", "S")]
    names = "snapshot_date string, product_id long, stock_on_hand long, units_received long, units_sold long, days_of_supply double, fill_rate double, stockout_flag int, overstock_flag int, sell_through_rate double, category string, segment string"
    out = inventory_snapshots(spark.createDataFrame(rows, names), DailySpec("2000-01-01", "2000-12-31", category=["A"], segment=["S"])).orderBy("snapshot_date")
    assert [(r["unique_products_in_stock"], r["total_stock_on_hand"]) for r in out.collect()] == [(2, 5), (1, 1)]
    import contextlib
    import io

    with contextlib.redirect_stdout(text := io.StringIO()):
        out.explain()
    assert "partial_sum" in text.getvalue() and "HashAggregate(keys=[snapshot_date" in text.getvalue() and ", product_id" not in "".join(re.findall(r"HashAggregate\(keys=\[(.*?)\]", text.getvalue()))


def test_daily_summaries_join_without_sorts(spark, catalog):
    """Summaries of one row per day: no sorted join, however large Spark takes them to be."""
    import contextlib
    import io

    from tallyshop.operators.daily import DailySpec, on_spine

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(1000).select(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("date"), "id")
        parts = [facts.groupBy("date").agg(F.sum("id").alias(name)) for name in ("a", "b", "c")]
        out = on_spine(catalog(), DailySpec("2000-01-01", "2000-03-31"), *parts)
        with contextlib.redirect_stdout(text := io.StringIO()):
            out.explain()
        rows = out.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("c").alias("c")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in text.getvalue() and tuple(rows) == (91, 499500, 499500)
