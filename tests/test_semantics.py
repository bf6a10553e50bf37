"""Edge cases of the non-standard rules."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyshop.functions import calendar as cal
from tallyshop.functions import columns as c
from tallyshop.functions import spine
from tallyshop.functions.distributions import chi_square_sf, normal_sf, normal_two_sided
from tallyshop.operators import baskets, customers, daily, features, forecast, marts, promotions, quality, statistics
from tallyshop.sources import tables


def values(df, column):
    return [row[column] for row in df.collect()]


def test_quintile_edges_are_value_edges(spark):
    rows = spark.createDataFrame([(i, i, i, float(i)) for i in range(1, 8)], "customer_id int, R int, F int, M double")
    scored = customers.rfm_scores(rows).orderBy("customer_id")
    assert values(scored, "M_score") == [1, 1, 2, 3, 4, 5, 5]
    assert values(scored, "F_score") == [1, 1, 2, 3, 4, 5, 5]
    assert values(scored, "R_score") == [5, 5, 4, 3, 2, 1, 1]


def test_segments_partition_all_scores(spark):
    grid = spark.range(125).select(*[(F.floor(F.col("id") / d) % 5 + 1).alias(n) for n, d in (("r", 1), ("f", 5), ("m", 25))])
    named = grid.select("r", "f", "m", customers.segment_of(F.col("r"), F.col("f"), F.col("m")).alias("s")).toPandas()
    assert named["s"].notna().all()
    assert set(named.query("r >= 4 and f >= 4")["s"]) == {"VIP"}
    assert set(named.query("r < 4 and f >= 4")["s"]) == {"Loyal"}
    assert set(named.query("r <= 2 and f < 4")["s"]) == {"Churn Risk"}


def test_right_closed_cut(spark):
    df = spark.createDataFrame([(0,), (2,), (7,), (8,)], "d int")
    bands = df.select(c.cut("d", [0, 2, 4, 5, 7], ["a", "b", "c", "d"]).alias("x"))
    assert values(bands, "x") == [None, "a", "d", None]


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b")], "k int, v string")
    assert marts.modal_value(df, "k", "v", "m").first()["m"] == "a"


def test_corrected_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    row = statistics.moments(df, ["v"]).first()
    assert row["skewness"] == pytest.approx(1.7636, abs=1e-4)
    assert row["kurtosis"] == pytest.approx(3.2280, abs=1e-4)


def test_recompute_check_with_nothing_sold(spark):
    df = spark.createDataFrame([(10, 0, 0.0), (10, 30, 10.0), (10, 30, 11.0)], "stock_on_hand long, units_sold long, days_of_supply double")
    row = quality.recompute_check(df).first()
    assert (row["rows"], row["matches"]) == (3, 2)


def test_fan_out_guard(spark, catalog):
    items = spark.createDataFrame([(1, 7, 5, 2.0, 0.0, None, None)], "order_id long, product_id long, quantity long, unit_price double, discount_amount double, promo_id string, promo_id_2 string")
    events = spark.createDataFrame([("a", 1, 7, 2, 3.0), ("b", 1, 7, 1, 1.5)], "return_id string, order_id long, product_id long, return_quantity long, refund_amount double")
    cat = catalog(order_items=items, returns=events)
    fact = marts.item_fact(cat, ("returns",))
    row = fact.first()
    assert fact.count() == 1 and row["return_qty"] == 3 and row["refund_amount"] == 4.5 and row["is_returned"] == 1
    assert marts.raw_returned_lines(items, events).count() == 2


def test_as_of_never_reads_the_future(spark):
    days = spine.date_spine(spark, "2020-01-30", "2020-02-02")
    shots = spark.createDataFrame([(date(2019, 12, 31), 1), (date(2020, 1, 31), 2)], "snapshot_date date, stock int")
    days = spine.date_spine(spark, "2020-01-01", "2020-02-02")
    out = {r["date"]: r for r in spine.as_of_daily(days, shots, "date", "snapshot_date", ["stock"]).collect()}
    assert out[date(2020, 1, 31)]["stock"] == 1
    assert (out[date(2020, 2, 1)]["stock"], out[date(2020, 2, 1)]["days_since_snapshot"]) == (2, 1)
    late = spine.as_of_daily(days, shots.where("stock = 2"), "date", "snapshot_date", ["stock"]).orderBy("date").collect()
    assert late[0]["stock"] is None and late[4]["days_since_snapshot"] == 4


def test_customers_known_before_each_day(spark, catalog):
    rows = [(i, "old", date(2019, 12, 1)) for i in range(5)] + [(10, "A", date(2020, 1, 1)), (11, "A", date(2020, 1, 1)), (12, "B", date(2020, 1, 3)), (13, "B", date(2020, 1, 3)), (14, "B", date(2020, 1, 3))]
    people = spark.createDataFrame([(i, city, d, "F", "18-24", "web") for i, city, d in rows], "customer_id long, city string, signup_date date, gender string, age_group string, acquisition_channel string")
    spec = daily.DailySpec("2020-01-01", "2020-01-03", gender=["F"], age_group=["18-24"], acquisition_channel=["web"])
    out = daily.daily_customers(catalog(customers=people), spec).orderBy("date").collect()
    assert [r["customer_cumulative"] for r in out] == [5, 7, 7]
    assert [r["customer_daily_signup"] for r in out] == [2, 0, 3]
    assert [r["unique_cities_cumulative"] for r in out] == [1, 2, 2]
    assert [r["gender_f_cumulative"] for r in out] == [5, 7, 7]


def test_interval_is_clipped_to_the_spine(spark, catalog):
    promo = spark.createDataFrame([("P", "percentage", 10.0, date(2019, 12, 30), date(2020, 1, 2), 5)], "promo_id string, promo_type string, discount_value double, start_date date, end_date date, min_order_value long")
    spec = daily.DailySpec("2019-12-29", "2019-12-31", promo_type=["percentage"])
    out = daily.daily_promotions(catalog(promotions=promo), spec).orderBy("date").collect()
    assert [r["promo_flag"] for r in out] == [0, 1, 1]
    assert [r["flag_min_order_value"] for r in out] == [0, 1, 1]


def series(spark, pairs):
    return spark.createDataFrame([("s", d, v) for d, v in pairs], "series_id string, date date, v double")


def test_range_mean_uses_days_not_rows(spark):
    at = pd.Timestamp("2021-06-01")
    pairs = [((at - pd.Timedelta(days=k)).date(), float(v)) for k, v in ((372, 100), (371, 1), (357, 3), (0, 9))]
    out = series(spark, pairs).withColumn("m", features.centred_year_ago("v", 364, 7)).orderBy(F.desc("date")).first()
    assert out["m"] == 2.0


def test_rolling_needs_a_full_window(spark):
    pairs = [(date(2020, 1, d), float(d)) for d in (1, 2, 3, 4)]
    out = series(spark, pairs).withColumns(features.rolling_features("v", [3, 7])).orderBy("date").collect()
    assert [r["v_rmean3"] for r in out] == [None, None, None, 2.0]
    assert all(r["v_rmean7"] is None for r in out)


def test_nearest_lag_orders(spark):
    at = pd.Timestamp("2021-06-01")
    pairs = [((at - pd.Timedelta(days=k)).date(), float(k)) for k in (0, 362, 367)]
    out = series(spark, pairs).select(
        "date", features.lag_nearest("v", 364).alias("back"), features.lag_nearest("v", 364, alternate=True).alias("turns")
    ).orderBy(F.desc("date")).first()
    assert (out["back"], out["turns"]) == (367.0, 362.0)


def test_churn_of_two_years(spark):
    orders = spark.createDataFrame([("A", date(2020, 5, 1)), ("B", date(2020, 6, 1)), ("B", date(2021, 1, 1)), ("C", date(2021, 2, 1))], "customer_id string, order_date date")
    row = promotions.yearly_churn(orders).first()
    assert (row["churned"], row["retained"], row["new"], row["churn_rate"]) == (1, 1, 1, 50.0)
    assert row["churned"] + row["retained"] == row["prev_active"]


def test_ratio_guard(spark):
    df = spark.createDataFrame([(100.0, r * 100) for r in (1.2, 0.97, 0.80, 0.65, 0.5)], "r double, c double")
    out = values(df.select(forecast.ratio_guard("r", "c").alias("g")), "g")
    assert out == pytest.approx([100.0, 0.6 * 97 + 0.4 * 87.46, 80.0, 0.6 * 65 + 0.4 * 87.46, 61.98])


def test_leap_day_without_profile_counts_as_one(spark):
    days = pd.date_range("2021-01-01", "2022-12-31")
    history = spark.createDataFrame(pd.DataFrame({"series_id": "s", "date": days.date, "v": np.where(days.year == 2021, 10.0, 20.0)}))
    future = spark.createDataFrame([("s", date(2024, 2, 29))], "series_id string, date date")
    out = forecast.seasonal_growth_forecast(history, future, "v", 2021, 2022).first()
    assert out["forecast"] == pytest.approx(20.0 * 2**2)


def test_folds_never_overlap(spark):
    days = spark.createDataFrame([("s", d.date()) for d in pd.date_range("2020-01-01", periods=100)], "series_id string, date date")
    for row in features.fold_bounds(days, 4, 3).collect():
        assert row["train_to"] < row["valid_from"] and row["valid_days"] == 20
        assert (row["valid_from"] - row["train_to"]).days == 4


def test_pareto_reaches_one(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "k int, v double")
    out = customers.pareto(df, "k", "v").orderBy("position").toPandas()
    assert out["cum_pct"].iloc[-1] == pytest.approx(1.0) and out["cum_pct"].is_monotonic_increasing


def test_forward_fill_and_interpolation(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), 1.0), (date(2020, 1, 2), None), (date(2020, 1, 4), 4.0), (date(2020, 1, 5), None)], "date date, v double")
    assert values(spine.linear_interpolate(df, "v", "date").orderBy("date"), "v") == [1.0, 2.0, 4.0, 4.0]


def test_nearest_holiday_and_windows(spark):
    df = spark.createDataFrame([(date(2022, 1, 25),), (date(2022, 2, 1),), (date(2022, 2, 4),)], "date date")
    out = df.withColumns(cal.lunar_features("date")).orderBy("date").collect()
    assert [r["days_to_lunar"] for r in out] == [-7, 0, 3]
    assert [r["is_pre_lunar2w"] for r in out] == [1, 0, 0]
    assert out[1]["lunar_proximity"] == 1.0


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(1.959964,)], "z double")
    row = df.select(
        normal_sf("z").alias("n"), normal_two_sided("z").alias("t"), chi_square_sf(F.lit(3.841459), 1).alias("c1"),
        chi_square_sf(F.lit(5.991465), 2).alias("c2"), chi_square_sf(F.lit(11.0705), 5).alias("c5"),
    ).first()
    assert row["n"] == pytest.approx(0.025, abs=1e-5)
    for name in ("t", "c1", "c2", "c5"):
        assert row[name] == pytest.approx(0.05, abs=1e-5)


def test_multi_item_rules_from_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(o), f"i{int(i)}") for o, i in zip(rng.integers(0, 60, 260), rng.integers(0, 5, 260))})
    items = spark.createDataFrame(pairs, "order_id int, item string")
    sets, n = baskets.frequent_itemsets(items, 0.1)
    got = {(r["antecedent"], r["consequent"]): r for r in baskets.association_rules(sets, n, 0.3, 0.5).collect()}
    by_order = {}
    for o, i in pairs:
        by_order.setdefault(o, set()).add(i)
    total = len(by_order)

    def freq(s):
        return sum(s <= b for b in by_order.values())

    from itertools import combinations

    names, expected = sorted({i for _, i in pairs}), set()
    for size in range(2, 6):
        for chosen in combinations(names, size):
            both = freq(set(chosen))
            if both < 0.1 * total:
                continue
            for k in range(1, size):
                for left in combinations(chosen, k):
                    right = tuple(x for x in chosen if x not in left)
                    conf, lift = both / freq(set(left)), both * total / (freq(set(left)) * freq(set(right)))
                    if conf >= 0.3 and lift >= 0.5:
                        expected.add((", ".join(left), ", ".join(right)))
    assert set(got) == expected and any("," in c for _, c in expected)


def test_csv_round_trip_and_catalogue(spark, tmp_path):
    people = spark.createDataFrame([(1, 7, "X", date(2020, 1, 2), "F", None, "web")], "customer_id long, zip long, city string, signup_date date, gender string, age_group string, acquisition_channel string")
    tables.write_table(people, str(tmp_path / "cleaned_customers.csv"), "csv")
    (tmp_path / "geography_cleaned.csv").write_text("Unnamed: 0,city,zip,region,district\n0,X,7.0,East,D\n1,Y,bad,West,D\n")
    cat = tables.load_catalog(spark, str(tmp_path))
    assert cat.names() == ["customers", "geography"]
    assert cat.customers.collect() == people.collect()
    assert cat.geography.columns == ["city", "zip", "region", "district"]
    assert values(cat.geography.orderBy("city"), "zip") == [7, None]


def test_strict_dates(spark):
    df = spark.createDataFrame([("2020-02-29",), ("2021-02-29",), ("01/02/2020",)], "t string")
    assert values(df.select(tables.parse_date_strict("t").alias("d")), "d") == [date(2020, 2, 29), None, None]


def test_salted_item_fact_equals_plain(spark, catalog):
    n = 300
    orders = spark.range(n).select(
        F.col("id").alias("order_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("customer_id"),
        F.lit(date(2020, 1, 1)).alias("order_date"), F.lit("m").alias("device_type"), F.lit("s").alias("order_source"), F.lit(1).alias("zip"),
    )
    items = spark.range(n).select(
        F.col("id").alias("order_id"), (F.col("id") % 7).alias("product_id"), F.lit(2).alias("quantity"), F.lit(3.0).alias("unit_price"),
        F.lit(1.0).alias("discount_amount"), F.lit(None).cast("string").alias("promo_id"), F.lit(None).cast("string").alias("promo_id_2"),
    )
    people = spark.range(n).select(F.col("id").alias("customer_id"), F.lit("F").alias("gender"), F.lit("a").alias("age_group"), F.col("id").cast("string").alias("acquisition_channel"))
    goods = spark.range(5).select(F.col("id").alias("product_id"), F.col("id").cast("string").alias("category"), F.lit("x").alias("segment"), F.lit(1.0).alias("cogs"))
    cat = catalog(orders=orders, order_items=items, customers=people, products=goods)
    parts = ("orders", "customers", "products")
    plain = marts.item_fact(cat, parts)
    salted = marts.item_fact(cat, parts, salted=True).select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect())) and plain.count() == n


def test_salted_item_fact_seeks_hot_keys_in_narrow_tables(spark, catalog, monkeypatch):
    items = spark.sql("SELECT 1L AS order_id, 2L AS product_id, 2 AS quantity, 3.0D AS unit_price, 1.0D AS discount_amount, cast(null AS string) AS promo_id, cast(null AS string) AS promo_id_2")
    orders = spark.sql("SELECT 1L AS order_id, 5L AS customer_id, date'2020-01-01' AS order_date, 'm' AS device_type, 's' AS order_source, 1 AS zip")
    people = spark.sql("SELECT 5L AS customer_id, 'F' AS gender, 'a' AS age_group, 'c' AS acquisition_channel")
    goods = spark.sql("SELECT 2L AS product_id, 'a' AS category, 'x' AS segment, 1.0D AS cogs")
    paid = spark.sql("SELECT 1L AS order_id, 6.0D AS payment_value")
    seen = {}

    def sought(df, key, share):
        seen[key] = set(df.columns)
        return []

    monkeypatch.setattr("tallyshop.functions.scale.frequent_keys", sought)
    cat = catalog(orders=orders, order_items=items, customers=people, products=goods, payments=paid)
    row = marts.item_fact(cat, ("orders", "customers", "products", "payments"), salted=True).first()
    assert (row.gender, row.category, row.net_value, row.profit, row.payment_value) == ("F", "a", 5.0, 3.0, 6.0)
    assert seen == {"product_id": set(items.columns), "customer_id": set(orders.columns)}


def test_validation_days_follow_their_training_days(spark):
    from tallyshop.operators import models

    days = spark.sql("SELECT explode(sequence(date'1999-01-01', date'2000-12-31')) AS date")
    ranges = models.fold_ranges(days, 5, 30)
    assert len(ranges) == 5
    for train_to, valid_from, valid_to in ranges:
        assert (valid_from - train_to).days > 30 and valid_to > valid_from
    assert all(a[2] < b[1] for a, b in zip(ranges, ranges[1:], strict=False))


def test_daily_lists_leave_no_value_out(spark):
    from tallyshop.operators.daily import daily_spec
    from tallyshop.plans.daily import SPEC
    from tallyshop.sources.retail_views import retail_catalog

    found = daily_spec(retail_catalog(spark, "/root/testdata/sf0.001"), SPEC.start, SPEC.end)
    for column, values in vars(found).items():
        if isinstance(values, list):
            assert set(values) <= set(getattr(SPEC, column)), column


def test_baskets_keep_rare_items(spark, catalog):
    from tallyshop.operators.baskets import basket_items

    n = 2500
    orders = spark.range(n).selectExpr("id AS order_id", "'delivered' AS order_status")
    lines = spark.range(n).selectExpr("id AS order_id", "id AS product_id")
    products = spark.range(n).selectExpr("id AS product_id", "cast(id AS string) AS product_name")
    assert basket_items(catalog(orders=orders, order_items=lines, products=products), "product_name").count() == n
