"""Promotion analyses: take-up, effect, return on investment, dependency, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions.columns import (
    count_if,
    cut,
    dbl,
    flag,
    gross_value,
    mean_exact,
    money,
    month_of,
    net_value,
    r6,
    ratio,
    total_of,
)

DEPENDENCY_EDGES = [-0.01, 0.001, 0.5, 0.8, 1.01]
DEPENDENCY_LABELS = ["No Promo", "Occasional", "Frequent", "Dependent"]


def order_promo(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Per order: gross, discount and net revenue, whether any line had a promotion, period."""
    per_order = order_items.groupBy("order_id").agg(
        F.sum(gross_value()).alias("gross_revenue"),
        F.sum("discount_amount").alias("total_discount"),
        F.max(flag(F.col("promo_id").isNotNull())).alias("has_promo"),
    )
    return orders.select("order_id", "customer_id", "order_date").join(per_order, "order_id", "left").withColumns(
        {
            "net_revenue": F.col("gross_revenue") - F.col("total_discount"),
            "has_promo": F.coalesce("has_promo", F.lit(0)),
            "promo_label": F.when(F.col("has_promo") == 1, "Promo").otherwise("Non-Promo"),
            "month": month_of("order_date"),
            "year": F.year("order_date"),
        }
    )


def promo_kpis(op: DataFrame) -> DataFrame:
    """Take-up, mean discount, two discount depths and revenue shares in one row.

    ``discount_depth_mean`` is the mean of the order ratios, ``discount_depth_total`` the ratio
    of the sums.
    """
    used = F.col("has_promo") == 1
    agg = op.agg(
        F.count("*").alias("orders"),
        F.sum("has_promo").alias("promo_orders"),
        F.sum(F.when(used, F.col("total_discount"))).alias("discount"),
        F.sum(F.when(used, F.col("gross_revenue"))).alias("gross"),
        F.avg(F.when(used, ratio("total_discount", "gross_revenue"))).alias("depth"),
        F.sum(F.when(used, F.col("net_revenue"))).alias("promo"),
        F.sum("net_revenue").alias("total"),
    )
    return agg.select(
        "orders", "promo_orders",
        r6(ratio("promo_orders", "orders") * 100).alias("take_up_rate"),
        r6(ratio("discount", "promo_orders")).alias("avg_discount"),
        r6(F.col("depth") * 100).alias("discount_depth_mean"),
        r6(ratio("discount", "gross") * 100).alias("discount_depth_total"),
        money("promo").alias("promo_revenue"),
        money(F.col("total") - F.col("promo")).alias("nonpromo_revenue"),
        r6(ratio("promo", "total") * 100).alias("promo_revenue_share"),
    )


def promo_revenue_by(op: DataFrame, period: str) -> DataFrame:
    """Promotion and other revenue, take-up rate and promotion share by month or year."""
    used = F.col("has_promo") == 1
    agg = op.groupBy(period).agg(
        F.sum(F.when(used, F.col("net_revenue")).otherwise(0)).alias("promo"),
        F.sum(F.when(used, 0).otherwise(F.coalesce("net_revenue", F.lit(0)))).alias("other"),
        F.sum("has_promo").alias("promo_orders"),
        F.count("*").alias("orders"),
    )
    total = F.col("promo") + F.col("other")
    return agg.select(
        period, "orders", "promo_orders",
        money("promo").alias("promo_revenue"),
        money("other").alias("nonpromo_revenue"),
        money(total).alias("total_revenue"),
        r6(ratio("promo_orders", "orders") * 100).alias("take_up_rate"),
        r6(ratio("promo", total) * 100).alias("promo_share"),
    )


def promo_takeup_bands(op: DataFrame, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """Months with low, middle and high take-up, and a summary of the monthly rates."""
    monthly = op.groupBy("month").agg((ratio(F.sum("has_promo"), F.count("*")) * 100).alias("rate"))
    quart = F.percentile("rate", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # one row per month
    agg = monthly.agg(
        F.count("*").alias("months"),
        count_if(F.col("rate") < low).alias("months_low"),
        count_if(F.col("rate").between(low, high)).alias("months_middle"),
        count_if(F.col("rate") > high).alias("months_high"),
        F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("std"),
        F.min("rate").alias("lo"), quart.alias("q"), F.max("rate").alias("hi"),
    )
    return agg.select(
        "months", "months_low", "months_middle", "months_high", r6("mean").alias("rate_mean"),
        r6("std").alias("rate_std"), r6("lo").alias("rate_min"), r6(F.col("q")[0]).alias("rate_q1"),
        r6(F.col("q")[1]).alias("rate_median"), r6(F.col("q")[2]).alias("rate_q3"), r6("hi").alias("rate_max"),
    )


def monthly_promo_summary(op: DataFrame) -> DataFrame:
    return op.groupBy("month").agg(
        F.sum("net_revenue").alias("revenue"), F.count("*").alias("orders"),
        ratio(F.sum("has_promo"), F.count("*")).alias("take_up"),
    )


def promo_month_effect(op: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Months with much promotion against the others: revenue, orders, order value."""
    monthly = monthly_promo_summary(op)
    return monthly.groupBy(flag(F.col("take_up") >= threshold).alias("is_promo_month")).agg(
        F.count("*").alias("months"),
        r6(mean_exact("revenue")).alias("avg_revenue"),
        r6(mean_exact("orders")).alias("avg_orders"),
        r6(F.avg(ratio("revenue", "orders"))).alias("avg_order_value"),
    )


def promo_month_fit(op: DataFrame) -> DataFrame:
    """Correlation and straight line of monthly revenue (millions) on take-up (percent)."""
    points = monthly_promo_summary(op).select(
        (F.col("take_up") * 100).alias("x"), (dbl("revenue") / 1e6).alias("y")
    )
    out = points.agg(
        F.count("*").alias("months"), F.corr("y", "x").alias("r"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
    )
    t = F.col("r") * F.sqrt(ratio(F.col("months") - 2, 1 - F.col("r") * F.col("r")))
    return out.select(
        "months", r6("r").alias("pearson_r"), r6(t).alias("t_statistic"), r6("slope").alias("slope"),
        r6("intercept").alias("intercept"),
    )


def promo_lines(order_items: DataFrame, promotions: DataFrame) -> DataFrame:
    """Lines with a promotion, summed per (order, promotion) before the promotion is looked up."""
    used = order_items.where("promo_id IS NOT NULL").groupBy("order_id", "promo_id").agg(
        F.sum(gross_value()).alias("gross"), F.sum("discount_amount").alias("discount"),
        F.sum("quantity").alias("quantity"), F.count("*").alias("lines"),
    )
    kept = promotions.select(
        "promo_id", "promo_type", "discount_value", "applicable_category", "promo_channel"
    )
    return used.join(kept, "promo_id", "left")


def promo_by(lines: DataFrame, dimension: str) -> DataFrame:
    """Orders, revenue, discount, depth, revenue share and ROI by a promotion attribute."""
    agg = lines.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum(F.col("gross") - F.col("discount")).alias("net"),
        F.sum("gross").alias("gross"), F.sum("discount").alias("discount"),
        F.sum("lines").alias("lines"), F.sum("quantity").alias("total_qty"),
    )
    return agg.select(
        dimension, "total_orders", money("net").alias("total_revenue"), money("discount").alias("total_discount"),
        r6(ratio("discount", "lines")).alias("avg_discount"), "total_qty",
        r6(ratio("discount", "gross") * 100).alias("discount_depth"),
        r6(ratio("net", total_of("net")) * 100).alias("revenue_share"),
        r6(ratio("net", "discount")).alias("roi"),
    )


def recommendation(roi: Column, depth: Column) -> Column:
    """KEEP for ROI of at least 8 at a depth of at most 10 %, REVIEW from ROI 5, else STOP."""
    return F.when((roi >= 8) & (depth <= 10), "KEEP").when(roi >= 5, "REVIEW").otherwise("STOP")


def promo_scorecard(order_items: DataFrame, promotions: DataFrame) -> DataFrame:
    """Return, depth, duration, cost per order and recommendation of each campaign."""
    used = order_items.where("promo_id IS NOT NULL").groupBy("promo_id").agg(
        F.count_distinct("order_id").alias("total_orders"), F.sum(gross_value()).alias("gross"),
        F.sum("discount_amount").alias("discount"), F.sum(net_value()).alias("net"),
    )
    joined = used.join(promotions, "promo_id", "left").withColumns(
        {
            "roi": ratio("net", "discount"),
            "discount_depth": ratio("discount", "gross") * 100,
            "duration_days": F.datediff("end_date", "start_date"),
            "cost_per_order": ratio("discount", "total_orders"),
        }
    )
    return joined.withColumn("recommendation", recommendation(F.col("roi"), F.col("discount_depth")))


def scorecard_output(card: DataFrame) -> DataFrame:
    return card.select(
        "promo_id", "promo_name", "promo_type", "applicable_category", "promo_channel", "total_orders",
        "duration_days", "recommendation", money("gross").alias("gross_revenue"), money("net").alias("net_revenue"),
        money("discount").alias("total_discount"), r6("roi").alias("roi"),
        r6("discount_depth").alias("discount_depth"), r6("cost_per_order").alias("cost_per_order"),
    )


def promo_budget(card: DataFrame) -> DataFrame:
    """Campaigns, discount, revenue and budget share per recommendation."""
    agg = card.groupBy("recommendation").agg(
        F.count("promo_id").alias("campaigns"), F.sum("discount").alias("d"), F.sum("net").alias("n")
    )
    return agg.select(
        "recommendation", "campaigns", money("d").alias("total_discount"), money("n").alias("total_revenue"),
        r6(ratio("d", total_of("d")) * 100).alias("budget_pct"),
    )


def yearly_churn(orders: DataFrame) -> DataFrame:
    """Active, churned, retained and new customers per year against the year before.

    Customers are collapsed to (customer, year); each row looks one year back and, through a
    row shifted forward, marks a possible churn. No self-join and no loop over years. A year
    is compared with the calendar year before it; the first year has no row.
    """
    active = orders.groupBy("customer_id", F.year("order_date").alias("year")).agg(F.lit(1).alias("now"))
    both = active.select("customer_id", "year", "now", F.lit(0).alias("before")).unionByName(
        active.select("customer_id", (F.col("year") + 1).alias("year"), F.lit(0).alias("now"), F.lit(1).alias("before"))
    )
    pairs = both.groupBy("customer_id", "year").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    yearly = pairs.groupBy("year").agg(
        F.sum("before").alias("prev_active"), F.sum("now").alias("curr_active"),
        count_if((F.col("before") == 1) & (F.col("now") == 0)).alias("churned"),
        count_if((F.col("before") == 1) & (F.col("now") == 1)).alias("retained"),
        count_if((F.col("before") == 0) & (F.col("now") == 1)).alias("new"),
    )
    real = yearly.where("curr_active > 0 AND prev_active > 0")
    return real.withColumn("churn_rate", ratio("churned", "prev_active") * 100)


def churn_by_year_output(churn: DataFrame) -> DataFrame:
    return churn.withColumn("churn_rate", r6("churn_rate"))


def customer_promo(op: DataFrame) -> DataFrame:
    """Orders, promotion orders and revenue per customer with the dependency band."""
    out = op.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"), F.sum("has_promo").alias("promo_orders"),
        F.sum("net_revenue").alias("total_revenue"), F.max("order_date").alias("last_order_date"),
        F.min("year").alias("first_order_year"), F.max("year").alias("last_order_year"),
    )
    return out.withColumn("promo_ratio", ratio("promo_orders", "total_orders")).withColumn(
        "dependency", cut("promo_ratio", DEPENDENCY_EDGES, DEPENDENCY_LABELS)
    )


def promo_dependency(customers: DataFrame) -> DataFrame:
    """Customers, mean orders and mean revenue per dependency band."""
    agg = customers.where("dependency IS NOT NULL").groupBy("dependency").agg(
        F.count("*").alias("num_customers"), r6(mean_exact("total_orders")).alias("avg_orders"),
        r6(mean_exact("total_revenue")).alias("avg_revenue"),
    )
    return agg.withColumn("pct_customers", r6(ratio("num_customers", total_of("num_customers")) * 100))


def at_risk_customers(customers: DataFrame, inactive_days: int = 365) -> DataFrame:
    """Adds days of inactivity, the at-risk flag, the target flag and the priority band."""
    newest = customers.agg(F.max("last_order_date").alias("d")).scalar()
    out = customers.withColumn("days_inactive", F.datediff(newest, F.col("last_order_date")))
    out = out.withColumn("is_at_risk", flag(F.col("days_inactive") >= inactive_days))
    valuable = F.coalesce(F.col("dependency").isin("Occasional", "Frequent"), F.lit(False))
    return out.withColumns(
        {
            "is_valuable": flag(valuable),
            "is_target": flag(valuable & (F.col("is_at_risk") == 1)),
            "priority": cut("total_revenue", [0, 100000, 300000, float("inf")], ["Low Value", "Mid Value", "High Value"]),
        }
    )


def at_risk_targets(marked: DataFrame) -> DataFrame:
    """Targeted customers and their revenue per priority band."""
    return marked.where("is_target = 1 AND priority IS NOT NULL").groupBy("priority").agg(
        F.count("*").alias("num_customers"), r6(mean_exact("total_revenue")).alias("avg_revenue"),
        money(F.sum("total_revenue")).alias("total_revenue"),
    )


def at_risk_funnel(marked: DataFrame) -> DataFrame:
    """All, valuable, at-risk and targeted customers."""
    return marked.agg(
        F.count("*").alias("customers"), F.sum("is_valuable").alias("valuable"),
        F.sum("is_at_risk").alias("at_risk"), F.sum("is_target").alias("targets"),
    )


def promo_reallocation(
    card: DataFrame, marked: DataFrame, targeting_share: float = 0.30, recovery: float = 0.20
) -> DataFrame:
    """Moving part of the STOP budget to at-risk customers: cost per customer, recovery, net benefit."""
    kinds = {k.lower(): F.sum(F.when(F.col("recommendation") == k, F.col("discount")).otherwise(0)) for k in ("KEEP", "REVIEW", "STOP")}
    budget = card.agg(
        dbl(F.sum("discount")).alias("current"), *[dbl(v).alias(f"{k}_budget") for k, v in kinds.items()]
    )
    people = marked.where("is_target = 1").agg(
        F.struct(F.count("*").alias("n"), mean_exact("total_revenue").alias("mean")).alias("s")
    ).scalar()
    plan = budget.withColumns({"targets": people["n"], "mean": F.coalesce(people["mean"], F.lit(0.0))})
    plan = plan.withColumns(
        {
            "moved": F.col("stop_budget") * targeting_share,
            "saved": F.col("stop_budget") * (1 - targeting_share),
            "recovered": F.floor(F.col("targets") * recovery),
        }
    )
    gain = F.col("recovered") * F.col("mean")
    return plan.select(
        F.round("current", 2).alias("current_discount"), F.round("keep_budget", 2).alias("keep_budget"),
        F.round("review_budget", 2).alias("review_budget"), F.round("stop_budget", 2).alias("stop_budget"),
        F.round("moved", 2).alias("realloc_budget"), F.round("saved", 2).alias("saved_budget"), "targets",
        F.round(ratio("moved", "targets"), 4).alias("cost_per_target"), "recovered",
        F.round(gain, 2).alias("incremental_revenue"), F.round(gain + F.col("saved"), 2).alias("net_benefit"),
    )


def yearly_revenue(op: DataFrame, from_year: int) -> DataFrame:
    """Promotion and other revenue per full year, in billions."""
    used = F.col("has_promo") == 1
    return op.where(F.col("year") >= from_year).groupBy("year").agg(
        (dbl(F.sum(F.when(used, F.col("net_revenue")).otherwise(0))) / 1e9).alias("promo"),
        (dbl(F.sum(F.when(used, 0).otherwise(F.coalesce("net_revenue", F.lit(0))))) / 1e9).alias("other"),
    )


def revenue_trend_scenarios(op: DataFrame, from_year: int, ahead: int = 3, depth: float = 0.1409) -> DataFrame:
    """Linear trend of yearly revenue ahead, as it is and with promotion revenue undiscounted."""
    yearly = yearly_revenue(op, from_year).select(
        "year", (F.col("promo") + F.col("other")).alias("with_promo"),
        (F.col("other") + F.col("promo") / (1 - depth)).alias("no_promo"),
    )
    fits = yearly.agg(
        F.max("year").alias("last"),
        *[
            F.struct(F.regr_slope(c, "year").alias("a"), F.regr_intercept(c, "year").alias("b")).alias(c)
            for c in ("with_promo", "no_promo")
        ],
    )
    future = fits.select("*", F.explode(F.sequence(F.col("last") + 1, F.col("last") + ahead)).alias("year"))
    return future.select(
        "year", *[r6(F.col(c)["a"] * F.col("year") + F.col(c)["b"]).alias(f"revenue_{c}") for c in ("with_promo", "no_promo")]
    )


def revenue_trend_error(op: DataFrame, from_year: int) -> DataFrame:
    """Mean absolute error of the yearly trend on its own years."""
    yearly = yearly_revenue(op, from_year).select("year", (F.col("promo") + F.col("other")).alias("y"))
    fit = yearly.agg(
        F.struct(F.regr_slope("y", "year").alias("a"), F.regr_intercept("y", "year").alias("b")).alias("f")
    ).scalar()
    error = F.abs(F.col("y") - (fit["a"] * F.col("year") + fit["b"]))
    return yearly.withColumn("e", error).agg(F.count("*").alias("years"), r6(F.avg("e")).alias("mae"))


def churn_projection(churn: DataFrame, ahead: int = 3, recent: int = 3) -> DataFrame:
    """Linear churn rate (0 to 95 %) and active customers for the coming years.

    active(t+1) = active(t) − churned + mean newcomers of the last ``recent`` years, folded
    over a short array of future years.
    """
    fit = churn.agg(
        F.max("year").alias("last"), F.max_by("curr_active", "year").alias("active"),
        F.regr_slope("churn_rate", "year").alias("a"), F.regr_intercept("churn_rate", "year").alias("b"),
        F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("year", "new")))), 1, recent).alias("tail"),
    )  # one row per year goes in
    mean_new = F.aggregate("tail", F.lit(0.0), lambda s, x: s + x["new"]) / F.size("tail")
    fit = fit.withColumn("mean_new", mean_new)

    def rate_of(year: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(95.0), F.col("a") * year + F.col("b")))

    def active_after(years: Column) -> Column:
        return F.aggregate(
            years, dbl("active"), lambda s, y: s - s * rate_of(y) / 100 + F.col("mean_new")
        )

    out = fit.select("*", F.explode(F.sequence(F.col("last") + 1, F.col("last") + ahead)).alias("year"))
    return out.select(
        "year", r6(rate_of(F.col("year"))).alias("churn_rate"),
        r6(active_after(F.sequence(F.col("last") + 1, F.col("year")))).alias("active_customers"),
    )
