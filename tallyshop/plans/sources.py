"""Queries for readers and writers: every one writes a table to the shared folder and reads it back."""

import uuid

from pyspark.sql import functions as F

from tallyshop.functions.columns import dbl, shown
from tallyshop.plans.registry import query, r6
from tallyshop.session import shared_folder
from tallyshop.sources import tables


def _folder(cat) -> str:
    return f"{shared_folder(cat.spark)}/sources-{uuid.uuid4().hex}"


@query("csv_round_trip", f"SELECT order_id, payment_method, {r6('cast(payment_value AS double)')} AS payment_value, cast(installments AS bigint) AS installments FROM r_payments")
def _(cat):
    """Payments as CSV with a leaked index column, read back by name."""
    folder = f"{_folder(cat)}/payments.csv"
    tables.write_table(cat.payments.select(F.monotonically_increasing_id().alias("Unnamed: 0"), "*"), folder, "csv")
    back = tables.read_table(cat.spark, folder, "payments")
    return shown(back).withColumn("installments", F.col("installments").cast("long"))


@query("catalog_round_trip", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM r_{t}" for t in ("geography", "products", "promotions", "sales")))
def _(cat):
    """Tables written as CSV and Parquet under several names, found again by their folder."""
    folder = _folder(cat)
    for name, file, kind in (("geography", "geography.csv", "csv"), ("products", "cleaned_products.parquet", "parquet"), ("promotions", "Promotions_cleaned.parquet", "parquet"), ("sales", "sales.csv", "csv")):
        tables.write_table(cat[name], f"{folder}/{file}", kind)
    found = tables.load_catalog(cat.spark, folder)
    counts = [found[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name in found.names()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


_KIND = "CASE order_id % 50 WHEN 1 THEN 'too few fields' WHEN 2 THEN 'too many fields' WHEN 3 THEN 'bad number' ELSE 'clean' END"


@query(
    "csv_bad_rows",
    f"""SELECT kind, count(*) AS rows, cast(CASE WHEN kind = 'clean' THEN 0 ELSE count(*) END AS bigint) AS rescued,
               {r6("coalesce(sum(CASE WHEN kind IN ('bad number', 'too few fields') THEN NULL ELSE payment_value END), 0)")} AS payment_value
        FROM (SELECT *, {_KIND} AS kind FROM r_payments) p GROUP BY kind""",
)
def _(cat):
    """Broken lines of a CSV file are read, kept apart and named; the rest of each table is right."""
    folder = f"{_folder(cat)}/payments.csv"
    value = F.when(F.col("order_id") % 50 == 3, F.lit("n/a")).otherwise(F.col("payment_value").cast("string"))
    fields = [F.col("order_id").cast("string"), F.col("payment_method"), value, F.col("installments").cast("string")]
    line = F.when(F.col("order_id") % 50 == 1, F.concat_ws(",", *fields[:2])).when(F.col("order_id") % 50 == 2, F.concat_ws(",", *fields, F.lit("more"))).otherwise(F.concat_ws(",", *fields))
    cat.payments.select(line.alias("order_id,payment_method,payment_value,installments")).write.option("header", True).option("quote", "").option("escape", "").csv(folder)
    back = tables.read_table(cat.spark, folder, "payments", rescue="rescued")
    kind = (
        F.when(F.col("rescued").isNull(), "clean").when(F.map_contains_key("rescued", "payment_value"), "bad number")
        .when(F.size(F.split(F.col("rescued")["_row"], ",")) < 4, "too few fields").otherwise("too many fields")
    )
    return shown(back.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("rows"), F.count("rescued").alias("rescued"), dbl(F.coalesce(F.sum(F.col("payment_value").cast("decimal(18,4)")), F.lit(0))).alias("payment_value")
    ))


@query(
    "partition_overwrite",
    f"""SELECT year(Date) AS year, count(*) AS days, {r6("sum(cast(Revenue AS double)) * CASE WHEN year(Date) = 1997 THEN 2 ELSE 1 END")} AS revenue
        FROM r_sales GROUP BY year(Date)""",
)
def _(cat):
    """Daily sales by year; one year is written again with twice the revenue, the others stay as they were."""
    folder = f"{_folder(cat)}/sales.parquet"
    sales = cat.sales.select(F.year("Date").alias("year"), "Date", dbl("Revenue").alias("revenue"))
    tables.write_partitions(sales, folder, "year")
    tables.write_partitions(sales.where("year = 1997").withColumn("revenue", F.col("revenue") * 2), folder, "year")
    return shown(cat.spark.read.parquet(folder).groupBy("year").agg(F.count("*").alias("days"), F.sum("revenue").alias("revenue")))
