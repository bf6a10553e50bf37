"""Readers and writers: rescued rows, partitions, folder listing."""

import pytest
from pyspark.sql import functions as F

from tallyshop.sources import tables

HEADER = "Unnamed: 0,order_id,payment_method,payment_value,installments"


def write(tmp_path, *lines):
    path = tmp_path / "payments.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_rescued_rows_name_what_was_lost(spark, tmp_path):
    path = write(tmp_path, "0,1,card,2.5,3", "1,x,card,oops,4", "2,3,cash", "3,4,cash,1.0,1,extra", "4,5,,nan,", '5,6,"a,b",7,2.0')
    rows = {r.payment_method: r for r in tables.read_table(spark, path, "payments", rescue="lost").collect()}
    found = tables.read_table(spark, path, "payments", rescue="lost")
    assert found.columns == ["order_id", "payment_method", "payment_value", "installments", "lost"]
    by = {r.order_id: r for r in found.collect()}
    assert by[1].lost is None and by[1].payment_value == 2.5 and by[6].lost is None and by[6].installments == 2
    assert by[None].lost == {"order_id": "x", "payment_value": "oops"} and by[None].installments == 4
    assert by[3].lost == {"_row": "2,3,cash"} and by[4].lost == {"_row": "3,4,cash,1.0,1,extra"}
    assert by[5].lost is None and by[5].payment_value is None and len(rows) == 4
    with pytest.raises(ValueError):
        tables.read_table(spark, path, "payments", mode="FAILFAST", rescue="lost")


def test_without_rescue_nothing_changes(spark, tmp_path):
    path = write(tmp_path, "0,1,card,2.5,3", "1,x,card,oops,4")
    assert tables.read_table(spark, path, "payments").columns == ["order_id", "payment_method", "payment_value", "installments"]
    assert [tuple(r) for r in tables.read_table(spark, path, "payments").orderBy("installments").collect()] == [(1, "card", 2.5, 3), (None, "card", None, 4)]


def test_partitions_that_do_not_occur_stay(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.range(30).select((F.col("id") % 3).alias("p"), "id")
    tables.write_partitions(df, path, "p")
    tables.write_partitions(spark.createDataFrame([(1, 100), (7, 200)], "p long, id long"), path, "p")
    found = {(r.p, r.id) for r in spark.read.parquet(path).collect()}
    assert found == {(i % 3, i) for i in range(30) if i % 3 != 1} | {(1, 100), (7, 200)}
    tables.write_partitions(df.limit(0), path, "p")
    assert spark.read.parquet(path).count() == 22


def test_folder_listing(spark, tmp_path):
    folder = tmp_path / "a.parquet.d" / "data"
    folder.mkdir(parents=True)
    spark.range(3).write.parquet(str(folder / "cleaned_orders.parquet"))
    spark.range(5).write.option("header", True).csv(str(folder / "Sales.csv"))
    (folder / "notes.txt").write_text("x")
    (folder / "returns_cleaned.csv").write_text("return_id\n1\n")
    assert [p.rsplit("/", 1)[-1] for p in tables.table_paths(spark, str(folder))] == ["Sales.csv", "cleaned_orders.parquet", "returns_cleaned.csv"]
    cat = tables.load_catalog(spark, f"file://{folder}/")
    assert cat.names() == ["orders", "returns", "sales"] and cat["orders"].count() == 3 and cat["sales"].count() == 5
