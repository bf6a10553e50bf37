"""Table readers and writers, and the catalogue the operators take."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop.session import materialise
from tallyshop.sources.schemas import SCHEMAS


# Column in which the CSV reader leaves the text of a line with a wrong number of fields.
CORRUPT = "_malformed_line"


class Catalog:
    """Tables by name; a table is built on first use and kept as a lazy DataFrame."""

    def __init__(self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]], folder: str = ""):
        self.spark = spark
        self.folder = folder
        self._builders = builders
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._builders[name]()
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        return self[name]

    def source(self, name: str) -> str:
        """Path of a raw Parquet file in the catalogue's folder."""
        return f"{self.folder}/{name}.parquet"

    def replaced(self, **tables: DataFrame) -> Catalog:
        """A catalogue with these tables in place of its own."""
        same = {name: (lambda name=name: self[name]) for name in self._builders}
        return Catalog(self.spark, {**same, **{name: (lambda df=df: df) for name, df in tables.items()}}, self.folder)

    def kept(self, *names: str) -> Catalog:
        """This catalogue, with some tables written once to the shared folder; tables derived from them read that copy.

        For derived tables that several parts of one job need: the sources behind them are scanned once.
        """
        for name in names:
            self._tables[name] = materialise(self[name])
        return self

    def names(self) -> list[str]:
        return sorted(self._builders)

    def register_views(self) -> None:
        """Make every table a temp view, for use from ``spark.sql``."""
        for name in self.names():
            self[name].createOrReplaceTempView(name)


def parse_date_strict(column: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse text with one fixed format; anything else becomes NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.try_to_timestamp(column, F.lit(fmt)).cast("date")


def drop_index_column(df: DataFrame) -> DataFrame:
    """Drop unnamed row-index columns that CSV writers leave behind."""
    return df.drop(*[c for c in df.columns if re.fullmatch(r"Unnamed: \d+|_c0|", c)])


def read_table(
    spark: SparkSession,
    path: str,
    name: str | None = None,
    fmt: str | None = None,
    mode: str = "PERMISSIVE",
    dates: tuple[str, ...] = (),
    rescue: str | None = None,
) -> DataFrame:
    """Read one table; CSV is read as text by header and cast to the schema of ``name``.

    Casting by column name rather than by position lets files carry a leaked index column or
    another column order. ``mode='FAILFAST'`` raises on a malformed row or value. ``rescue`` names a further column of a CSV
    table: a map from each column whose text could not be cast to that text, and from ``_row`` to the whole line
    where it has too few or too many fields; null for a clean row.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt != "csv":
        return drop_index_column(spark.read.format(fmt).load(path))
    reader = spark.read.option("header", True).option("mode", mode)
    if rescue:
        if mode == "FAILFAST":
            raise ValueError("a table is rescued or fails, not both")
        header = reader.csv(path).columns
        texts = ", ".join(f"`{c}` string" for c in [*header, CORRUPT])
        # fields can only be counted if all of them are parsed
        reader = reader.schema(texts).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    raw = drop_index_column(reader.csv(path))
    wanted = {f.name: f.dataType for f in SCHEMAS[name].fields} if name in SCHEMAS else {}

    def typed(column: str) -> Column:
        kind = wanted.get(column)
        if column in dates or (kind is not None and kind.typeName() == "date"):
            return (F.to_date(column, "yyyy-MM-dd") if mode == "FAILFAST" else parse_date_strict(column)).alias(column)
        if kind is None:
            return F.col(column)
        if kind.typeName() == "long":  # integers may have been written as 3.0
            text = F.regexp_replace(F.trim(column), r"\.0+$", "")
            return (text.cast(kind) if mode == "FAILFAST" else text.try_cast(kind)).alias(column)
        parsed = F.col(column).cast(kind) if mode == "FAILFAST" else F.col(column).try_cast(kind)
        if kind.typeName() == "double":
            parsed = F.when(F.isnan(parsed), None).otherwise(parsed)
        return parsed.alias(column)

    columns = [c for c in raw.columns if not (rescue and c == CORRUPT)]
    if not rescue:
        return raw.select(*[typed(c) for c in columns])
    # a NaN is a number that the double columns show as null, not a text that could not be read
    lost = [
        F.when(F.col(c).isNotNull() & typed(c).isNull() & ~F.lower(F.trim(c)).isin("", "nan"), F.struct(F.lit(c).alias("key"), F.col(c).alias("value")))
        for c in columns if c in wanted or c in dates
    ]
    line = F.when(F.col(CORRUPT).isNotNull(), F.struct(F.lit("_row").alias("key"), F.col(CORRUPT).alias("value")))
    found = F.filter(F.array(*lost, line), lambda e: e.isNotNull())
    return raw.select(*[typed(c) for c in columns], F.when(F.size(found) > 0, F.map_from_entries(found)).alias(rescue))


def table_name(file_name: str) -> str:
    """Table name of a file: no suffix, no ``cleaned_`` / ``_cleaned``, lower case."""
    stem = re.sub(r"\.(csv|parquet)$", "", file_name.rstrip("/").rsplit("/", 1)[-1])
    return re.sub(r"^cleaned_|_cleaned$", "", stem.strip().lower())


def table_paths(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV and Parquet tables (files or folders) in a folder, listed by Spark's file reader; no content is read."""
    root = folder.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    inside = re.escape(re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root))
    names = listed.select(F.regexp_extract("path", rf"^.*?{inside}/([^/]+\.(?:csv|parquet))(?:/.*)?$", 1).alias("name")).where("name <> ''")
    return sorted(f"{root}/{row.name}" for row in names.distinct().collect())  # one row per table


def load_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Catalogue of every CSV or Parquet table in a folder, named after its file."""
    return Catalog(
        spark,
        {table_name(p): (lambda p=p: read_table(spark, p, table_name(p))) for p in table_paths(spark, folder)},
    )


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write the partitions of ``by`` that occur in ``df`` and leave all others of the Parquet table as they are.

    Rows of one value are dealt to several tasks by a hash of the row, so a large partition is not written by one.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    writer = df.repartition(F.col(by), spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a table (Parquet by default, CSV with a header on request)."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def submission_rows(df: DataFrame, date: str = "date", revenue: str = "revenue", cogs: str = "cogs") -> DataFrame:
    """Forecast rows as they are handed in: ISO dates and money with two decimals."""
    return df.select(
        F.date_format(date, "yyyy-MM-dd").alias("Date"),
        F.round(revenue, 2).cast("double").alias("Revenue"),
        F.round(cogs, 2).cast("double").alias("COGS"),
    )


def write_submission(df: DataFrame, path: str, **columns: str) -> None:
    """Write the hand-in CSV, sorted by date."""
    rows = submission_rows(df, **columns).orderBy("Date")
    rows.write.mode("overwrite").option("header", True).csv(path)
