"""Table writers and readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..schemas import OUTPUT_COLUMNS


def write_table(df: DataFrame, path: str, table: str, fmt: str = "csv", single_file: bool = False) -> int:
    """Overwrite ``path`` with the fixed columns of a table and return the rows written.

    Further columns are left out.  The count is observed during the write.
    """
    columns = OUTPUT_COLUMNS[table]
    rows = df.select(*[(_capitalized(df, c) if fmt == "csv" else F.col(f"`{c}`")).alias(c) for c in columns])
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if single_file:
        rows = rows.coalesce(1)
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        # Quotes are doubled inside a quoted field and nulls are empty, as csv readers expect.
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.format(fmt).save(path)
    return seen.get["n"]


def _capitalized(df: DataFrame, column: str) -> Column:
    """Booleans are written ``True`` and ``False``."""
    value = F.col(f"`{column}`")
    return F.initcap(value.cast("string")) if dict(df.dtypes)[column] == "boolean" else value


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV table with header; quoted fields may hold line breaks."""
    return spark.read.options(header=True, multiLine=True, escape='"', **options).csv(path)


def rows_per_file(df: DataFrame) -> DataFrame:
    """Row count per input file, by file name."""
    name = F.substring_index(F.input_file_name(), "/", -1)
    return df.withColumn("file", name).groupBy("file").agg(F.count("*").alias("n_rows"))


def json_preview(df: DataFrame, n_chars: int = 500) -> DataFrame:
    """The first characters of every row as JSON."""
    return df.select(F.substring(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"}), 1, n_chars).alias("preview"))
