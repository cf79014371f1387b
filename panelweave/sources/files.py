"""CSV and Parquet readers and the Parquet writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.timegrid import parse_year_month


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; filters and projections that follow are pushed into it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_csv_dates(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    year_month: Sequence[str] = (),
) -> DataFrame:
    """CSV with a header and a declared schema; ``YYYY-MM`` text columns become dates.

    Every file's header must name the schema's columns, and a value that is not of its type raises.
    """
    df = spark.read.schema(schema).option("enforceSchema", "false").option("mode", "FAILFAST").csv(path, header=True)
    return df.withColumns({c: parse_year_month(F.col(c)) for c in year_month}) if year_month else df


def read_decimal_comma(
    spark: SparkSession,
    path: str,
    meters: Sequence[str],
    timestamp: str = "timestamp",
) -> DataFrame:
    """``;``-separated text with decimal commas and a blank name over its time column.

    ``meters`` declares the value columns in file order, so no inference pass over the data runs.
    All files must have that header, and a malformed time or number raises.
    """
    found = header_names(spark, path)
    if found != list(meters):
        raise ValueError(f"the header names {found}, declared are {list(meters)}")
    schema = T.StructType(
        [T.StructField(timestamp, T.TimestampNTZType())]
        + [T.StructField(m, T.StringType()) for m in meters]
    )
    raw = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("sep", ";")
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    numbers = [F.replace(F.col(f"`{m}`"), F.lit(","), F.lit(".")).cast("double").alias(m) for m in meters]
    return raw.select(timestamp, *numbers)


def header_names(spark: SparkSession, path: str, sep: str = ";") -> list[str]:
    """Value column names of the wide text files at ``path``; files with different headers, or without one, raise.

    A header line is one with a blank name over the time column.  A file that has such a line only further down fails when
    it is read, since the line has no time.
    """
    blank = F.regexp_replace(F.substring_index("value", sep, 1), r'["\s]', "") == ""
    is_header = blank & F.col("value").contains(sep)
    files = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.collect_set(F.when(is_header, F.col("value"))).alias("headers"))
    found = files.groupBy("headers").agg(F.min("file").alias("file")).limit(2).collect()
    lines = sorted({line for r in found for line in r["headers"]})
    if len(lines) > 1:
        raise ValueError(f"files with different headers: {lines[0]!r} and {lines[1]!r}")
    bare = [r["file"] for r in found if not r["headers"]]
    if bare:
        raise ValueError(f"a file without a header: {bare[0]}")
    names = lines[0].split(sep)[1:] if lines else []
    return [n.strip().strip('"') for n in names]


def convert_decimal_comma(
    spark: SparkSession, path: str, out: str, timestamp: str = "timestamp"
) -> DataFrame:
    """Text file to Parquet, once; the text file is kept."""
    from panelweave.sources.staging import materialize

    return materialize(
        spark, out, lambda: read_decimal_comma(spark, path, header_names(spark, path), timestamp)
    )
