"""Readers and writers: JSON lines, Parquet (plain and partitioned), CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import CORRUPT

ROWS_PER_FILE = 200_000


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, keep_corrupt: bool = False
) -> DataFrame:
    """JSON lines under a declared schema (one pass); without one Spark infers it (two passes)."""
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema is None:
        return reader.json(path)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


def read_years(
    spark: SparkSession, root: str, years: Sequence[int] | None = None, column: str = "review_year"
) -> DataFrame:
    """A year-partitioned table.  The filter is on the partition column, so only those
    directories are listed and read, and the column itself stays in the result."""
    df = spark.read.parquet(root)
    if years is None:
        return df
    return df.where(F.col(column).isin([int(y) for y in years]))


def write_partitioned(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    sort: Sequence[str] = (),
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Partitioned Parquet, files capped in rows.

    The rebalance hint groups rows by partition value and lets adaptive execution split a value
    that holds much of the table, where a plain ``repartition(by)`` would send it to one task.
    """
    laid_out = df.hint("rebalance", *[F.col(c) for c in by])
    if sort:
        laid_out = laid_out.sortWithinPartitions(*by, *sort)
    (
        laid_out.write.mode("overwrite")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*by)
        .parquet(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header.  ``single_file`` suits bounded exports (top-k lists, chart input)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_first_present(spark: SparkSession, paths: Sequence[str], schemas: Sequence[T.StructType]) -> DataFrame:
    """The first CSV that exists: the standardised export before the plain one."""
    from pyspark.errors import AnalysisException

    for path, schema in zip(paths[:-1], schemas[:-1]):
        try:
            return read_csv(spark, path, schema)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
    return read_csv(spark, paths[-1], schemas[-1])
