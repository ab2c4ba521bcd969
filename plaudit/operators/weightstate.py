"""Monthly credibility weights kept up to date batch by batch, from a state that merges.

A user's month is (n, known, total, squares): rows, rows with stars, their sum and sum of squares.
A batch is summed to the same shape, added to the months it touches, and only their partitions are
written again, so late rows cost their months and nothing else.  Each partition notes the last
batch it has taken; a batch that is run again, also after a crash between two partitions, adds
itself only where it is missing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import require_columns
from ..session import materialize

MONTH = ["year", "month"]
SUMS = ["n", "known", "total", "squares"]


def _state(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return None


def apply_batch(spark: SparkSession, path: str, rows: DataFrame, batch: int) -> int:
    """Adds ``rows`` (user_id, stars, year, month) to the state; returns how many months changed.

    Batches have growing numbers.  Rows without a user, year or month belong to no series and are
    left out, as in ``ingest.drop_null_keys``.
    """
    require_columns(rows, ["user_id", "stars", *MONTH], "reviews")
    stars = F.col("stars").cast("double")
    fresh = materialize(
        rows.dropna(subset=["user_id", *MONTH])
        .select("user_id", *[F.col(c).cast("int").alias(c) for c in MONTH], stars.alias("stars"))
        .groupBy(*MONTH, "user_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count("stars").alias("known"),
            F.coalesce(F.sum("stars"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.col("stars") * F.col("stars")), F.lit(0.0)).alias("squares"),
        ),
        "batch",
    )
    months = fresh.select(*MONTH).distinct()
    state = _state(spark, path)
    if state is not None:
        taken = materialize(
            state.join(months, MONTH, "left_semi").groupBy(*MONTH).agg(F.max("upto").alias("upto")).where(F.col("upto") >= batch), "taken"
        )
        fresh = fresh.join(F.broadcast(taken), MONTH, "left_anti")  # months: the calendar bounds them
    # A list of months, by which the scan of the state is pruned.
    touched = [(r.year, r.month) for r in fresh.select(*MONTH).distinct().collect()]
    if not touched:
        return 0
    parts = fresh.select(*MONTH, "user_id", *SUMS)
    if state is not None:
        wanted = F.lit(False)
        for year in sorted({y for y, _ in touched}):
            wanted = wanted | (F.col("year") == year) & F.col("month").isin([m for y, m in touched if y == year])
        parts = parts.unionByName(state.where(wanted).select(*MONTH, "user_id", *SUMS))
    merged = parts.groupBy(*MONTH, "user_id").agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("upto", F.lit(batch))
    stored = materialize(merged, "merged")  # read from the partitions that are replaced next
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(path)
    return len(touched)


def weights(spark: SparkSession, path: str, min_reviews: int | None = None) -> DataFrame:
    """(user_id, year, month, n_reviews, var_stars, w_user) of the state, as ``monthly_weights`` gives."""
    mean = F.col("total") / F.col("known")
    variance = F.when(F.col("known") > 0, F.greatest(F.lit(0.0), F.col("squares") / F.col("known") - mean * mean)).otherwise(0.0)
    out = spark.read.parquet(path).select(
        "user_id", *MONTH, F.col("n").alias("n_reviews"), variance.alias("var_stars")
    ).withColumn("w_user", 1.0 / (1.0 + F.col("var_stars")))
    return out.where(F.col("n_reviews") >= min_reviews) if min_reviews else out
