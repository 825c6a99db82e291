"""Results as files: resumable JSON lines, summaries, samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def completed(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The ids already in an output folder, None if there is no output yet."""
    try:
        return spark.read.json(path).select(F.col(key).cast("string").alias(key)).distinct()
    except Exception as e:  # the folder is missing or empty
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "UNRESOLVED_COLUMN" in str(e):
            return None
        raise


def pending(df: DataFrame, path: str, key: str, limit: int | None = None) -> DataFrame:
    """The rows whose id the output does not hold; ``limit`` counts new ids only, by id."""
    done = completed(df.sparkSession, path, key)
    rows = df if done is None else df.join(done, df[key].cast("string") == done[key], "left_anti")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def run_resumable(df: DataFrame, path: str, key: str, process: Callable[[DataFrame], DataFrame], limit: int | None = None) -> None:
    """Process what is pending and append it to the output."""
    process(pending(df, path, key, limit)).write.mode("append").json(path)


def summarize(records: DataFrame, means: list[str], by: str | None = None) -> DataFrame:
    """Counts, failures and means over all records; nulls count for no mean."""
    grouped = records.groupBy(by) if by else records.groupBy()
    failed = F.count_if(F.col("error").isNotNull()) if "error" in records.columns else F.lit(0)
    return grouped.agg(F.count("*").alias("n"), failed.cast("long").alias("n_failed"), *[F.avg(m).alias(f"mean_{m}") for m in means])


def write_summary(records: DataFrame, path: str, means: list[str], by: str | None = None) -> None:
    """One summary beside the output; it has as many rows as ``by`` has values."""
    summarize(records, means, by).coalesce(1).write.mode("overwrite").json(f"{path}.summary")


def write_shards(df: DataFrame, path: str, distribution: DataFrame | None = None) -> None:
    """Samples by ``shard_index``, and their distribution beside them."""
    df.write.mode("overwrite").partitionBy("shard_index").json(path)
    if distribution is not None:
        distribution.coalesce(1).write.mode("overwrite").json(f"{path}.distribution")
