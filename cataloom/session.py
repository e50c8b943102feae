"""Session settings and table access shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "cataloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, AQE with skew handling."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # files of a checkpoint go when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt over as many tasks as shuffles have, for work that is long for each row.

    A small file is one task whatever its rows cost, and adaptive execution would put small partitions together; a number that is given stays.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
