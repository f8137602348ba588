"""Session helpers shared by the whole library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark so that any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """The session that tests and bench.py use; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting (tests) gets a folder of the machine instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/packspark-shared"
    return f"{base.rstrip('/')}/packspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
