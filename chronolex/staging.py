"""Tables that a plan reads more than once: written to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a temporary folder stands in, but only in local mode."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='chronolex-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def sized_by_rows(spark: SparkSession) -> None:
    """Joins of the session are planned without sending a table for the size of its files: alike rows shrink a hundredfold in them, so that
    millions of rows would pass for few and go through the driver. What is small by its rows as it runs is still sent, up to the same bound."""
    bound, running = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(running, None) is None:
        spark.conf.set(running, spark.conf.get(bound))
        spark.conf.set(bound, "-1")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df computed once, its lineage cut: later stages start from the written table, whatever executors get lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
