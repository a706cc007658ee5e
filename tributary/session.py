"""The one place that makes Spark sessions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tributary", master: str | None = None, shuffle_partitions: int | None = None, aqe: bool = True, **conf: str) -> SparkSession:
    """A session in UTC with AQE on. Settings left out keep what the cluster gives; `conf` wins over all."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": str(aqe).lower(),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8) -> SparkSession:
    """For tests and the bench: everything in one JVM."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return get_session(
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
