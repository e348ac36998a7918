"""A session with the settings that the engine is measured with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", *, shuffle_partitions: int | None = 8, **more: str) -> SparkSession:
    """shuffle_partitions: None leaves the cluster's own setting."""
    b = SparkSession.builder.master(master).appName("widegrain")
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", **more}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()
