"""Sessions with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """UTC, adaptive execution and the RocksDB state store; shuffle partitions are left to Spark unless given."""
    b = SparkSession.builder.appName("tidemark")
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    b = b.master(master) if master else b
    return b.config(map=conf | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()
