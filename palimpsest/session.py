"""A session with the settings that the engine expects."""

from pyspark.sql import SparkSession


def build(master: str | None = None, name: str = "palimpsest", **settings: str) -> SparkSession:
    """UTC, ANSI mode, adaptive execution; `settings` add to or replace these."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | settings
    builder = SparkSession.builder.appName(name).config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()
