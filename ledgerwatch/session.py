"""A session with the settings the jobs count on; anything set elsewhere wins."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: join strategy, partition sizes, split of skewed join keys
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # state of many accounts on disk rather than in the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def open_session(name: str, **settings: str) -> SparkSession:
    """The active session with ``SETTINGS`` filled in where nothing else was said, or a new one."""
    session = SparkSession.builder.appName(name).getOrCreate()
    given = dict(session.sparkContext.getConf().getAll())
    for key, value in {**SETTINGS, **settings}.items():
        if key not in given or key in settings:
            session.conf.set(key, value)
    return session
