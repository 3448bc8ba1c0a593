"""Session creation."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps month boundaries the same on every cluster. The adaptive settings are
# Spark's defaults, named here because the plans count on them: run-time broadcast
# decisions from measured shuffle sizes, partition coalescing, and the splitting of
# oversized partitions in joins and rebalanced writes. The last one lets Spark remove
# checkpoints nothing refers to any more, in a session that is created here.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    app_name: str = "precinct", *, master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Return the running session as it is, or create one with the settings above.

    A running session keeps its own time zone and settings; ``conf`` is for a new one.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
