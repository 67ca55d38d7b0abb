"""Session settings that the engine's results depend on."""

from pyspark.sql import SparkSession


def session(app: str = "photark", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's own."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
