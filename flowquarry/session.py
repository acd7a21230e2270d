"""Session helper with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


HUGE_METHOD, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def compile_wide_plans(spark: SparkSession) -> None:
    """Have stages of wide rows run as small generated methods.

    The JVM never compiles a method above 8000 bytes, so a stage of 78 features in one method is interpreted row by row. Above
    this limit Spark generates its operators one by one instead, cut into methods that are compiled. Smaller limits stay.
    """
    if int(spark.conf.get(HUGE_METHOD)) > COMPILED_BYTES:
        spark.conf.set(HUGE_METHOD, COMPILED_BYTES)


def get_spark(app: str = "flowquarry", master: str | None = None, **conf) -> SparkSession:
    """Adaptive execution on, UTC clock; anything else comes from the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
