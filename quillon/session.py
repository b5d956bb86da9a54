"""Sessions with the settings that the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillon", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster pass master and sizes as settings instead.

    Adaptive execution sizes shuffles and splits skewed joins; broadcast joins stay behind Spark's size limit.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
