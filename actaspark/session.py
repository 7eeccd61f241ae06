"""Session defaults for local runs. On a cluster the submitted configuration is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, name: str = "actaspark", memory: str = "8g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    for k, v in {**LOCAL_CONF, **conf}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
