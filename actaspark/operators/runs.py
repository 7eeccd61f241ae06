"""The log of reading runs: an append-only table of starts and ends, from which runs and each reader's last good run follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from actaspark.operators.tables import first_write

LAYOUT = "lettore string, giorno string, avviato string, terminato string, trovati long, nuovi long, errore string"


class RunLog:
    """Starts and ends of runs in a folder. A run is named by reader and start; an end given again replaces nothing, the first counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, *row) -> None:
        self.spark.createDataFrame([row], LAYOUT).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, reader: str, at: str) -> None:
        self._write(reader, at[:10], at, None, None, None, None)

    def finish(self, reader: str, started: str, at: str, found: int = 0, new: int = 0, error: str | None = None) -> None:
        self._write(reader, started[:10], started, at, found, new, error)

    def runs(self) -> DataFrame:
        """One row per run; a run without an end has a null end."""
        d = self.spark.read.schema(LAYOUT).parquet(self.path)
        end = F.min(F.when(F.col("terminato").isNotNull(), F.struct("terminato", "trovati", "nuovi", "errore"))).alias("e")
        return d.groupBy("lettore", "avviato").agg(F.min("giorno").alias("giorno"), end).select("lettore", "giorno", "avviato", "e.terminato", "e.trovati", "e.nuovi", "e.errore")


def from_rows(rows: DataFrame, key: Sequence[str], order: str, reader: str, at: str) -> DataFrame:
    """The runs that rows with a time of retrieval come from: one per reader and day; rows without either belong to none."""
    first = first_write(rows, key, order).select(F.col(order).alias("_primo"))
    d = rows.join(first, F.col(order) == F.col("_primo"), "left").where(F.col(reader).isNotNull() & F.col(at).isNotNull())
    g = d.groupBy(F.col(reader).alias("lettore"), F.substring(at, 1, 10).alias("giorno")).agg(F.min(at).alias("avviato"), F.max(at).alias("terminato"), F.count(F.lit(1)).alias("trovati"), F.count("_primo").alias("nuovi"))
    return g.withColumn("errore", F.when(F.col("nuovi") == 0, "nessun atto nuovo"))


def last_good(runs: DataFrame) -> DataFrame:
    """Each reader's last run that ended without an error."""
    keep = F.struct("giorno", "avviato", "terminato", "trovati", "nuovi")
    good = runs.where("terminato is not null and errore is null").groupBy("lettore").agg(F.max_by(keep, F.struct("avviato", "giorno")).alias("r"))
    return good.select("lettore", "r.*")
