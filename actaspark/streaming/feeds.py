"""Streams of acts and events: idempotent ingest, windows with late data, readers that stop on known rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from actaspark.operators.tables import insert_new


class IdempotentSink:
    """``foreachBatch`` sink that adds the rows whose key the table lacks; a batch given again adds nothing.

    Each batch is written to its own folder, overwritten if the batch is retried, so a lost executor or driver leaves no duplicates. Rows lie
    in folders by a hash of their key as well, and a batch reads only the folders its keys fall in.
    """

    def __init__(self, path: str, key: list[str], order: str, buckets: int = 64):
        self.path, self.key, self.order, self.buckets = path, key, order, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = [r["secchio"] for r in batch.select(self._bucket().alias("secchio")).distinct().collect()]  # at most as many as buckets
        known = self.table(spark, batch.schema, batch_id, mine)
        new = insert_new(known, batch, self.key, self.order).where("esito = 'inserito'").drop("esito")
        new.withColumn("secchio", self._bucket()).write.mode("overwrite").partitionBy("secchio").parquet(f"{self.path}/lotto={batch_id}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit(self.buckets)).cast("int")

    def table(self, spark: SparkSession, schema, but: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """What was written so far, without one batch, or of some hash folders only. Only a folder that is not there is an empty table."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], schema)
        d = spark.read.schema(T.StructType([*schema.fields, T.StructField("lotto", T.LongType()), T.StructField("secchio", T.IntegerType())])).parquet(self.path)
        if but is not None:
            d = d.where(F.col("lotto") != but)
        if buckets is not None:
            d = d.where(F.col("secchio").isin(buckets))
        return d.drop("lotto", "secchio")


def tumbling(events: DataFrame, time: str, group: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and group; rows later than the watermark are dropped in streams, none in batches."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    w = e.groupBy(F.window(time, length), group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("somma"))
    return w.select(F.col("window.start").alias("dal"), group, "n", F.col("somma").cast("decimal(28,4)").alias("somma"))


def sessions(events: DataFrame, time: str, group: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("dal"), group, "n")


def until_known(rows: DataFrame, source: str, run: int = 20) -> DataFrame:
    """Rows of each source up to its ``run``-th known row in a row (columns: source, posto, noto), over all batches of a stream."""
    kind = rows.schema[source].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, done = state.get if state.exists else (0, False)
        # a source's rows of one trigger may come in several Arrow batches; two narrow columns of them are put in order together
        whole = pd.concat(list(batches)).sort_values("posto")
        out = []
        for place, known in whole[["posto", "noto"]].itertuples(index=False):
            if done:
                break
            out.append((key[0], place))
            length = length + 1 if known else 0
            done = length >= run
        state.update((length, done))
        yield pd.DataFrame(out, columns=[source, "posto"])

    return rows.groupBy(source).applyInPandasWithState(step, f"{source} {kind}, posto long", "lunghezza int, finito boolean", "append", GroupStateTimeout.NoTimeout)
