"""Merging of rows into keyed tables: first write wins, column-wise upsert, last write wins, change counts, stop on known rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from actaspark.operators.rank import row_number
from actaspark.storage import materialise


def _by_key(df: DataFrame, key: Sequence[str], best: DataFrame, how: str) -> DataFrame:
    """Joins rows with one row per key (``_k0``...), nulls equal; a hot key is split by AQE, as the other side has one row."""
    same = F.lit(True)
    for i, k in enumerate(key):
        same &= df[k].eqNullSafe(best[f"_k{i}"])
    return df.join(best, same, how)


def _best(df: DataFrame, key: Sequence[str], value: Column) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(value.alias("_best"))


def first_write(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key. Null key parts are values like others; order must leave no ties."""
    return _by_key(df, key, _best(df, key, F.min(order)), "inner").where(F.col(order) == F.col("_best")).select(*df.columns)


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """incoming with ``esito``: inserito for the first row of a key that existing lacks, else duplicato. Null key parts are values like others."""
    known = existing.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(key)]).distinct().withColumn("_known", F.lit(True))
    best = _best(incoming, key, F.min(order))
    same = F.lit(True)
    for i in range(len(key)):
        same &= best[f"_k{i}"].eqNullSafe(known[f"_e{i}"])
    best = best.join(known, same, "left").select(*best.columns, "_known")
    new = F.col("_known").isNull() & (F.col(order) == F.col("_best"))
    return _by_key(incoming, key, best, "inner").select(*incoming.columns, F.when(new, "inserito").otherwise("duplicato").alias("esito"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, overwrite: Sequence[str]) -> DataFrame:
    """Rows of both by key: new values replace the columns in overwrite, and of the others those that are not null."""
    new = incoming.select([F.col(c).alias(f"_{c}") for c in incoming.columns])
    j = existing.join(new, F.col(key) == F.col(f"_{key}"), "full")
    cols = []
    for c in existing.columns:
        if c == key:
            cols.append(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c))
        elif c not in incoming.columns:
            cols.append(F.col(c))
        elif c in overwrite:
            cols.append(F.when(F.col(f"_{key}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c))
    return j.select(*cols)


def last_write(df: DataFrame, key: Sequence, order: str) -> DataFrame:
    """The last row of each key (columns or expressions). Null key parts are values like others; order must leave no ties."""
    names = [f"_x{i}" for i in range(len(key))]
    d = df.withColumns({n: k if isinstance(k, Column) else F.col(k) for n, k in zip(names, key)})
    return _by_key(d, names, _best(d, names, F.max(order)), "inner").where(F.col(order) == F.col("_best")).select(*df.columns)


def refused(df: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose key is not null and no parent has (a foreign key refuses them)."""
    return df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent).alias(key)), key, "left_anti").select(*df.columns)


def cleared(df: DataFrame, where: Column, columns: Sequence[str]) -> DataFrame:
    """df with some columns null in the rows that a condition holds for; rows for which it is null stay."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def deleted(df: DataFrame, where: Column, key: str, links: DataFrame, link: str) -> tuple[DataFrame, DataFrame]:
    """df without the rows a condition holds for, and links with null where they named one of these."""
    gone = F.coalesce(where, F.lit(False))
    out = df.where(gone).select(F.col(key).alias("_gone")).distinct()
    j = links.join(out, links[link] == out["_gone"], "left")
    return df.where(~gone), j.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == link else c for c in links.columns])


def widened(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """df with the columns (name to type) it lacks, null; those it has stay as they are."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}) if columns else df


def stop_on_known(df: DataFrame, source: str, order: str, known: str, run: int = 20) -> DataFrame:
    """The rows a reader sees that stops after ``run`` known rows in a row; that last row included. A null mark is not known.

    Places in a source, and among its new rows, are numbered over ranges; the reader stops behind the first new row (or the start) that
    the next new row is more than ``run`` places away from. So no task holds a source.
    """
    same = lambda x: F.col(source).eqNullSafe(F.col(x))
    d = materialise(row_number(df, [source], [F.col(order)], "_place"), "places")
    fresh = d.where(~F.coalesce(F.col(known), F.lit(False))).select(source, "_place")
    n = row_number(fresh, [source], [F.col("_place")], "_k").select(F.col(source).alias("_s"), "_place", "_k")
    ends = d.groupBy(source).agg(F.max("_place").alias("_end")).select(F.col(source).alias("_s"), "_end")
    n = materialise(n.unionByName(ends.select("_s", F.lit(0).alias("_place"), F.lit(0).alias("_k"))), "news")
    after = n.select(F.col("_s").alias("_s2"), F.col("_place").alias("_next"), (F.col("_k") - 1).alias("_k2"))
    gap = n.join(after, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_k") == F.col("_k2")), "left").drop("_s2").join(ends.withColumnRenamed("_s", "_s3"), F.col("_s").eqNullSafe(F.col("_s3")))
    wide = F.coalesce("_next", F.col("_end") + 1) - F.col("_place") > run
    stop = gap.where(wide).groupBy("_s").agg((F.min("_place") + run).alias("_stop"))
    return d.join(stop, same("_s"), "left").where(F.col("_stop").isNull() | (F.col("_place") <= F.col("_stop"))).select(*df.columns)
