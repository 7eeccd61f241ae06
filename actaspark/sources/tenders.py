"""Tender files with ``;`` between fields, and their rows as acts of registered bodies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from actaspark.operators.setjoin import holders
from actaspark.operators.tables import insert_new


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], aliases: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """The named columns of a file with a header, as trimmed text, blanks as null.

    Header names are compared trimmed and in lower case, after ``aliases`` (old name to new); of several columns of one name the first
    counts, missing ones are null, others are left out.
    """
    raw = spark.read.csv(path, sep=";", header=True, inferSchema=False, multiLine=False)
    by_name: dict[str, str] = {}
    for c in raw.columns:
        name = c.strip().strip("﻿\"'").strip().lower()
        by_name.setdefault(aliases.get(name, name), c)
    value = lambda c: F.trim(F.col(f"`{by_name[c]}`")) if c in by_name else F.lit(None).cast("string")
    return raw.select(*[F.when(value(c) != "", value(c)).alias(c) for c in columns])


def in_region(section: Column, region: str) -> Column:
    return F.coalesce(F.lower(F.trim(section)) == region.lower(), F.lit(False))


def amount(c: Column) -> Column:
    """A number with points for thousands and a comma, else null."""
    t = F.trim(c)
    whole = t.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?)$")
    return F.when(whole, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(38,2)"))


def outcomes(rows: DataFrame, bodies: DataFrame, region: str) -> DataFrame:
    """Rows of the region as acts with ``esito``: saltato without a body or a code, inserito for the first of a body and code, else duplicato.

    A row's body is the first by id whose name holds the row's in lower case; a blank name has none.
    """
    r = rows.where(in_region(F.col("sezione_regionale"), region)).select(
        "riga_id", F.when(F.trim("cig") != "", F.trim("cig")).alias("cig"), F.lower(F.trim("denominazione_amministrazione")).alias("nome"),
        F.concat("anno_pubblicazione", F.lit("-"), F.lpad("mese_pubblicazione", 2, "0")).alias("mese"), amount(F.col("importo_totale_appalto")).alias("importo"),
        F.try_to_date("data_creazione", "dd/MM/yyyy").alias("giorno"),
    )
    body = holders(r.select("nome").where("nome <> ''").distinct(), bodies.select("id", F.lower("denominazione").alias("intero")))
    r = r.join(body.withColumnRenamed("id", "ente_id"), "nome", "left").withColumn("url_fonte", F.concat(F.lit("anac:"), "cig"))
    known = F.col("ente_id").isNotNull() & F.col("cig").isNotNull()
    good = r.where(known)
    done = insert_new(good.limit(0), good, ["ente_id", "url_fonte"], "riga_id")
    return done.unionByName(r.where(~known).withColumn("esito", F.lit("saltato")))
