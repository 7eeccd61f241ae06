"""The registry of readers: a CSV with one row per reader, checked as a whole."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, functions as F

LAYOUT = "slug string, denominazione string, codice_istat string, modulo string, piattaforma_tecnica string, base_url string, stato string, provincia string, qs_base string, ente_mittente string, skip_ssl string, note string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed fields, blanks as null; skip_ssl as a truth value."""
    d = spark.read.csv(path, header=True, schema=LAYOUT)
    t = d.select(*[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in d.columns])
    return t.withColumn("skip_ssl", F.lower(F.coalesce("skip_ssl", F.lit(""))).isin("1", "true", "si", "sì", "yes"))


def problems(registry: DataFrame, modules: Collection[str], without_body: Collection[str] = (), needs_query: Collection[str] = (), needs_sender: Collection[str] = (), may_skip_ssl: Collection[str] = ()) -> DataFrame:
    """(slug, problema) of every rule a row breaks."""
    m = F.col("modulo")
    rules = {
        "slug ripetuto": F.col("_n") > 1,
        "modulo ignoto": ~F.coalesce(m, F.lit("")).isin(*modules),
        "codice non di sei caratteri": ~m.isin(*without_body) & (F.length(F.coalesce("codice_istat", F.lit(""))) != 6),
        "manca base_url": ~m.isin(*without_body) & F.col("base_url").isNull(),
        "manca qs_base": m.isin(*needs_query) & F.col("qs_base").isNull(),
        "qs_base fuori posto": ~m.isin(*needs_query) & F.col("qs_base").isNotNull(),
        "manca ente_mittente": m.isin(*needs_sender) & F.col("ente_mittente").isNull(),
        "skip_ssl fuori posto": ~m.isin(*may_skip_ssl) & F.col("skip_ssl"),
    }
    counts = registry.groupBy("slug").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("slug", "_s")
    d = registry.join(counts, F.col("slug").eqNullSafe(F.col("_s")))
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return d.select("slug", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problema"))


def runnable(registry: DataFrame, states: Collection[str] = ("attivo",), modules: Collection[str] | None = None) -> DataFrame:
    """Readers in a state in which they are run, of the modules asked for (all, if none are named); null states and modules are not run."""
    d = registry.where(F.col("stato").isin(*states) & F.col("modulo").isNotNull())
    return d if modules is None else d.where(F.col("modulo").isin(*modules))
