"""Files of cases, and the list of municipalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MUNICIPALITIES = "denominazione string, provincia string, codice_istat string, popolazione int"


def case_files(spark: SparkSession, path: str) -> DataFrame:
    """(percorso, nome, genere, testo, contenuto) of the .txt and .pdf files below a folder; testo of text files, contenuto of the others.

    Names are compared without regard to case of their ending; ``posto`` orders a folder's files by name.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,TXT,pdf,PDF}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    text = kind == "txt"
    return d.select(F.col("path").alias("percorso"), name.alias("nome"), kind.alias("genere"), F.when(text, F.decode("content", "UTF-8")).alias("testo"), F.when(~text, F.col("content")).alias("contenuto"))


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """Municipalities of a file with a header: trimmed text, codes of six digits with their leading zeros."""
    d = spark.read.csv(path, header=True, schema=MUNICIPALITIES, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return d.withColumn("codice_istat", F.when(F.length("codice_istat") < 6, F.lpad("codice_istat", 6, "0")).otherwise(F.col("codice_istat")))
