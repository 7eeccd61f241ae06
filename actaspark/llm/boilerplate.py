"""Lines that one source repeats across its documents.

Lines of a source form a graph: a node is a normalised line (lower case, letters only) weighted by the
number of documents it stands in, an edge joins lines that follow each other, weighted likewise. Nodes
and edges of high support stay; the connected components are the source's boilerplate blocks, and every
occurrence of their lines is reported or deleted.

Two passes read nothing but line hashes: the text is scanned once to write them (64-bit, compared only within one source).
The lines kept of a source are at most ten times its mean number of lines per document, as each stands in a tenth
of the documents, so a source's graph stays small however many documents it has.

A null text has no lines and does not count for its source's share; an empty one counts and has one blank line. A null
source is a source like any other. Repeated documents count each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from actaspark.storage import materialise, small_enough, spread

#: Fixed values of the check: letters of a line, documents, share of the source's documents.
LETTERS, DOCUMENTS, SHARE = 20, 4, 10
#: Kept lines up to which they are broadcast (8 bytes each, so 4 MB); beyond, a shuffled join is left to AQE.
BROADCAST_LINES = 500_000
BREAKS = "[\n\f]"


def line_keys(text: Column) -> Column:
    """The hash of every line's letters in order, null for lines with too few; null for a null text."""
    letters = F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\n\f]+", ""), BREAKS, -1)
    return F.transform(letters, lambda x: F.when(F.length(x) >= LETTERS, F.xxhash64(x)))


def keyed(docs: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    d = docs.where(F.col(text).isNotNull())
    d = spread(d.select(F.col(doc).alias("_doc"), F.col(source).alias("_source"), F.col(text).alias("_text")))
    return materialise(d.select("_doc", "_source", line_keys(F.col("_text")).alias("_keys")), "lines")


def nodes(keys: DataFrame) -> DataFrame:
    """(_source, _key, _n, _docs): the lines of high support."""
    total = keys.groupBy("_source").agg(F.count(F.lit(1)).alias("_docs"))
    each = keys.select("_source", F.explode(F.filter(F.array_distinct("_keys"), lambda k: k.isNotNull())).alias("_key"))
    n = each.groupBy("_source", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= DOCUMENTS)
    t = total.withColumnRenamed("_source", "_s")
    return n.join(t, F.col("_source").eqNullSafe(F.col("_s"))).where(F.col("_n") * SHARE >= F.col("_docs")).drop("_s")


def _with_kept(keys: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds ``_kept``, the source's kept lines; documents of sources without any are left out."""
    per = kept.groupBy(F.col("_source").alias("_s")).agg(F.collect_list("_key").alias("_kept"))
    if small_enough(kept, BROADCAST_LINES):
        per = F.broadcast(per)
    return keys.join(per, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")


def edges(keys: DataFrame, kept: DataFrame) -> DataFrame:
    """(_source, _a, _b): kept lines that follow each other, short lines aside, in enough of the source's documents."""
    seq = F.filter("_keys", lambda k: k.isNotNull())
    pairs = F.transform(F.sequence(F.lit(1), F.size("_seq") - 1), lambda i: F.struct(F.get("_seq", i - 1).alias("a"), F.get("_seq", i).alias("b")))
    k = _with_kept(keys, kept).select("_source", "_kept", seq.alias("_seq")).where(F.size("_seq") > 1)
    both = F.filter(pairs, lambda p: F.array_contains("_kept", p["a"]) & F.array_contains("_kept", p["b"]) & (p["a"] != p["b"]))
    e = k.select("_source", F.explode(F.array_distinct(both)).alias("p")).groupBy("_source", F.col("p.a").alias("_a"), F.col("p.b").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    t = kept.select(F.col("_source").alias("_s"), "_docs").distinct()
    return e.join(t, F.col("_source").eqNullSafe(F.col("_s"))).where((F.col("_n") >= DOCUMENTS) & (F.col("_n") * SHARE >= F.col("_docs"))).select("_source", "_a", "_b")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    nodes_ = pdf[pdf["_b"].isna()]
    for k in nodes_["_a"]:
        up[int(k)] = int(k)
    for a, b in pdf.loc[pdf["_b"].notna(), ["_a", "_b"]].itertuples(index=False):
        x, y = top(int(a)), top(int(b))
        up[max(x, y)] = min(x, y)
    keys = [int(k) for k in nodes_["_a"]]
    return pd.DataFrame({"_source": nodes_["_source"].to_numpy(), "_key": keys, "_block": [top(k) for k in keys], "_n": nodes_["_n"].to_numpy()})


def blocks(keys: DataFrame) -> DataFrame:
    """(_source, _key, _block, _n): the kept lines and the component each belongs to (its least hash)."""
    kept = materialise(nodes(keys), "nodes")
    e = edges(keys, kept)
    kind = keys.schema["_source"].dataType.simpleString()
    graph = kept.select("_source", F.col("_key").alias("_a"), F.lit(None).cast("long").alias("_b"), "_n").unionByName(e.withColumn("_n", F.lit(0).cast("long")))
    # exact text of hashes as strings: nullable longs would pass through doubles
    graph = graph.withColumns({"_a": F.col("_a").cast("string"), "_b": F.col("_b").cast("string")})
    return materialise(graph.groupBy("_source").applyInPandas(_components, f"_source {kind}, _key long, _block long, _n long"), "blocks")


def found(docs: DataFrame, doc: str = "id", source: str = "ente_id", text: str = "testo_estratto") -> DataFrame:
    """Every place of a boilerplate line: (atto_id, riga), lines counted from 1."""
    keys = keyed(docs, doc, source, text)
    k = _with_kept(keys, blocks(keys))
    at = F.filter(F.transform("_keys", lambda x, i: F.when(F.array_contains("_kept", x), (i + 1).cast("int"))), lambda x: x.isNotNull())
    return k.select(F.col("_doc").alias("atto_id"), F.explode(at).alias("riga"))


def block_report(docs: DataFrame, doc: str = "id", source: str = "ente_id", text: str = "testo_estratto") -> DataFrame:
    """(ente_id, righe, atti_max): the blocks of every source with their number of lines and highest support."""
    b = blocks(keyed(docs, doc, source, text))
    return b.groupBy(F.col("_source").alias(source), "_block").agg(F.count(F.lit(1)).alias("righe"), F.max("_n").alias("atti_max")).drop("_block")


def cleaned(docs: DataFrame, doc: str = "id", source: str = "ente_id", text: str = "testo_estratto") -> DataFrame:
    """(atto_id, testo_pulito): every document without its boilerplate lines and the breaks that end them.

    A null text stays null. If the last line goes, the break before it stays.
    """
    keys = keyed(docs, doc, source, text)
    per = blocks(keys).groupBy(F.col("_source").alias("_s")).agg(F.collect_list("_key").alias("_kept"))
    if small_enough(per, BROADCAST_LINES // 50):
        per = F.broadcast(per)
    d = docs.select(F.col(doc).alias("atto_id"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    d = d.join(per, F.col("_source").eqNullSafe(F.col("_s")), "left")
    breaks = F.regexp_extract_all("_text", F.lit("([\n\f])"), 1)
    parts = F.zip_with(F.arrays_zip(F.split("_text", BREAKS, -1).alias("t"), line_keys(F.col("_text")).alias("k")), breaks, lambda x, b: F.struct(F.concat(x["t"], F.coalesce(b, F.lit(""))).alias("t"), x["k"].alias("k")))
    kept = F.filter(parts, lambda p: p["k"].isNull() | ~F.array_contains(F.coalesce("_kept", F.array().cast("array<long>")), p["k"]))
    return d.select("atto_id", F.when(F.col("_text").isNotNull(), F.array_join(F.transform(kept, lambda p: p["t"]), "")).alias("testo_pulito"))


FOUND_SQL = r"""
WITH l AS (
  SELECT id, ente_id, generate_subscripts(x, 1) AS riga, unnest(x) AS k
  FROM (SELECT id, ente_id, string_split_regex(regexp_replace(lower(testo_estratto), '[^\p{L}\n\f]+', '', 'g'), '[\n\f]') AS x FROM atti WHERE testo_estratto IS NOT NULL)),
t AS (SELECT ente_id, count(*) AS docs FROM atti WHERE testo_estratto IS NOT NULL GROUP BY 1),
n AS (SELECT ente_id, k, count(DISTINCT id) AS n FROM l WHERE length(k) >= 20 GROUP BY 1, 2)
SELECT l.id AS atto_id, CAST(l.riga AS INTEGER) AS riga FROM l JOIN n USING (ente_id, k) JOIN t USING (ente_id) WHERE n.n >= 4 AND n.n * 10 >= t.docs
"""
