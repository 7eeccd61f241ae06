"""Similarity joins within blocks by prefix filter: no pair is looked at that shares none of its rarest members.

Equal sets of a block are one class, so copies are never paired with each other; the result relates classes, and membership
is returned beside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from actaspark.operators.rank import top
from actaspark.storage import materialise

#: Classes of a tile, and members that are counted at once (4 MB for 1,000 rows).
TILE, WIDE = 1_000, 1_024


def classes(df: DataFrame, block: str, key: str, members: Column) -> DataFrame:
    """(block, key, classe, insieme): the class of a row is a hash of its set. Rows with an empty set are left out."""
    d = df.select(block, key, F.array_sort(F.array_distinct(members)).alias("insieme")).where(F.col(block).isNotNull() & (F.size("insieme") > 0))
    return d.withColumn("classe", F.sha2(F.array_join("insieme", "\x1f"), 256))


def _ranked(sets: DataFrame, block: str) -> DataFrame:
    """Members ordered by rarity over all blocks; ``insieme`` becomes an array of them, rarest first."""
    each = sets.select(block, "classe", F.explode("insieme").alias("m"))
    n = each.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    return each.join(n, "m").groupBy(block, "classe").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x["m"]).alias("insieme"))


def jaccard_join(left: DataFrame, right: DataFrame, block: str, least: float) -> DataFrame:
    """(block, classe_a, classe_b, somiglianza) of classes of left and right (each block, classe, insieme) of at least that Jaccard.

    A pair needs a common member among the first n - ceil(least * n) + 1 of each; lengths must agree within the bound.
    """
    a = left.select(block, "classe", "insieme").dropDuplicates([block, "classe"])
    b = right.select(block, "classe", "insieme").dropDuplicates([block, "classe"])
    ranked = materialise(_ranked(a.unionByName(b).dropDuplicates([block, "classe"]), block), "sets")
    prefix = F.slice("insieme", 1, F.greatest(F.size("insieme") - F.ceil(F.size("insieme") * least - 1e-9).cast("int") + 1, F.lit(1)))
    side = lambda df, s: ranked.join(df.select(block, "classe"), [block, "classe"], "left_semi").select(block, F.col("classe").alias(f"classe_{s}"), F.col("insieme").alias(f"insieme_{s}"), F.explode(prefix).alias("m"))
    j = side(a, "a").join(side(b, "b"), [block, "m"])
    j = j.where((F.size("insieme_a") >= least * F.size("insieme_b") - 1e-9) & (F.size("insieme_b") >= least * F.size("insieme_a") - 1e-9))
    j = j.dropDuplicates([block, "classe_a", "classe_b"])
    both = F.size(F.array_intersect("insieme_a", "insieme_b"))
    s = both / (F.size("insieme_a") + F.size("insieme_b") - both)
    return j.select(block, "classe_a", "classe_b", s.alias("somiglianza")).where(F.col("somiglianza") >= least)


def jaccard_pairs(sets: DataFrame, block: str, least: float) -> DataFrame:
    """As jaccard_join(sets, sets) for a low bound, where most members would be in a prefix: all pairs of a block are counted.

    A block is dealt into tiles of about TILE classes; of two tiles the common members are the product of two 0/1 matrices. The
    classes of a block are sent once for each of its tiles.
    """
    a = sets.select(block, "classe", "insieme").dropDuplicates([block, "classe"])
    tiles = a.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("k"))
    t = a.join(tiles, block).withColumn("i", F.pmod(F.xxhash64("classe"), "k").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    t = t.select(block, "classe", "insieme", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") <= F.col("j")).alias("prima"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        size = g["insieme"].map(len).to_numpy()
        row = np.repeat(np.arange(len(g)), size)
        code, names = pd.factorize(np.concatenate(g["insieme"].to_list()))
        first = g["prima"].to_numpy()
        ia, ib = (np.flatnonzero(first), np.flatnonzero(~first)) if key[1] != key[2] else (np.arange(len(g)),) * 2
        both = np.zeros((len(ia), len(ib)), np.float32)
        for low in range(0, len(names), WIDE):
            some = (code >= low) & (code < low + WIDE)
            m = np.zeros((len(g), min(WIDE, len(names) - low)), np.float32)
            m[row[some], code[some] - low] = 1
            both += m[ia] @ m[ib].T
        likeness = both.astype(np.float64) / (size[ia][:, None] + size[ib][None, :] - both)
        p, q = np.nonzero(likeness >= least)
        name = g["classe"].to_numpy()
        out = pd.DataFrame({block: key[0], "classe_a": name[ia[p]], "classe_b": name[ib[q]], "somiglianza": likeness[p, q]})
        return out if key[1] == key[2] else pd.concat([out, out.rename(columns={"classe_a": "classe_b", "classe_b": "classe_a"})[list(out)]])

    kind = sets.schema[block].dataType.simpleString()
    return t.groupBy(block, "x", "y").applyInPandas(run, f"{block} {kind}, classe_a string, classe_b string, somiglianza double")


def linked(df: DataFrame, block: str, key: str, members: Column, least: float) -> DataFrame:
    """(block, key, classe, legami): every row with its class and the number of other rows of its block that are as similar.

    Rows of one class are similar to each other. Rows with an empty set have a null class and no links.
    """
    c = materialise(classes(df, block, key, members), "classes")
    size = c.groupBy(block, "classe").agg(F.count(F.lit(1)).alias("righe"), F.first("insieme").alias("insieme"))
    pairs = jaccard_join(size, size, block, least)
    n = pairs.join(size.select(block, F.col("classe").alias("classe_b"), "righe"), [block, "classe_b"]).groupBy(block, F.col("classe_a").alias("classe")).agg((F.sum("righe") - 1).alias("legami"))
    out = c.select(block, key, "classe").join(n, [block, "classe"], "left")
    return df.select(block, key).join(out.select(F.col(key).alias("_k"), "classe", "legami"), F.col(key) == F.col("_k"), "left").select(block, key, "classe", F.coalesce("legami", F.lit(0)).alias("legami"))


def greedy_leaders(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(nodo, capo): star clusters of a symmetric graph in scan order: a node leads unless an earlier neighbour does, and follows its first leader.

    pairs: (a, b) both ways; order: (nodo, posto), places distinct. Rounds decide every node whose earlier neighbours are decided, as many as the
    longest chain of dependences; nodes without neighbours lead themselves.
    """
    o = materialise(order.select("nodo", "posto"), "order")
    e = pairs.join(o.withColumnsRenamed({"nodo": "a", "posto": "pa"}), "a").join(o.withColumnsRenamed({"nodo": "b", "posto": "pb"}), "b").where("pb < pa")
    e = materialise(e.select("a", "b", "pb"), "edges")
    state = materialise(o.select("nodo", F.lit(None).cast("boolean").alias("guida")), "state")
    while True:
        known = e.join(state.select(F.col("nodo").alias("b"), "guida"), "b").groupBy(F.col("a").alias("nodo")).agg(F.max(F.coalesce("guida", F.lit(False))).alias("sotto"), F.min(F.col("guida").isNotNull()).alias("noti"))
        nxt = state.join(known, "nodo", "left").select("nodo", F.coalesce("guida", F.when(F.col("sotto"), F.lit(False)).when(F.coalesce("noti", F.lit(True)), F.lit(True))).alias("guida"))
        state = materialise(nxt, "state")
        if not state.where("guida is null").limit(1).count():
            break
    lead = e.join(state.where("guida").select(F.col("nodo").alias("b")), "b").groupBy(F.col("a").alias("nodo")).agg(F.min(F.struct("pb", "b"))["b"].alias("capo"))
    return state.join(lead, "nodo", "left").select("nodo", F.when(F.col("guida"), F.col("nodo")).otherwise(F.col("capo")).alias("capo"))


def holders(needles: DataFrame, hay: DataFrame, grams: int = 5) -> DataFrame:
    """(nome, id): for each distinct ``nome`` the least id of hay (id, intero) whose text holds it.

    A needle meets only texts that hold its rarest run of ``grams`` characters (a shorter one itself); one that holds a run no text has is
    not joined at all.
    """
    each = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))
    sizes = F.sequence(F.lit(1), F.lit(grams))
    h = hay.where("intero is not null").withColumn("g", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda n: each(F.col("intero"), n))))))
    h = materialise(h, "grams")
    many = h.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("nome") >= grams, F.array_distinct(each(F.col("nome"), F.lit(grams)))).otherwise(F.array("nome"))
    n = needles.select("nome", F.explode(own).alias("g")).join(many, "g", "left")
    rare = n.groupBy("nome").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("nome", "r.g")
    return rare.join(h, "g").where(F.contains("intero", F.col("nome"))).groupBy("nome").agg(F.min("id").alias("id"))


def round_robin(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first rows taken in turn from each group, groups in order of their first row. No group needs more than ``limit`` rows."""
    few = top(df, [group], [F.col(order)], limit, "_r")
    d = few.withColumn("_g", F.min(order).over(Window.partitionBy(group)))
    return d.orderBy("_r", "_g", order).limit(limit).select(*df.columns)
