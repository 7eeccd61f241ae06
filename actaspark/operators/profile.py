"""Column profiles kept as value-count tables.

For every load (day of retrieval) and column the table holds each value with its number of rows. A load
adds its rows as a signed delta and is taken back by the negated one; the sum of the deltas is the exact
count of every value, from which null rates, distinct counts, ranges, entropy, medians, pattern
violations and changes between loads follow without another look at the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from actaspark.operators.quantile import grouped_median
from actaspark.storage import materialise, remove, shared_dir

#: Fixed values of the check.
LOWEST_DATE, LARGEST_AMOUNT = "1990-01-01", 100_000_000.0
LOAD_ROWS, NULL_EXCESS, DAYS, FACTOR, TOP_COUNT = 20, 0.25, 180, 8.0, 5
COLUMNS = ("data_atto", "importo_euro", "cig")
LAYOUT = "carico string, campo string, valore string, n long"


class ValueCounts:
    """Value-count tables in a folder: an append-only log of signed deltas.

    ``apply`` adds a load's rows (sign 1) or takes them back (sign -1); ``counts`` sums the log;
    ``compact`` replaces it by its sum. A value whose deltas sum to 0 is gone; a negative sum is an error of
    the caller and is reported by ``check``. Nulls are counted under a null value.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/actaspark/counts-{uuid.uuid4().hex}"

    @staticmethod
    def delta(rows: DataFrame, load: Column, columns: Sequence[str], sign: int = 1) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valore")) for c in columns])
        e = rows.select(load.alias("carico"), F.explode(entries).alias("e")).select("carico", "e.campo", "e.valore")
        return e.groupBy("carico", "campo", "valore").agg((F.count(F.lit(1)) * sign).alias("n"))

    def apply(self, rows: DataFrame, load: Column, columns: Sequence[str], sign: int = 1) -> ValueCounts:
        self.delta(rows, load, columns, sign).write.mode("append").parquet(f"{self.path}/{self._current()}")
        return self

    def _current(self) -> str:
        """The folder of the log: that of the last compaction that ended, which Spark marks with a file."""
        done = [g for g in self._folders() if self._exists(f"{self.path}/{g}/_SUCCESS")]
        return max(done, default="log-0", key=lambda g: int(g[4:]))

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _folders(self) -> list[str]:
        p, fs = self._fs(self.path)
        return [x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("log-")] if fs.exists(p) else []

    def counts(self) -> DataFrame:
        log = self.spark.read.schema(LAYOUT).parquet(f"{self.path}/{self._current()}")
        return log.groupBy("carico", "campo", "valore").agg(F.sum("n").alias("n")).where("n <> 0")

    def check(self) -> DataFrame:
        return self.counts().where("n < 0")

    def compact(self) -> ValueCounts:
        """Writes the sum as the next log, which counts from the moment it is complete; the old one is removed after that.

        A crash before leaves the old log, one after leaves the new; no load may be applied meanwhile.
        """
        old = self._current()
        self.counts().write.mode("overwrite").parquet(f"{self.path}/log-{int(old[4:]) + 1}")
        remove(self.spark, f"{self.path}/{old}")
        return self

    def drop(self) -> None:
        remove(self.spark, self.path)


def load_day(accessed: Column) -> Column:
    """The load of a row: the day of its retrieval, null where that is null."""
    return F.substring(accessed, 1, 10)


def _date(v: Column) -> Column:
    """The date of a value written exactly YYYY-MM-DD, else null."""
    return F.when(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~v.startswith("0000"), F.try_to_date(v, "yyyy-MM-dd"))


def defect(column: str, value: Column, day: Column) -> Column:
    """``formato``, ``intervallo`` or null (a good value) of a non-null value given as text; null of a null."""
    if column == "data_atto":
        d = _date(value)
        wrong, outside = d.isNull(), (d < F.lit(LOWEST_DATE).cast("date")) | (d > _date(day))
    elif column == "importo_euro":
        x = value.cast("double")
        wrong, outside = F.isnan(x), (x < 0) | (x > LARGEST_AMOUNT)
    elif column == "cig":
        wrong, outside = ~value.rlike(r"\A[A-Z0-9]{10}\z") | value.rlike(r"\A(.)\1{9}\z"), F.lit(False)
    else:
        raise ValueError(f"no rule for column {column}")
    return F.when(value.isNull(), None).when(wrong, "formato").when(outside, "intervallo")


def _defect_of(campo: Column, value: Column, day: Column) -> Column:
    out = F.lit(None).cast("string")
    for c in COLUMNS:
        out = F.when(campo == c, defect(c, F.when(campo == c, value), day)).otherwise(out)
    return out


def judged_counts(counts: DataFrame) -> DataFrame:
    """Adds ``difetto`` and, for good values, the number whose median is compared (days before the load, amount)."""
    c = counts.withColumn("difetto", _defect_of(F.col("campo"), F.col("valore"), F.col("carico")))
    good = F.col("valore").isNotNull() & F.col("difetto").isNull()
    number = F.when(F.col("campo") == "data_atto", F.datediff(_date(F.col("carico")), _date(F.when(F.col("campo") == "data_atto", F.col("valore")))).cast("double")).when(
        F.col("campo") == "importo_euro", F.when(F.col("campo") == "importo_euro", F.col("valore")).cast("double")
    )
    return c.withColumn("buono", good).withColumn("numero", F.when(good, number))


def row_defects(rows: DataFrame, key: str = "id") -> DataFrame:
    """Every offending value as a row (ambito ``riga``): chiave, campo, difetto. Each row is judged by itself."""
    day = load_day(F.col("data_accesso"))
    each = F.array(*[F.struct(F.lit(c).alias("campo"), defect(c, F.col(c).cast("string"), day).alias("difetto")) for c in COLUMNS])
    e = rows.select(F.col(key).cast("string").alias("chiave"), F.explode(F.filter(each, lambda x: x["difetto"].isNotNull())).alias("e"))
    return e.select(F.lit("riga").alias("ambito"), "chiave", "e.campo", "e.difetto")


def load_metrics(judged: DataFrame) -> DataFrame:
    """Per load and column: rows, nulls, good values, count of the commonest good value, median."""
    totals = judged.groupBy("carico", "campo").agg(
        F.sum("n").alias("righe"),
        F.sum(F.when(F.col("valore").isNull(), F.col("n")).otherwise(0)).alias("nulli"),
        F.sum(F.when(F.col("buono"), F.col("n")).otherwise(0)).alias("buoni"),
        F.max(F.when(F.col("buono"), F.col("n"))).alias("massimo"),
    )
    numbers = judged.where(F.col("numero").isNotNull()).select("carico", "campo", "numero", "n")
    return totals.join(grouped_median(numbers, ["carico", "campo"], "numero", "n", "mediana"), ["carico", "campo"], "left")


def table_metrics(judged: DataFrame) -> DataFrame:
    """The same over the whole table, per column (three rows)."""
    totals = judged.groupBy("campo").agg(F.sum("n").alias("righe_t"), F.sum(F.when(F.col("valore").isNull(), F.col("n")).otherwise(0)).alias("nulli_t"))
    numbers = judged.where(F.col("numero").isNotNull()).groupBy("campo", "numero").agg(F.sum("n").alias("n"))
    return totals.join(grouped_median(numbers, ["campo"], "numero", "n", "mediana_t"), ["campo"], "left")


def load_defects(judged: DataFrame) -> DataFrame:
    """Every offending load (ambito ``carico``): null share or distribution unlike the table's. Rows without a load count
    for the table only."""
    m = load_metrics(judged.where(F.col("carico").isNotNull())).where(F.col("righe") >= LOAD_ROWS)
    m = m.join(F.broadcast(table_metrics(judged)), "campo")  # one row per profiled column
    nulls = F.col("nulli") / F.col("righe") - F.col("nulli_t") / F.col("righe_t") > NULL_EXCESS
    shift = (
        F.when(F.col("campo") == "data_atto", F.abs(F.col("mediana") - F.col("mediana_t")) > DAYS)
        .when(F.col("campo") == "importo_euro", (F.col("mediana") * FACTOR < F.col("mediana_t")) | (F.col("mediana") > F.col("mediana_t") * FACTOR))
        .when(F.col("campo") == "cig", (F.col("massimo") * 4 > F.col("buoni")) & (F.col("massimo") >= TOP_COUNT))
    )
    both = F.filter(F.array(F.when(nulls, "nulli"), F.when(shift, "spostamento")), lambda x: x.isNotNull())
    return m.select(F.lit("carico").alias("ambito"), F.col("carico").alias("chiave"), "campo", F.explode(both).alias("difetto"))


def maintained(rows: DataFrame, name: str = "judged") -> DataFrame:
    """The judged counts of the whole input, written; the log they are summed from is dropped."""
    log = ValueCounts(rows.sparkSession).apply(rows, load_day(F.col("data_accesso")), COLUMNS)
    judged = materialise(judged_counts(log.counts()), name)
    log.drop()
    return judged


def found(rows: DataFrame) -> DataFrame:
    """Offending values and loads; see TESTDATA.md. Null values are no cases; an empty table gives no rows."""
    rows = rows.select("id", "data_accesso", *COLUMNS)
    judged = maintained(rows)
    return row_defects(rows).unionByName(load_defects(judged))


def profile(rows: DataFrame) -> DataFrame:
    """Per column of the whole table: rows, nulls, distinct values, formato and intervallo rows, entropy in bits, range.

    Entropy and distinct count are over non-null values, taken from the maintained counts; minimum and maximum are over good
    values, as text (amounts with two decimals). Columns without good values have a null range.
    """
    judged = maintained(rows.select("id", "data_accesso", *COLUMNS))
    by_value = judged.groupBy("campo", "valore").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("difetto") == d, F.col("n")).otherwise(0)).alias(d) for d in ("formato", "intervallo")], F.max("buono").alias("buono"), F.max("numero").alias("numero"))
    x = F.when(F.col("valore").isNotNull(), F.col("n"))
    best = F.when(F.col("buono"), F.struct(F.when(F.col("campo") == "importo_euro", F.col("numero")).alias("o"), F.when(F.col("campo") == "importo_euro", F.format_string("%.2f", "numero")).otherwise(F.col("valore")).alias("valore")))
    p = by_value.groupBy("campo").agg(
        F.sum("n").alias("righe"), (F.sum("n") - F.coalesce(F.sum(x), F.lit(0))).alias("nulli"), F.count(x).alias("distinti"), F.sum("formato").alias("formato"), F.sum("intervallo").alias("intervallo"),
        F.sum(x).alias("_s"), F.sum(x * F.log2(x)).alias("_l"), F.min(best)["valore"].alias("minimo"), F.max(best)["valore"].alias("massimo"),
    )
    return p.withColumn("entropia", F.round(F.log2("_s") - F.col("_l") / F.col("_s"), 6)).drop("_s", "_l")


def profile_by_load(rows: DataFrame) -> DataFrame:
    """Metrics of every load and column: rows, nulls, good values, commonest good value's count, median."""
    judged = maintained(rows.select("id", "data_accesso", *COLUMNS))
    return load_metrics(judged)
