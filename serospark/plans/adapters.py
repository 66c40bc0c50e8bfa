"""The star-schema tables seen as assays, sequences, distances and points.

Each adapter reads whole tables and whole texts; the SQL twins live in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from serospark.functions.sites import step_distances, stretches
from serospark.plans.skew import spread

WINDOW = 64
# Stretches long enough for the whole HA1 slice and all published sites.
LONG_WINDOW = 361


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def busy_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table whose rows cost more than their transport, on all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def titre_text() -> Column:
    """Every titre form: ``*``, two bounds, powers of two times ten, a few illegal texts."""
    level = F.floor(F.col("l_tax") * 100 + 0.5).cast("int")
    return (
        F.when(F.col("l_linenumber") == 7, "*")
        .when(F.col("l_discount") < 0.005, "<20")
        .when(F.col("l_discount") < 0.025, "<40")
        .when((F.col("l_linenumber") == 6) & (level == 8) & (F.col("l_discount") > 0.095), "160.0")
        .otherwise((F.lit(10) * F.pow(F.lit(2), level)).cast("int").cast("string"))
    )


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense assay: suppliers against fifty sera, several rows per pair, both directions."""
    return busy_table(spark, sf_dir, "lineitem", *LINE_COLUMNS).select(
        F.concat(F.lit("A/"), F.col("l_suppkey").cast("string")).alias("test"),
        F.concat(F.lit("A/"), F.col("l_quantity").cast("int").cast("string")).alias("ref"),
        titre_text().alias("titre"),
        F.date_format("l_shipdate", "yyyy-MM").alias("report"),
        "l_orderkey",
        "l_linenumber",
    )


def sparse_assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse assay: orders against parts."""
    return busy_table(spark, sf_dir, "lineitem", *LINE_COLUMNS).select(
        F.concat(F.lit("T/"), F.col("l_orderkey").cast("string")).alias("test"),
        F.concat(F.lit("R/"), F.col("l_partkey").cast("string")).alias("ref"),
        titre_text().alias("titre"),
    )


def monthly_assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report month tests its own strains, so the graph falls apart into components."""
    month = F.date_format("l_shipdate", "yyyy-MM")
    return busy_table(spark, sf_dir, "lineitem", *LINE_COLUMNS).select(
        F.concat_ws("/", F.lit("T"), month, F.col("l_suppkey").cast("string")).alias("test"),
        F.concat_ws("/", F.lit("R"), month, F.col("l_quantity").cast("int").cast("string")).alias("ref"),
        titre_text().alias("titre"),
    )


def _strain(doc: Column, window: Column) -> Column:
    year = F.when(doc % 2 == 0, (F.lit(1968) + doc % 35).cast("string")).otherwise(
        F.lpad((doc % 26).cast("string"), 2, "0"))
    return F.concat_ws("/", F.lit("A"), F.col("lang"), F.concat_ws("-", doc.cast("string"), window.cast("string")), year)


def _document_windows(spark: SparkSession, sf_dir: str, window: int) -> DataFrame:
    return busy_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").select(
        "doc_id", "lang", "source", stretches(F.col("text"), window).alias("windows"))


def sequences(spark: SparkSession, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """Aligned sequences: every stretch of ``window`` letters of every document, the last one padded with gaps."""
    # Outer, so that the optimizer does not cut every text twice to test for emptiness.
    cut = _document_windows(spark, sf_dir, window).select("doc_id", "lang", "source", F.posexplode_outer("windows").alias("w", "seq")).filter("seq IS NOT NULL")
    return cut.select(
        _strain(F.col("doc_id"), F.col("w")).alias("name"),
        F.rpad("seq", window, "-").alias("seq"),
        F.col("source").alias("file"),
        (F.col("doc_id") * (1 << 32) + F.col("w")).alias("pos"),
        "doc_id",
        "w",
    )


def distances(spark: SparkSession, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """A distance for each stretch and the one after it: an eighth of their edit distance."""
    docs = _document_windows(spark, sf_dir, window)
    cut = docs.select("doc_id", "lang", F.posexplode_outer(step_distances(F.col("windows"), window)).alias("w", "steps")).filter("steps IS NOT NULL")
    return cut.select(
        _strain(F.col("doc_id"), F.col("w")).alias("a"),
        _strain(F.col("doc_id"), F.col("w") + 1).alias("b"),
        (F.col("steps") / 8.0).alias("dist"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("V/"), F.col("vec_id").cast("string")).alias("name"),
        F.transform("embedding", lambda x: x.cast("double")).alias("point"),
        "vec_id",
        "label",
    )


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the ones 1, 2, 3, 5 and 8 places later."""
    vec = table(spark, sf_dir, "embeddings").select("vec_id")
    steps = vec.select("vec_id", F.explode(F.lit([1, 2, 3, 5, 8])).alias("step"))
    later = steps.select("vec_id", (F.col("vec_id") + F.col("step")).alias("other"))
    known = later.join(vec.withColumnRenamed("vec_id", "other"), "other", "left_semi")
    return known.select(
        F.concat(F.lit("V/"), F.col("vec_id").cast("string")).alias("a"),
        F.concat(F.lit("V/"), F.col("other").cast("string")).alias("b"),
    )
