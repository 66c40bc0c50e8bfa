"""Amino-acid property files: scalar records, matrices, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from serospark.functions.constants import AMINO_ACIDS, RECORD_PAIR_ORDER

NUMERIC_LINE = r"^\s*(-?\d+(\.\d*)?(\s+-?\d+(\.\d*)?)*)?\s*$"


def _read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="//\n").select(F.col("value").alias("record"))


def _code() -> Column:
    return F.regexp_extract("record", r"(?m)^H\s+(\S+)", 1)


def _numbers(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: w.try_cast("double"))


def parse_property_records(records: DataFrame) -> DataFrame:
    """``(prop, vals)`` from scalar records ``record``; incomplete records and any ``NA`` are dropped.

    The twenty numbers are assigned in the pairwise letter order of the published dictionaries
    (first, second letter of each heading), then put in alphabet order.
    """
    letters = [aa for pair in RECORD_PAIR_ORDER for aa in pair.split("/")]
    block = F.regexp_extract("record", r"(?ms)^I[^\n]*\n(.*)", 1)
    parsed = records.select(_code().alias("prop"), block.alias("_b")).filter((F.col("prop") != "") & ~F.col("_b").contains("NA"))
    parsed = parsed.withColumn("_v", _numbers(F.regexp_replace("_b", "//", ""))).filter((F.size("_v") == 20) & ~F.exists("_v", lambda v: v.isNull()))
    return parsed.select("prop", F.array(*[F.element_at("_v", letters.index(aa) + 1) for aa in AMINO_ACIDS]).alias("vals"))


def read_property_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_property_records(_read_records(spark, path))


def parse_property_matrices(records: DataFrame, alphabet: str | None = AMINO_ACIDS) -> DataFrame:
    """``(prop, row_letters, col_letters, vals, triangular)`` from matrix records.

    Numbers are read line by line until the first other line. A record counts if it holds a full
    matrix or the lower triangle of a square one. ``alphabet`` restricts both letter orders;
    None takes any.
    """
    rows = F.regexp_extract("record", r"(?m)^M rows\s*=\s*([A-Z\-]+)", 1)
    cols = F.regexp_extract("record", r"(?m)^M rows[^\n]*cols\s*=\s*([A-Z\-]+)", 1)
    rest = F.regexp_extract("record", r"(?ms)^M rows[^\n]*\n(.*)", 1)
    found = records.select(_code().alias("prop"), rows.alias("row_letters"), cols.alias("col_letters"), F.split(rest, "\n").alias("_l"))
    found = found.filter("prop <> '' AND row_letters <> '' AND col_letters <> ''")
    if alphabet is not None:
        found = found.filter((F.col("row_letters") == alphabet) & (F.col("col_letters") == alphabet))
    stop = F.array_position(F.transform("_l", lambda line: line.rlike(NUMERIC_LINE)), F.lit(False))
    kept = F.when(stop == 0, F.col("_l")).otherwise(F.slice("_l", F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    found = found.withColumn("vals", _numbers(F.array_join(kept, " ")))
    n, m, size = F.length("row_letters"), F.length("col_letters"), F.size("vals")
    half = (n == m) & (size == (n * (n + 1) / 2).cast("int"))
    return found.filter((size == n * m) | half).select("prop", "row_letters", "col_letters", "vals", (size != n * m).alias("triangular"))


def read_property_matrices(spark: SparkSession, path: str, alphabet: str | None = AMINO_ACIDS) -> DataFrame:
    return parse_property_matrices(_read_records(spark, path), alphabet)


def _full_values() -> Column:
    """All cells row by row; a lower triangle is mirrored."""
    n, m = F.length("row_letters"), F.length("col_letters")

    def cell(k: Column) -> Column:
        i, j = (k / m).cast("int"), k % m
        high, low = F.greatest(i, j), F.least(i, j)
        at = F.when(F.col("triangular"), (high * (high + 1) / 2).cast("int") + low).otherwise(k)
        return F.element_at("vals", at + 1)

    return F.transform(F.sequence(F.lit(0), n * m - 1), cell)


def matrices_to_cells(mats: DataFrame) -> DataFrame:
    """``(prop, cells)`` with 400 numbers, for matrices over the standard alphabet."""
    return mats.select("prop", _full_values().alias("cells"))


def matrices_to_long(mats: DataFrame) -> DataFrame:
    """``(prop, aa_i, aa_j, value)`` for any alphabet."""
    cells = mats.select("prop", "row_letters", "col_letters", F.posexplode(_full_values()).alias("_k", "value"))
    m = F.length("col_letters")
    return cells.select(
        "prop",
        F.substring("row_letters", (F.col("_k") / m).cast("int") + 1, F.lit(1)).alias("aa_i"),
        F.substring("col_letters", F.col("_k") % m + 1, F.lit(1)).alias("aa_j"),
        "value",
    )


def write_property_matrices(mats: DataFrame, path: str) -> None:
    """One CSV per matrix under ``prop=<code>``: letters on both edges, four decimals."""
    n, m = F.length("row_letters"), F.length("col_letters")
    values = F.transform(_full_values(), lambda v: F.format_string("%.4f", v))

    def line(i: Column) -> Column:
        return F.concat_ws(",", F.substring(F.col("row_letters"), i + 1, F.lit(1)), F.array_join(F.slice("_v", i * m + 1, m), ","))

    header = F.concat(F.lit(","), F.array_join(F.split("col_letters", ""), ","))
    body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), line), "\n")
    filled = mats.withColumn("_v", values)
    filled.select("prop", F.concat(header, F.lit("\n"), body).alias("value")).write.partitionBy("prop").text(path)


def read_matrix_csvs(spark: SparkSession, path: str) -> DataFrame:
    """Long cells of the files written by ``write_property_matrices``."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select("prop", F.split(F.trim("value"), "\n").alias("_l"))
    cells = lines.select("prop", F.split(F.element_at("_l", 1), ",").alias("_h"), F.explode(F.slice(F.col("_l"), F.lit(2), F.size("_l"))).alias("_line"))
    fields = cells.select("prop", "_h", F.split("_line", ",").alias("_f"))
    out = fields.select("prop", F.element_at("_f", 1).alias("aa_i"), F.posexplode(F.slice(F.col("_f"), F.lit(2), F.size("_f"))).alias("_j", "_v"), "_h")
    return out.select("prop", "aa_i", F.element_at("_h", F.col("_j") + 2).alias("aa_j"), F.col("_v").cast("double").alias("value"))


def write_property_json(props: DataFrame, path: str) -> None:
    """Scalar properties as JSON objects ``{code: {letter: value}}``, one per line."""
    by_letter = F.map_from_arrays(F.lit(list(AMINO_ACIDS)), F.col("vals"))
    props.select(F.to_json(F.create_map("prop", by_letter))).write.text(path)


def read_property_json(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``(prop, vals)`` from JSON objects: one per line, or one object filling each file."""
    text = spark.read.text(path, wholetext=whole_file)
    parsed = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("prop", "_m"))
    return parsed.select("prop", F.array(*[F.try_element_at("_m", F.lit(aa)) for aa in AMINO_ACIDS]).alias("vals"))


def write_matrix_json(mats: DataFrame, path: str) -> None:
    """Matrices as JSON objects ``{code: [[...], ...]}``, one per line; ``cells`` holds 400 numbers."""
    n = len(AMINO_ACIDS)
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("cells", i * n + 1, F.lit(n)))
    mats.select(F.to_json(F.create_map("prop", rows))).write.text(path)


def read_matrix_json(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``(prop, cells)`` from dict-of-matrix JSON."""
    text = spark.read.text(path, wholetext=whole_file)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("prop", "_m"))
    return parsed.select("prop", F.flatten("_m").alias("cells"))
