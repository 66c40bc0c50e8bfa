"""CSV and Parquet tables: titres, sequences, distance matrices, coordinates, names, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TITRE_COLUMNS = {"Test Virus": "test", "Reference Virus": "ref", "Titre": "titre"}


def quoted(name: str) -> Column:
    """A column whose name may hold dots, slashes or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def file_order() -> list[Column]:
    """``file`` and ``pos``: where a row was read. Rows of one block keep their order."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return [F.col("_metadata.file_path").alias("file"), place.alias("pos")]


def read_titres(spark: SparkSession, path: str) -> DataFrame:
    """Every report CSV of a folder as text: ``(test, ref, titre, report)``."""
    schema = ", ".join(f"`{c}` string" for c in TITRE_COLUMNS)
    raw = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    report = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return raw.select(*[quoted(old).alias(new) for old, new in TITRE_COLUMNS.items()], report.alias("report"))


def read_sequences(spark: SparkSession, path: str, name: str = "short_name", seq: str = "HA1_sequence") -> DataFrame:
    """``(name, seq, file, pos)`` from a CSV with these two columns among others."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(quoted(name).alias("name"), quoted(seq).alias("seq"), *file_order())


def read_distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV with row names to ``(a, b, dist)``, for any number of columns.

    Lines are read as text and cut in the task, so the plan has one projection however wide the
    matrix is. The first line holds the column names.
    """
    # A field is quoted, with doubled quotes inside, or free of commas.
    field = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace("value", r"\r$", "")), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(field, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    lines = spark.read.text(path).filter("value <> ''").select(plain.alias("f"))
    head = lines.first()["f"][1:]
    rows = lines.filter(F.slice("f", 2, len(head)) != F.lit(head)) if head else lines.limit(0)
    cells = rows.select(F.col("f")[0].alias("a"), F.posexplode(F.slice("f", 2, len(head))).alias("i", "d"))
    return cells.select("a", F.element_at(F.lit(head), F.col("i") + 1).alias("b"), F.col("d").try_cast("double").alias("dist"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``(name, MDS1, MDS2)``."""
    return spark.read.schema("name string, MDS1 double, MDS2 double").option("header", True).csv(path)


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """``(full_name, short_name)``; the reader drops a byte-order mark, CR and blank lines."""
    return spark.read.schema("full_name string, short_name string").option("header", True).csv(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``(prop_name, weight)``."""
    return spark.read.schema("prop_name string, weight double").option("header", True).csv(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """Ranked weights, heaviest first, in one file; the table has one row per property."""
    weights.select("prop_name", "weight").orderBy(F.desc("weight"), "prop_name").coalesce(1).write.option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Any result as Parquet, or as CSV with a header and null shown as an empty field."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_titres(pairs: DataFrame, path: str) -> None:
    """Curated pairs under the report column names."""
    write_table(pairs.select(F.col("virus_1").alias("Test Virus"), F.col("virus_2").alias("Reference Virus"), F.col("titre").alias("Titre")), path, "csv")


def distance_matrix(distances: DataFrame, max_columns: int = 10_000) -> DataFrame:
    """Long ``(a, b, dist)`` to a wide matrix for the sink; wider than ``max_columns`` raises."""
    found = [r[0] for r in distances.select("b").distinct().orderBy("b").limit(max_columns + 1).collect()]
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} matrix columns; keep the long form")
    return distances.groupBy("a").pivot("b", found).agg(F.max("dist"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Text corrections of single reports from a CSV ``report, ord, kind, find, replacement``."""
    schema = "report string, ord int, kind string, find string, replacement string"
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "")
    return reader.csv(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Header corrections per page from a CSV ``report, page_no, ord, target, action, pos, value``."""
    schema = "report string, page_no int, ord int, target string, action string, pos int, value string"
    return spark.read.schema(schema).option("header", True).csv(path)
