"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from serospark.sources.tables import file_order


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(id, description, seq, file, pos)``; records are split by the reader, files may be large."""
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("record"), *file_order())
    header = F.trim(F.regexp_replace(F.substring_index("record", "\n", 1), "\r", ""))
    body = F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "")
    records = raw.filter(F.trim("record") != "")
    return records.select(F.substring_index(header, " ", 1).alias("id"), header.alias("description"), body.alias("seq"), "file", "pos")


def write_fasta(df: DataFrame, path: str, header: str = "name", seq: str = "seq") -> None:
    """One record per row."""
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq))).write.text(path)
