from pyspark.sql import functions as F

from serospark.functions import residues as R
from serospark.operators import sequences as S

SCHEMA = "file string, pos int, name string, seq string"


def test_best_record_prefers_clean_then_long_then_first(spark, rows):
    df = spark.createDataFrame([
        ("f", 1, "n", "AAAAAA-"), ("f", 2, "n", "CCCC"), ("f", 3, "n", "GGGG"), ("f", 4, "n", "TTT"),
        ("f", 1, "m", "AAX"), ("f", 2, "m", "AAAX"), ("f", 3, "m", "AAA-"),
    ], SCHEMA)
    assert rows(S.best_record(df), "name", "seq") == [("m", "AAAX"), ("n", "CCCC")]


def test_fewest_gaps_first_wins(spark, rows):
    df = spark.createDataFrame([("f", 2, "n", "A-A"), ("f", 1, "n", "-CC"), ("f", 3, "n", "--A")], SCHEMA)
    assert rows(S.fewest_gaps(df), "name", "seq") == [("n", "-CC")]


def test_years(spark):
    df = spark.createDataFrame([("A/x/1/68",), ("A/x/1/2003",), ("A/x/103",), ("A/x",), ("A/x/1/20031",)], "n string")
    assert [r[0] for r in df.select(R.year_of(F.col("n"))).collect()] == [2068, 2003, 20103, None, None]


def test_representative_is_earliest_year_then_first(spark, rows):
    df = spark.createDataFrame([
        ("f", 1, "A/b/2005", "AAA"), ("f", 2, "A/a/2003", "AAA"), ("f", 3, "A/c/03", "AAA"), ("f", 4, "A/d/04", "CCC"), ("f", 5, "A/none", "CCC"),
    ], SCHEMA)
    assert rows(S.representative_map(df)) == [("A/a/2003", "A/a/2003"), ("A/b/2005", "A/a/2003"), ("A/c/03", "A/a/2003"), ("A/d/04", "A/d/04")]
    assert rows(S.representative_map(df, limit=3)) == rows(S.representative_map(df))
    assert rows(S.undated_names(df), "name") == [("A/none",)]


def test_repeated_name_takes_its_last_sequence(spark, rows):
    df = spark.createDataFrame([("f", 1, "A/a/03", "AAA"), ("f", 2, "A/a/03", "CCC"), ("f", 3, "A/b/02", "CCC")], SCHEMA)
    assert rows(S.representative_map(df)) == [("A/a/03", "A/b/02"), ("A/b/02", "A/b/02")]


def test_region_gaps_and_dedupe(spark, rows):
    df = spark.createDataFrame([("f", 2, "b", "XXAACC"), ("f", 1, "a", "YYAACC"), ("f", 3, "c", "XXA-CC")], SCHEMA)
    cut = S.ha1_region(df, 2, 6)
    assert rows(S.gap_report(cut)) == [(2, 1)]
    assert rows(S.dedupe_sequences(S.drop_gapped(cut)), "name", "seq") == [("a", "AACC")]


def test_motif_sites_overlap(spark):
    df = spark.createDataFrame([("NNSTNPSANGT",), ("NN",), ("NPS",), ("",)], "s string")
    assert [r[0] for r in df.select(R.glycosylation_sites(F.col("s"))).collect()] == [[1, 2, 9], [], [], []]


def test_variable_sites_ignore_gaps(spark, rows):
    df = spark.createDataFrame([("f", 1, "a", "AC-G"), ("f", 2, "b", "AT-G"), ("f", 3, "c", "A-GX")], SCHEMA)
    assert rows(S.variable_sites(df)) == [(1, 2), (3, 2)]
    assert rows(S.project_variable_sites(df), "name", "seq") == [("a", "CG"), ("b", "TG"), ("c", "-X")]


def test_headers_and_codes(spark):
    df = spark.createDataFrame([("id1 A/HK/1/68 more",), ("id2 A/HK 1/68",), ("id3 A/HK",)], "h string")
    assert [r[0] for r in df.select(R.name_from_space_header(F.col("h"))).collect()] == ["A/HK/1/68", "A/HK 1/68", "A/HK"]
    row = spark.createDataFrame([(" A/x/1 | z", "AV-X")], "h string, s string").select(R.name_from_pipe_header(F.col("h")), R.encode_residues(F.col("s"))).first()
    assert row[0] == "A/x/1" and row[1] == [0, 19, -1, -1]


def test_common_and_short_names(spark, rows):
    seqs = spark.createDataFrame([("f", 1, "a", "A"), ("f", 2, "z", "A")], SCHEMA)
    far = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 1.0)], "a string, b string, dist double")
    kept, cut = S.common_names(seqs, far)
    assert rows(kept, "name") == [("a",)] and rows(cut) == [("a", "a", 0.0)]
    names = spark.createDataFrame([("a", "A1")], "full_name string, short_name string")
    assert rows(S.short_names(seqs, names), "name", "short_name") == [("a", "A1"), ("z", None)]
