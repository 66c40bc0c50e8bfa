"""Stretches of a text and the edit distances of neighbours, against the engine's own functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from serospark.functions import sites as X
from serospark.operators import normalise as N
from serospark.operators import pairs as PO
from serospark.plans import adapters as A

TEXTS = ["", None, "a", "Bjouz zebra", "é😀x-y, " * 30, "the quick brown fox jumps over the lazy dog. " * 20, "abc" * 64, "q" * 64, "12 34"]


@pytest.mark.parametrize("width", [1, 5, 64, 65, 361])
def test_stretches_and_steps_equal_the_engines(spark, width):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    letters = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUZ", "-----")
    plain = F.regexp_extract_all(letters, F.lit(f".{{1,{width}}}"), F.lit(0))
    got = df.select("i", X.stretches(F.col("text"), width).alias("s"), plain.alias("t")).select("*", X.step_distances(F.col("s"), width).alias("d")).orderBy("i").collect()
    assert [r["s"] for r in got] == [r["t"] for r in got]
    steps = [(r["i"], n, x.ljust(width, "-"), y.ljust(width, "-")) for r in got for n, (x, y) in enumerate(zip((r["t"] or []), (r["t"] or [])[1:]))]
    if steps:
        far = spark.createDataFrame(steps, "i long, n int, x string, y string").select("i", "n", F.levenshtein("x", "y").alias("d")).collect()
        assert {(r["i"], n): d for r in got for n, d in enumerate(r["d"] or [])} == {(r["i"], r["n"]): r["d"] for r in far}
    assert [r["d"] for r in got if not r["t"]] == [None if r["t"] is None else [] for r in got if not r["t"]]


def test_steps_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 3)
    rng = np.random.default_rng(5)
    x, y = rng.choice(np.frombuffer(b"ACD-", np.uint8), (2, 40, 70))
    far = spark.createDataFrame([(i, bytes(a).decode(), bytes(b).decode()) for i, (a, b) in enumerate(zip(x, y))], "i int, x string, y string")
    assert X.edit_counts(x, y).tolist() == [r[0] for r in far.orderBy("i").select(F.levenshtein("x", "y")).collect()]


def test_no_text_is_cut_or_compared_by_interpreted_expressions(spark, tmp_path):
    spark.createDataFrame([(1, "en", "s", "abc " * 60)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    far = A.distances(spark, str(tmp_path))
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and "regexp" not in plan
    assert [(r["a"], r["b"]) for r in far.orderBy("a").collect()] == [("A/en/1-0/01", "A/en/1-1/01"), ("A/en/1-1/01", "A/en/1-2/01")]


def test_pairs_read_their_distances_from_files(spark):
    far = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, dist double").withColumn("dist", F.col("dist") + F.rand(1) * 0)
    seqs = spark.createDataFrame([("a", "AR", 0), ("b", "AN", 1)], "name string, seq string, pos int")
    out = PO.labelled_pairs(far, seqs, order="pos")
    assert "rand(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.select("a", "b", "dist", "seq_a", "seq_b").collect()] == [("a", "b", 1.0, "AR", "AN")]


def test_meetings_shuffle_counts_and_no_sites(spark):
    coded = PO.encode_pairs(spark.createDataFrame([("AR-", "ARX"), ("AA", "RA"), (None, "A")], "seq_a string, seq_b string"))
    out = PO.code_meetings(coded)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, 2), (0, 1, 1), (1, 1, 1)]
    longer = spark.createDataFrame([([0, 1, 2], [0, None])], "codes_a array<int>, codes_b array<int>")
    assert [tuple(r) for r in PO.code_meetings(longer).collect()] == [(0, 0, 1)]


def test_imputing_and_residuals_of_ragged_arrays(spark):
    rows = [([1.0, None, 3.0], [1.0, 2.0]), ([None, None, 5.0, None], [None, 1.0, 2.0, 3.0]), (None, [1.0]), ([], []), ([2.0, None, 4.0], [4.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>").coalesce(1)
    filled, left = N.mean_impute(df, "x"), N.residualise(df, "x", "y", "r")
    for out in (filled, left):
        assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["x"] for r in filled.collect()] == [[1.0, 3.0], [1.5, 5.0], None, [], [2.0, 4.0]]
    assert [r["r"] for r in left.collect()] == [[0.0, None, None], [None, None, 0.0, None], None, [], [0.0, None, 0.0]]


def test_totals(spark):
    df = spark.createDataFrame([([1.0, -2.0, 4.0],), ([],), (None,), ([1.0, None],)], "v array<double>").coalesce(1)
    got = df.select(X.array_total(F.col("v")), X.array_total(F.col("v"), by_place=True), X.array_total(F.col("v"), absolute=True)).collect()
    assert [tuple(r) for r in got] == [(3.0, 6.0, 7.0), (0.0, 0.0, 0.0), (None, None, None), (None, None, None)]
    nested = spark.createDataFrame([([[1.0, 2.0], [], [3.0]],), ([],), (None,)], "v array<array<double>>").coalesce(1)
    assert [r[0] for r in nested.select(X.array_totals(F.col("v"))).collect()] == [[3.0, 0.0, 3.0], [], None]
