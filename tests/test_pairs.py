import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from serospark.functions.constants import AMINO_ACIDS, GROUPINGS, SCALES
from serospark.operators import normalise as N
from serospark.operators import pairs as PO
from serospark.plans import skew

PAIRS = [
    ("a", "b", 1.0, "ARNDCQEG", "ARNDCQEG"),  # none
    ("a", "c", 2.0, "ARNDCQEG", "VRNDCQEG"),  # one
    ("a", "d", 3.0, "ARNDCQEG", "VWNDCQEG"),  # two
    ("a", "e", 4.0, "ARNDCQEG", "VWYDCQEG"),  # three
    ("a", "f", 5.0, "ARNDCQEG", "VWYT-QE-"),  # six, two of them gaps
    ("b", "c", 6.0, "NNSTXQEG", "NPST-QEG"),  # motif changes; two unknown letters differ
]


def frame(spark):
    return spark.createDataFrame(PAIRS, "a string, b string, dist double, seq_a string, seq_b string")


def brute_top(x, y, scale, k=3):
    value = dict(zip(AMINO_ACIDS, scale))
    gaps = sorted((abs(value.get(p, 0) - value.get(q, 0)) for p, q in zip(x, y) if p != q), reverse=True)[:k]
    return sum(gaps) / len(gaps) if gaps else 0.0


def test_mutation_features(spark):
    out = PO.mutation_features(frame(spark), key_sites=[1, 99], regions={"A": [2], "B": [3, 5]}).orderBy("a", "b").collect()
    for row, (_, _, _, x, y) in zip(out, PAIRS):
        assert row["n_mutations"] == sum(p != q for p, q in zip(x, y))
        assert row["key_site_changed"] == int(x[0] != y[0])
        assert row["epitope_A_changed"] == int(x[1] != y[1])
        assert row["epitope_B_changed"] == int(x[2] != y[2] or x[4] != y[4])
        for name, scale in SCALES.items():
            assert row[f"{name}_diff"] == pytest.approx(brute_top(x, y, scale))
    assert [r["glycosylation_changed"] for r in out] == [0, 0, 0, 0, 0, 1]


def test_group_classes(spark):
    for g, classes in GROUPINGS.items():
        of = {aa: i for i, letters in enumerate(classes) for aa in letters}
        got = PO.grouping_features(frame(spark), g).orderBy("a", "b").collect()
        for row, (_, _, _, x, y) in zip(got, PAIRS):
            assert row["group_diff"] == [int(of.get(p, -1) != of.get(q, -1)) for p, q in zip(x, y)]


def test_table_lookups(spark):
    rng = np.random.default_rng(1)
    tables = rng.random((3, 400))
    df = PO.tensor_features(PO.table_features(PO.table_features(frame(spark), tables[0], "t"), tables[0], "u", unknown_is_null=True), tables, "x")
    for row, (_, _, _, x, y) in zip(df.orderBy("a", "b").collect(), PAIRS):
        for site, (p, q) in enumerate(zip(x, y)):
            i, j = AMINO_ACIDS.find(p), AMINO_ACIDS.find(q)
            for t in range(3):
                want = tables[t][20 * i + j] if i >= 0 and j >= 0 else 0.0
                assert row["x"][t][site] == pytest.approx(want)
            assert row["t"][site] == pytest.approx(row["x"][0][site])
            assert (row["u"][site] is None) == (i < 0 or j < 0)


def test_lengths_may_vary_between_pairs_but_not_within(spark):
    df = spark.createDataFrame([("AR", "AN"), ("", ""), ("ARN", "ARD")], "seq_a string, seq_b string").coalesce(1)
    assert [r["diff"] for r in PO.difference_features(df).collect()] == [[0, 1], [], [0, 0, 1]]
    bad = spark.createDataFrame([("AR", "A")], "seq_a string, seq_b string")
    with pytest.raises(Exception, match="differ in length"):
        PO.difference_features(bad).collect()


def test_weighted_tables_equal_weighted_sums(spark):
    props = N.zscore_vals(N.scale_rows(SCALES, spark))
    cells = N.difference_cells(props)
    weights = spark.createDataFrame([("volume", 0.7), ("charge", 0.3), ("absent", 9.0)], "prop_name string, weight double")
    one = PO.table_features(frame(spark), N.weighted_table(cells, weights), "w").orderBy("a", "b").collect()
    each = PO.tensor_features(frame(spark), N.table_set(cells), "x").orderBy("a", "b").collect()
    names = list(SCALES)
    for r, s in zip(one, each):
        want = 0.7 * np.array(s["x"][names.index("volume")]) + 0.3 * np.array(s["x"][names.index("charge")])
        assert np.allclose(r["w"], want)


def test_combined_features_concatenate(spark):
    table = [float(i) for i in range(400)]
    row = PO.combined_features(frame(spark), table, table).filter("a = 'b'").first()
    assert len(row["features"]) == 24
    assert row["x0"] == [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]  # X against a gap is no difference here
    assert row["features"] == row["x0"] + row["x1"] + row["x2"]


def test_labelled_pairs_keep_one_direction(spark, rows):
    seqs = spark.createDataFrame([("a", "AR", 2), ("b", "AN", 1), ("c", "AD", 3)], "name string, seq string, pos int")
    far = spark.createDataFrame([(x, y, 1.0) for x, y in itertools.product("abz", repeat=2)], "a string, b string, dist double")
    assert rows(PO.labelled_pairs(far, seqs), "a", "b", "seq_a", "seq_b") == [("a", "b", "AR", "AN")]
    assert rows(PO.labelled_pairs(far, seqs, order="pos"), "a", "b", "seq_a", "seq_b") == [("b", "a", "AN", "AR")]


def test_exact_split_has_the_exact_size(spark):
    df = spark.createDataFrame([(f"n{i}", f"m{i}") for i in range(1003)], "a string, b string")
    for frac in (0.0, 0.2, 0.999, 1.0):
        out = PO.split_exact(df, frac)
        assert out.count() == 1003 and out.filter("is_test").count() == int(frac * 1003)
    assert PO.validation_split(df.limit(3)).filter("is_validation").count() == 1
    hashed = PO.split_pairs(df)
    assert 120 < hashed.filter("is_test").count() < 280
    assert [r["fold"] for r in PO.kfold(df, 10).select("fold").distinct().orderBy("fold").collect()] == list(range(10))


def test_split_by_name_shares_no_name(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(30) for j in range(i)], "a string, b string")
    parts = {p: set() for p in ("train", "test")}
    for r in PO.split_pairs_by_name(df, 0.4).filter("part <> 'mixed'").collect():
        parts[r["part"]] |= {r["a"], r["b"]}
    assert parts["train"] and parts["test"] and not parts["train"] & parts["test"]


def test_patch_goes_both_ways(spark, rows):
    far = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 0.0), ("a", "z", 5.0)], "a string, b string, dist double")
    predicted = spark.createDataFrame([("b", "a", 9.0)], "a string, b string, prediction double")
    assert rows(PO.patch_distances(far, predicted), "a", "b", "patched") == [("a", "a", 0.0), ("a", "b", 9.0), ("b", "a", 9.0)]


def test_point_distances(spark, rows):
    points = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0])], "name string, point array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "b"), ("a", "q")], "a string, b string")
    assert rows(PO.pair_distances(pairs, points)) == [("a", "b", 5.0), ("b", "b", 0.0)]


def test_site_counts(spark):
    counts = PO.site_cell_counts(frame(spark).repartition(3), 8)
    assert counts.sum() == 8 * len(PAIRS)
    assert counts[0, 0 * 21 + 19] == 4  # A facing V at the first site


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_a_join(spark, rows, how):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice(["hot"] * 6 + ["x", "y", None]), i) for i in range(400)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("x", 2)], "k string, w int")
    want = rows(left.join(right, "k", how), "k", "v", "w")
    salted = skew.lookup(left, right, "k", how, limit=20)
    assert rows(salted, "k", "v", "w") == want


def test_lookup_spreads_any_number_of_hot_keys(spark):
    """A key with a third of the rows, half of them equal, and 5,000 smaller ones: no partition holds much more than its share."""
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"), F.when(F.col("id") % 6 > 0, F.col("id")).alias("id")).repartition(64)
    right = spark.range(-1, 5000).select(F.col("id").alias("k"), F.lit(1).alias("w")).hint("merge")
    plain = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        joined = skew.lookup(left, right, "k", limit=500)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 16


def test_lookup_copies_only_for_hot_keys(spark):
    """The right row of a cold key stands once; a hot key's stands once for every ``limit`` rows."""
    left = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(0)).otherwise(F.col("id")).alias("k"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    hot = {r["k"]: r["_slices"] for r in skew.hot_keys(counts, ["k"], 100).collect()}
    assert hot == {0: 4}
    assert skew.lookup(left, left.distinct().withColumn("w", F.lit(1)), "k", limit=100).count() == 1000


def test_ids_follow_the_order_of_names(spark):
    names = spark.createDataFrame([(f"n{i * 7919 % 1000:04d}",) for i in range(1500)], "name string")
    for ids, label in ((skew.ordered_ids(names), "id"), (skew.dense_ids(names, "k"), "k")):
        found = [r["name"] for r in ids.orderBy(label).collect()]
        assert found == sorted(found) and len(found) == 1000
    assert sorted(r["k"] for r in skew.dense_ids(names, "k").collect()) == list(range(1000))


def test_crowded_keys_are_the_hot_keys_of_a_table(spark, rows):
    names = [("x",)] * 30 + [("y",)] * 12 + [(None,)] * 50 + [(f"k{i}",) for i in range(200)]
    df = spark.createDataFrame(names, "a string")
    counts = df.dropna().groupBy("a").count().withColumnRenamed("count", "_n")
    assert rows(skew.crowded_keys(df, "a", 11)) == rows(skew.hot_keys(counts, ["a"], 11)) == [("x", 3), ("y", 2)]
    assert skew.crowded_keys(df, "a", 30) is None
    assert skew.crowded_keys(df.limit(0), "a", 1) is None


def test_sequences_are_shuffled_once_for_both_ends(spark, rows):
    far = spark.createDataFrame([("p", "q", 1.0), ("q", "p", 1.0), ("p", None, 2.0), ("q", "z", 3.0)], "a string, b string, dist double")
    seqs = spark.createDataFrame([("p", "AC", 1), ("q", "AD", 2)], "name string, seq string, pos int")
    want = [("p", "q", 1.0, "AC", "AD")]
    assert rows(PO.labelled_pairs(far, seqs, "pos"), "a", "b", "dist", "seq_a", "seq_b") == want
    assert rows(PO.labelled_pairs(far, seqs, "pos", limit=1), "a", "b", "dist", "seq_a", "seq_b") == want
    plan = PO.labelled_pairs(far, seqs, "pos")._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" not in plan
