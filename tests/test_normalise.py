import numpy as np
import pytest
from pyspark.sql import functions as F

from serospark.functions.constants import AMINO_ACIDS
from serospark.operators import metrics as M
from serospark.operators import normalise as N


def props(spark, vectors):
    return spark.createDataFrame([(f"p{i}", i, [float(x) for x in v]) for i, v in enumerate(vectors)], "prop string, ord bigint, vals array<double>")


def test_zscore_and_constant(spark):
    rng = np.random.default_rng(0)
    v = rng.random(20)
    got = [r["vals"] for r in N.zscore_vals(props(spark, [v, np.ones(20)])).orderBy("ord").collect()]
    assert np.allclose(got[0], (v - v.mean()) / v.std())
    assert got[1] == [None] * 20


def test_range_scale_has_no_shift(spark):
    cells = np.arange(400.0) + 5
    df = spark.createDataFrame([("a", 0, cells.tolist()), ("b", 1, [2.0] * 400)], "prop string, ord bigint, cells array<double>")
    a, b = N.table_set(N.range_scale_cells(df))
    assert np.allclose(a, cells / 399) and not b.any()


def test_constant_diagonal_and_distance(spark):
    rng = np.random.default_rng(1)
    even, odd = rng.random((20, 20)), rng.random((20, 20))
    np.fill_diagonal(even, 0.5)
    df = spark.createDataFrame([("even", 0, even.ravel().tolist()), ("odd", 1, odd.ravel().tolist())], "prop string, ord bigint, cells array<double>")
    kept = N.constant_diagonal(df)
    assert [r["prop"] for r in kept.collect()] == ["even"]
    assert np.allclose(N.table_set(kept)[0].reshape(20, 20), even - 0.5)
    d = N.table_set(N.similarity_to_distance(df))[1].reshape(20, 20)
    assert np.allclose(d, np.diag(odd)[:, None] + np.diag(odd)[None, :] - 2 * odd)
    assert np.allclose(N.table_set(N.long_to_cells(N.cells_to_long(df))), N.table_set(df))


def greedy(vectors, threshold):
    with np.errstate(invalid="ignore"):
        corr = np.corrcoef(vectors)
    keep, removed = [], set()
    for i in range(len(vectors)):
        if i not in removed:
            keep.append(i)
            removed |= {j for j in range(i + 1, len(vectors)) if abs(corr[i, j]) > threshold}
    return [f"p{i}" for i in keep]


@pytest.mark.parametrize("block", [1, 4, 100])
def test_drop_correlated_is_the_greedy_choice(spark, rows, block):
    rng = np.random.default_rng(2)
    vectors = rng.random((17, 20))
    vectors[5] = vectors[2] * 3 + 1
    vectors[7] = 4.0
    vectors[9] = -vectors[0]
    want = greedy(vectors, 0.3)
    assert 3 < len(want) < 17
    assert rows(N.drop_correlated(props(spark, vectors), 0.3, block), "prop") == sorted((w,) for w in want)


def test_impute_drops_empty_sites_and_fits_elsewhere(spark, rows):
    df = spark.createDataFrame([([1.0, None, None],), ([3.0, 4.0, None],)], "x array<double>")
    assert rows(N.mean_impute(df, "x")) == [([1.0, 4.0],), ([3.0, 4.0],)]
    other = spark.createDataFrame([([None, None, 7.0],)], "x array<double>")
    assert rows(N.mean_impute(other, "x", df)) == [([2.0, 4.0],)]


def test_residuals(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((50, 3)), rng.random((50, 3))
    x[:, 1] = 2.0
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, x array<double>, y array<double>")
    got = np.array([r["r"] for r in N.residualise(df, "x", "y", "r").orderBy("i").collect()])
    for s in (0, 2):
        k, c = np.polyfit(x[:, s], y[:, s], 1)
        assert np.allclose(got[:, s], y[:, s] - k * x[:, s] - c)
    assert np.allclose(got[:, 1], y[:, 1] - y[:, 1].mean())


def test_fused_weights_sum_to_one(spark):
    heads = spark.createDataFrame([(0, 500.0), (1, 501.0)], "head int, logit double")
    logits = spark.createDataFrame([(h, f"p{p}", 300.0 * p + h) for h in range(2) for p in range(4)], "head int, prop_name string, logit double")
    got = N.fuse_weights(heads, logits).collect()
    assert sum(r["weight"] for r in got) == pytest.approx(1.0)
    assert [r["weight"] for r in got] == sorted((r["weight"] for r in got), reverse=True)
    assert [r["prop_name"] for r in N.top_n(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "prop_name string, weight double"), 2).collect()] == ["a", "b"]


def test_scalers_round_trip(spark, rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "dist double")
    s = N.fit_target_scaler(df)
    assert s["mean"] == 3.0 and s["std"] == pytest.approx(np.std([1, 2, 6]))
    assert [r[0] for r in N.invert_target_scaler(N.apply_target_scaler(df, s), s, "dist").collect()] == pytest.approx([1, 2, 6])
    v = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    assert rows(N.apply_standard_scaler(v, N.fit_standard_scaler(v, "x"), "x")) == [([-1.0, 0.0],), ([1.0, 0.0],)]


def test_scores(spark):
    rng = np.random.default_rng(4)
    t, p = rng.random(40), rng.random(40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)], "dist double, prediction double")
    row = M.regression_metrics(df).first()
    assert row["rmse"] == pytest.approx(np.sqrt(((t - p) ** 2).mean()))
    assert row["mae"] == pytest.approx(np.abs(t - p).mean())
    assert row["r2"] == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert row["pearson"] == pytest.approx(np.corrcoef(t, p)[0, 1])
    flat = M.regression_metrics(df.withColumn("dist", F.lit(1.0))).first()
    assert flat["r2"] is None and flat["pearson"] is None


def test_symmetrise(spark, rows):
    low = spark.createDataFrame([("m", 0, "A", "A", 1.0), ("m", 0, "R", "A", 2.0)], "prop string, ord bigint, aa_i string, aa_j string, value double")
    assert rows(N.symmetrise(low), "aa_i", "aa_j", "value") == [("A", "A", 1.0), ("A", "R", 2.0), ("R", "A", 2.0)]
    assert len(AMINO_ACIDS) == 20
