"""Product codes: nearest entries and whole fits against plain numpy, and the edges."""

import numpy as np
import pytest

from serospark.llm import vectorcodes


@pytest.mark.parametrize("entries, size, spread", [(64, 4, 30), (64, 4, 2), (1, 3, 5), (7, 2, 5000), (64, 1, 10)])
def test_nearest_is_exact(entries, size, spread):
    rng = np.random.default_rng(entries + size)
    book, parts = rng.integers(-spread, spread + 1, (entries, size)), rng.integers(-4 * spread, 4 * spread + 1, (3000, size))
    apart = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    index, distance = vectorcodes.Slices(book).nearest(parts)
    assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_masks_hold_the_box():
    rng = np.random.default_rng(1)
    book, parts = rng.integers(-20, 21, (64, 3)), rng.integers(-30, 31, (500, 3))
    radius = rng.integers(0, 25, 500)
    inside = (np.abs(parts[:, None] - book[None]) <= radius[:, None, None]).all(axis=2)
    masks = vectorcodes.Slices(book).inside(parts, radius)
    assert masks.tolist() == [sum(1 << int(e) for e in np.flatnonzero(row)) for row in inside]


def plain_fit(vectors, parts, entries, rounds):
    whole = np.floor(256 * np.asarray(vectors, np.float64)).astype(np.int64).reshape(len(vectors), parts, -1)
    book = whole[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        apart = ((whole[:, :, None] - book[None]) ** 2).sum(axis=3)
        code = apart.argmin(axis=2)
        for p in range(parts if turn < rounds else 0):
            for e in range(book.shape[1]):
                own = whole[code[:, p] == e, p]
                if len(own):
                    book[p, e] = own.sum(axis=0) // len(own)
    return code.tolist(), apart.min(axis=2).sum(axis=1).tolist(), book


def test_fit_against_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.3, (400, 12)).astype(np.float32).tolist()
    vectors[100:300] = [vectors[100]] * 200  # a hot vector
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    data = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<float>, label int").repartition(7)
    coded = vectorcodes.encode(data, parts=3, entries=20, rounds=2)
    codes, errors, book = plain_fit(vectors, 3, 20, 2)
    found = {r["id"]: (list(r["codes"]), r["error"]) for r in coded.rows.collect()}
    assert found == {i: (c, e) for i, (c, e) in enumerate(zip(codes, errors))} and (coded.codebooks == book).all()


def test_edges(spark):
    kind = "vec_id long, embedding array<double>, label int, id string, codes int, v int, error string"
    one, nan, inf = [0.5, -0.5], float("nan"), float("inf")
    rows = [(1, one, 1), (1, one, 1), (None, [1.0, 2.0], None), (2, None, 1), (3, [], 1), (4, [nan, 0.0], 1), (5, [None, 0.0], 1), (6, [inf, 0.0], 1), (7, [0.1], 1)]
    data = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], kind)
    coded = vectorcodes.encode(data, parts=2)
    found = sorted((str(r["id"]), str(r["label"]), list(r["codes"]), r["error"]) for r in coded.rows.collect())
    assert found == [("1", "1", [0, 0], 0), ("1", "1", [0, 0], 0), ("None", "None", [2, 2], 0)]
    assert coded.codebooks.tolist() == [[[128], [128], [256]], [[-128], [-128], [512]]]
    assert vectorcodes.encode(data.limit(0)).rows.collect() == []
    with pytest.raises(ValueError):
        vectorcodes.encode(data, parts=3)
    with pytest.raises(Exception, match="components must stay within"):
        vectorcodes.encode(spark.createDataFrame([(1, [1e9], 1)], "vec_id long, embedding array<double>, label int"), parts=1).rows.collect()
