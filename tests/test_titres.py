import random

import pytest
from pyspark.sql import functions as F

from serospark.functions import titres as FT
from serospark.operators import graph as G
from serospark.operators import titres as T

MIXES = {
    "numbers": (["40", "80"], "60"),
    "fraction": (["10", "20", "20"], "16"),
    "stars": (["*", "*"], "*"),
    "bounds": (["<80", "<40"], "<40"),
    "bound and star": (["<80", "*", "<40"], "<40"),
    "number and star": (["160", "*"], "160"),
    "number and bound": (["160", "<40"], "160"),
    "all three": (["160", "<40", "*", "80"], "120"),
    "loose bound with number": (["160", "<40x"], "160"),
}
ILLEGAL = {"decimal": ["160.0", "160"], "text": ["abc"], "null": [None, "40"], "loose bound": ["<40x", "<40"], "empty": [""]}


def assay(spark):
    data = [(f"{i:02d} a", f"{i:02d} b", t) for i, (ts, _) in enumerate(MIXES.values()) for t in ts]
    data += [(f"bad {k}", "z", t) for k, ts in ILLEGAL.items() for t in ts]
    return spark.createDataFrame(data, "test string, ref string, titre string")


def test_truth_table(spark, rows):
    got = rows(T.censored_mean(T.canonical_pair(assay(spark))), "titre")
    assert got == sorted((want,) for _, want in MIXES.values())


def test_illegal_groups_are_quarantined(spark, rows):
    bad = rows(T.quarantine(T.canonical_pair(assay(spark))), "virus_1")
    assert bad == sorted((f"bad {k}",) for k in ILLEGAL)


def test_order_and_partitions_do_not_matter(spark, rows):
    data = assay(spark).collect()
    want = rows(T.merge_reports(assay(spark)))
    for parts in (1, 7):
        random.Random(parts).shuffle(data)
        assert rows(T.merge_reports(spark.createDataFrame(data, assay(spark).schema).repartition(parts))) == want


def test_pairs_are_stripped_and_unordered(spark, rows):
    df = spark.createDataFrame([(" b ", "a", "40"), ("a", "b", "80"), ("a", "a", "10")], "test string, ref string, titre string")
    merged = T.merge_reports(df)
    assert rows(merged, "virus_1", "virus_2", "titre") == [("a", "a", "10"), ("a", "b", "60")]
    assert rows(T.drop_self_pairs(merged), "virus_1", "virus_2") == [("a", "b")]


def test_truncation_can_be_left_out(spark):
    df = spark.createDataFrame([("a", "b", "40"), ("a", "b", "45")], "test string, ref string, titre string")
    assert T.merge_reports(df).first()["titre"] == "42"
    assert T.merge_reports(df, truncate=False).first()["titre"] == "42.5"


def test_titre_value(spark):
    df = spark.createDataFrame([("<40",), ("*",), ("80",), ("12.5",)], "t string")
    assert [r[0] for r in df.select(FT.titre_value(F.col("t"))).collect()] == [20.0, None, 80.0, 12.5]


def test_collapse_averages_again_and_drops_self_pairs(spark, rows):
    pairs = spark.createDataFrame([("a", "c", "40"), ("b", "c", "80"), ("a", "b", "10"), ("a", "x", "10")], "virus_1 string, virus_2 string, titre string")
    names = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "name string, representative string")
    assert rows(T.collapse_to_representatives(pairs, names), "virus_1", "virus_2", "titre") == [("a", "c", "60")]


def test_column_basis(spark, rows):
    df = spark.createDataFrame([("a", "s", "40"), ("b", "s", "160"), ("c", "s", "<20"), ("d", "s", "*")], "test string, ref string, titre string")
    got = rows(T.column_basis_distance(df), "test", "distance", "censored")
    assert got == [("a", 2.0, False), ("b", 0.0, False), ("c", 3.0, True)]
    assert rows(T.column_basis_distance(df, limit=3), "test", "distance", "censored") == got


def test_matrix_fills_gaps_and_rejects_duplicates(spark, rows):
    df = spark.createDataFrame([("a", "x.1", "40"), ("b", "y", "<40")], "virus_1 string, virus_2 string, titre string")
    assert rows(T.to_matrix(df)) == [("a", "40", "*"), ("b", "*", "<40")]
    assert T.duplicate_cells(df.union(df)).count() == 2
    with pytest.raises(Exception, match="duplicate matrix cell"):
        T.to_matrix(df.union(df)).collect()


def brute_prune(cells, least):
    while True:
        n_rows, n_cols = {}, {}
        for (r, c), t in cells.items():
            n_rows[r] = n_rows.get(r, 0) + t.isdigit()
            n_cols[c] = n_cols.get(c, 0) + t.isdigit()
        kept = {k: t for k, t in cells.items() if n_rows[k[0]] >= least and n_cols[k[1]] >= least}
        if kept == cells:
            return kept
        cells = kept


def test_prune_cascades(spark, rows):
    rng = random.Random(33)  # takes eight rounds
    cells = {(f"r{i}", f"c{j}"): rng.choice(["40", "80", "160", "*", "<40"]) for i in range(14) for j in range(14) if rng.random() < 0.58}
    df = spark.createDataFrame([(r, c, t) for (r, c), t in cells.items()], "virus_1 string, virus_2 string, titre string")
    want = brute_prune(cells, 4)
    assert len(want) == 28 < len(cells)
    pruned = G.prune_sparse(df)
    assert rows(pruned) == sorted((r, c, t) for (r, c), t in want.items())
    assert rows(G.prune_sparse(pruned, limit=3)) == rows(pruned)


@pytest.mark.parametrize("length", [2, 30])
def test_prune_follows_chains(spark, rows, length):
    """Each removal takes the next key below the bound; a block of full rows and columns stays. Every cell sends at most two decrements."""
    chain = [(f"r{i}", f"c{i}", "40") for i in range(length)] + [(f"r{i + 1}", f"c{i}", "40") for i in range(length)]
    block = [(f"R{i}", f"C{j}", "40") for i in range(2) for j in range(2)]
    df = spark.createDataFrame(chain + block, "virus_1 string, virus_2 string, titre string")
    assert rows(G.prune_sparse(df, min_valid=2, buckets=4)) == sorted(block)
    joined = []
    plain = G.sliced_join
    try:
        G.sliced_join = lambda *a: joined.append(plain(*a).persist()) or joined[-1]
        G.prune_sparse(df, min_valid=2, buckets=4).count()
        assert len(joined) > length and sum(j.count() for j in joined) <= 2 * len(chain)
    finally:
        G.sliced_join = plain


def test_few_removed_keys_are_sent_to_the_cells(spark, rows, monkeypatch):
    """Rounds that remove few keys shuffle no ends of cells; those that remove more slice hot keys as before."""
    cells = [(f"r{i}", f"c{j}", "40") for i in range(6) for j in range(6)] + [("x", "c0", "40"), ("x", "y", "40"), ("z", "y", "80")]
    df = spark.createDataFrame(cells, "virus_1 string, virus_2 string, titre string")
    plans, plain = [], G.sliced_join

    def watched(*a):
        out = plain(*a)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(G, "sliced_join", watched)
    want = sorted(cells[:36])
    assert rows(G.prune_sparse(df)) == want
    assert plans and all("strategy=broadcast" in p and "_slice" not in p for p in plans)
    plans.clear()
    assert rows(G.prune_sparse(df, sent_keys=0)) == want
    assert plans and all("_slice" in p for p in plans)


def test_tasks_hand_on_stars(spark):
    """Within a task all edges become one star a component; portions of few nodes lose no link."""
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    df = spark.createDataFrame(edges, "u long, v long").coalesce(1)
    roots = list(range(300))
    for u, v in edges:
        a, b = sorted((roots[u], roots[v]))
        roots = [a if r == b else r for r in roots]
    stars = {r["u"]: r["v"] for r in df.mapInArrow(G._forest(), "u long, v long").collect()}
    assert stars == {n: r for n, r in enumerate(roots) if n != r and any(n in e for e in edges)}
    some = [(r["u"], r["v"]) for r in df.mapInArrow(G._forest(20), "u long, v long").collect()]
    again = list(range(300))
    for u, v in some:
        a, b = sorted((again[u], again[v]))
        again = [a if r == b else r for r in again]
    assert again == roots


def test_components_of_paths_and_hubs(spark, rows):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    hub = [("hub", f"h{i:03d}") for i in range(50)]
    loop = [("self", "self"), ("y", "x"), ("x", "y")]
    edges = spark.createDataFrame(path + hub + loop, "a string, b string")
    for limit in (1, 5):
        got = dict(rows(G.connected_components(edges, limit=limit)))
        assert {got[f"p{i:03d}"] for i in range(61)} == {"p000"}
        assert {got[f"h{i:03d}"] for i in range(50)} | {got["hub"]} == {"h000"}
        assert got["self"] == "self" and got["x"] == got["y"] == "x"


def test_equal_components_settle_by_name(spark, rows):
    cells = spark.createDataFrame([("c", "d", "40"), ("a", "b", "40"), ("e", "a", "*")], "virus_1 string, virus_2 string, titre string")
    assert rows(G.largest_component(cells)) == [("a", "b", "40")]


def test_names_are_stripped_of_all_white_space(spark, rows):
    df = spark.createDataFrame([("\tb\u00a0", " a\n", "40 "), ("b", "a", "\u200380")], "test string, ref string, titre string")
    merged = T.merge_reports(df)
    assert rows(merged, "virus_1", "virus_2", "titre") == [("a", "b", "60")]
