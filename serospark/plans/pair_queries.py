"""Queries over pairs: every stretch of a document with the one after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from serospark.functions import pairs as P
from serospark.functions import sites as X
from serospark.functions.constants import AMINO_ACIDS, EPITOPES, GROUPINGS, KEY_SITES, SCALES
from serospark.operators import metrics as M
from serospark.operators import normalise as N
from serospark.operators import pairs as PO
from serospark.operators import sequences as S
from serospark.plans import adapters as A
from serospark.plans import oracles as O
from serospark.plans.registry import query
from serospark.session import cut_lineage

# Sites inside the 64-letter stretches; the published lists start beyond them.
SHORT_KEY_SITES = [5, 15, 16, 18, 19, 49, 53, 145]
SHORT_REGIONS = {"A": [1, 3, 7, 10], "B": [15, 46, 47, 48], "C": [52, 53, 54, 275], "D": [21, 27, 37, 60], "E": [22, 26]}
WEIGHTS = {"hydrophobicity": 0.4, "volume": 0.3, "charge": 0.2, "polarity": 0.1}
WEIGHT_SQL = "weights(prop, w) AS (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in WEIGHTS.items()) + ")"


def pairs(spark, sf_dir) -> DataFrame:
    return PO.labelled_pairs(A.distances(spark, sf_dir), A.sequences(spark, sf_dir), order="pos")


def array_sum(values) -> Column:
    return F.round(X.array_total(F.col(values) if isinstance(values, str) else values), 6)


@query("labelled_pairs", f"WITH {O.PAIRS} SELECT a, b, seq_a, seq_b, dist FROM pairs")
def labelled_pairs(spark, sf_dir) -> DataFrame:
    return pairs(spark, sf_dir).select("a", "b", "seq_a", "seq_b", "dist")


@query("attach_distance", f"WITH {O.PAIRS} SELECT a, b, dist FROM pairs")
def attach_distance(spark, sf_dir) -> DataFrame:
    far = cut_lineage(A.distances(spark, sf_dir), "distances")
    return PO.attach_distance(far.select("a", "b"), far).select("a", "b", "dist")


@query("binary_diff_sites", f"WITH {O.PAIRS}, {O.SITES} SELECT a, b, string_agg(CASE WHEN x <> y THEN '1' ELSE '0' END, '' ORDER BY site) AS diff, count(*) FILTER (WHERE x <> y) AS n_mutations FROM sites GROUP BY a, b")
def binary_diff_sites(spark, sf_dir) -> DataFrame:
    out = PO.difference_features(pairs(spark, sf_dir))
    return out.select("a", "b", F.array_join(F.col("diff").cast("array<string>"), "").alias("diff"), F.col("n_mutations").cast("bigint").alias("n_mutations"))


@query("hamming_pairs", f"WITH {O.PAIRS} SELECT a, b, CAST(hamming(seq_a, seq_b) AS BIGINT) AS n_mutations FROM pairs")
def hamming_pairs(spark, sf_dir) -> DataFrame:
    return PO.difference_features(pairs(spark, sf_dir)).select("a", "b", F.col("n_mutations").cast("bigint").alias("n_mutations"))


SCALE_SQL = "scales(prop, aa, v) AS (VALUES " + ", ".join(
    f"('{name}', '{aa}', CAST({float(v)!r} AS DOUBLE))" for name, values in SCALES.items() for aa, v in zip(AMINO_ACIDS, values)) + ")"
ZSCALE_SQL = f"{SCALE_SQL}, zs AS (SELECT prop, aa, (v - avg(v) OVER (PARTITION BY prop)) / stddev_pop(v) OVER (PARTITION BY prop) AS v FROM scales)"
# Twenty letters x twenty letters per scale.
DIFF_SQL = f"{ZSCALE_SQL}, dif AS (SELECT p.prop, p.aa AS x, q.aa AS y, abs(p.v - q.v) AS d FROM zs p JOIN zs q USING (prop))"
# How often two residues meet at a site, over all pairs.
MEETINGS_SQL = f"{O.SITES}, meet AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS n FROM sites WHERE strpos('{AMINO_ACIDS}', x) > 0 AND strpos('{AMINO_ACIDS}', y) > 0 GROUP BY x, y)"


def standard_scales(spark) -> DataFrame:
    return N.zscore_vals(N.scale_rows(SCALES, spark))


def scalar_weights(spark) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "prop_name string, weight double")


def meetings(spark, sf_dir) -> DataFrame:
    """A residue matrix from the data: how often two letters face each other, as one 400-cell row."""
    counted = PO.code_meetings(PO.encode_pairs(pairs(spark, sf_dir))).select("x", "y", F.col("n").cast("double").alias("value"))
    letters = F.lit(list(AMINO_ACIDS))
    long = counted.select(F.lit("meetings").alias("prop"), F.lit(0).cast("bigint").alias("ord"),
                          F.element_at(letters, F.col("x") + 1).alias("aa_i"), F.element_at(letters, F.col("y") + 1).alias("aa_j"), "value")
    return N.long_to_cells(long)


@query("property_diff", f"""WITH {O.PAIRS}, {O.SITES}, {DIFF_SQL}
SELECT a, b, prop, round(coalesce(sum(d), 0), 6) AS total FROM sites CROSS JOIN (SELECT DISTINCT prop FROM scales) LEFT JOIN dif USING (prop, x, y) GROUP BY a, b, prop""")
def property_diff(spark, sf_dir) -> DataFrame:
    props = N.difference_cells(standard_scales(spark))
    tensor = PO.tensor_features(pairs(spark, sf_dir), N.table_set(props), "x")
    names = F.lit(list(SCALES))
    sums = tensor.select("a", "b", X.array_totals(F.col("x")).alias("v"))
    return sums.select("a", "b", F.posexplode_outer("v").alias("p", "v")).select("a", "b", F.element_at(names, F.col("p") + 1).alias("prop"), F.round("v", 6).alias("total"))


@query("weighted_property_diff", f"""WITH {O.PAIRS}, {O.SITES}, {DIFF_SQL}, {WEIGHT_SQL},
wd AS (SELECT x, y, sum(w * d) AS d FROM dif JOIN weights USING (prop) GROUP BY x, y)
SELECT a, b, round(coalesce(sum(d), 0), 6) AS total, round(coalesce(sum(site * d), 0), 6) AS moment FROM sites LEFT JOIN wd USING (x, y) GROUP BY a, b""")
def weighted_property_diff(spark, sf_dir) -> DataFrame:
    table = N.weighted_table(N.difference_cells(standard_scales(spark)), scalar_weights(spark))
    out = PO.table_features(pairs(spark, sf_dir), table, "x1")
    return out.select("a", "b", array_sum("x1").alias("total"), F.round(X.array_total(F.col("x1"), by_place=True), 6).alias("moment"))


@query("matrix_lookup", f"""WITH {O.PAIRS}, {MEETINGS_SQL}, span AS (SELECT max(n) - min(n) AS s FROM (SELECT coalesce(n, 0) AS n FROM (SELECT p.aa AS x, q.aa AS y FROM (SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS aa) p, (SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS aa) q) LEFT JOIN meet USING (x, y)))
SELECT a, b, round(coalesce(sum(n / s), 0), 6) AS total FROM sites LEFT JOIN meet USING (x, y), span GROUP BY a, b""")
def matrix_lookup(spark, sf_dir) -> DataFrame:
    table = N.table_set(N.range_scale_cells(meetings(spark, sf_dir)))
    out = PO.table_features(pairs(spark, sf_dir), table[0], "x2")
    return out.select("a", "b", array_sum("x2").alias("total"))


@query("similarity_to_distance", f"""WITH {O.PAIRS}, {MEETINGS_SQL}, grid AS (SELECT p.aa AS x, q.aa AS y FROM (SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS aa) p, (SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS aa) q),
full_meet AS (SELECT x, y, coalesce(n, 0) AS n FROM grid LEFT JOIN meet USING (x, y)),
diag AS (SELECT x AS aa, n FROM full_meet WHERE x = y)
SELECT x AS aa_i, y AS aa_j, p.n + q.n - 2 * m.n AS value FROM full_meet m JOIN diag p ON p.aa = x JOIN diag q ON q.aa = y""")
def similarity_to_distance(spark, sf_dir) -> DataFrame:
    return N.cells_to_long(N.similarity_to_distance(meetings(spark, sf_dir))).select("aa_i", "aa_j", "value")


@query("substitution_features", f"""WITH {O.PAIRS}, {O.SITES}, {DIFF_SQL}
SELECT a, b, count(d) AS n_known, CAST(count(*) - count(d) AS BIGINT) AS n_unknown, round(sum(d), 6) AS total
FROM sites LEFT JOIN (SELECT x, y, d FROM dif WHERE prop = 'volume') USING (x, y) GROUP BY a, b""")
def substitution_features(spark, sf_dir) -> DataFrame:
    """Per-site distance with null for unknown letters."""
    volume = N.difference_cells(standard_scales(spark).filter("prop = 'volume'"))
    out = PO.table_features(pairs(spark, sf_dir), N.table_set(volume)[0], "x", unknown_is_null=True)
    known = F.filter("x", lambda v: v.isNotNull())
    return out.select("a", "b", F.size(known).cast("bigint").alias("n_known"), (F.size("x") - F.size(known)).cast("bigint").alias("n_unknown"),
                      F.when(F.size(known) > 0, array_sum(known)).alias("total"))


def _flag(sites) -> str:
    return "CAST((" + " OR ".join(f"(length(seq_a) >= {s} AND substr(seq_a, {s}, 1) <> substr(seq_b, {s}, 1))" for s in sites) + ") AS INTEGER)"


def _motifs(col: str) -> str:
    return f"list_filter(range(1, 63), lambda i: regexp_full_match(substr({col}, CAST(i AS INTEGER), 3), 'N[^P][ST]'))"


@query("mutation_features", f"""WITH {O.PAIRS}, {O.SITES}, {SCALE_SQL},
ranked AS (SELECT a, b, k.prop, abs(coalesce(p.v, 0) - coalesce(q.v, 0)) AS d,
    row_number() OVER (PARTITION BY a, b, k.prop ORDER BY abs(coalesce(p.v, 0) - coalesce(q.v, 0)) DESC) AS rn
  FROM sites CROSS JOIN (SELECT DISTINCT prop FROM scales) k LEFT JOIN scales p ON p.prop = k.prop AND p.aa = x LEFT JOIN scales q ON q.prop = k.prop AND q.aa = y WHERE x <> y),
tops AS (SELECT a, b, {', '.join(f"avg(d) FILTER (WHERE prop = '{s}') AS {s}" for s in SCALES)} FROM ranked WHERE rn <= 3 GROUP BY a, b)
SELECT pairs.a, pairs.b, CAST(hamming(seq_a, seq_b) AS INTEGER) AS n_mutations,
  CAST({_motifs('seq_a')} <> {_motifs('seq_b')} AS INTEGER) AS glycosylation_changed, {_flag(SHORT_KEY_SITES)} AS key_site_changed,
  {', '.join(f"{_flag(s)} AS epitope_{n}_changed" for n, s in SHORT_REGIONS.items())},
  {', '.join(f"round(coalesce({s}, 0), 6) AS {s}_diff" for s in SCALES)}
FROM pairs LEFT JOIN tops ON tops.a = pairs.a AND tops.b = pairs.b""")
def mutation_features(spark, sf_dir) -> DataFrame:
    out = PO.mutation_features(pairs(spark, sf_dir), SHORT_KEY_SITES, SHORT_REGIONS)
    flags = [c for c in PO.SUMMARY_FEATURES if not c.endswith("_diff")]
    return out.select("a", "b", *flags, *[F.round(f"{s}_diff", 6).alias(f"{s}_diff") for s in SCALES])


@query("published_sites", f"""WITH {O.PAIRS} SELECT a, b, {_flag(KEY_SITES)} AS key_site_changed, {', '.join(f"{_flag(s)} AS epitope_{n}_changed" for n, s in EPITOPES.items())} FROM pairs""")
def published_sites(spark, sf_dir) -> DataFrame:
    """The published site lists on short stretches: only three sites of one region lie inside them."""
    out = pairs(spark, sf_dir)
    flags = {f"epitope_{n}_changed": c for n, c in P.epitope_changed(F.col("seq_a"), F.col("seq_b")).items()}
    return out.select("a", "b", P.key_site_changed(F.col("seq_a"), F.col("seq_b")).alias("key_site_changed"), *[c.alias(n) for n, c in flags.items()])


LONG_PAIRS = f"""{O.long_stretches(O.PAIRS)},
ha1 AS (SELECT a, b, substr(seq_a, 17, 329) AS seq_a, substr(seq_b, 17, 329) AS seq_b FROM pairs)"""


@query("published_sites_long", f"""WITH {LONG_PAIRS}
SELECT a, b, {_flag(KEY_SITES)} AS key_site_changed, {', '.join(f"{_flag(s)} AS epitope_{n}_changed" for n, s in EPITOPES.items())} FROM ha1""")
def published_sites_long(spark, sf_dir) -> DataFrame:
    """All published sites, on the HA1 slice of stretches of 361 letters."""
    far = A.distances(spark, sf_dir, A.LONG_WINDOW).select("a", "b", "dist")
    out = PO.labelled_pairs(far, S.ha1_region(A.sequences(spark, sf_dir, A.LONG_WINDOW)), order="pos")
    flags = {f"epitope_{n}_changed": c for n, c in P.epitope_changed(F.col("seq_a"), F.col("seq_b")).items()}
    return out.select("a", "b", P.key_site_changed(F.col("seq_a"), F.col("seq_b")).alias("key_site_changed"), *[c.alias(n) for n, c in flags.items()])


TWO_MATRICES = {"polarity": 0.7, "volume": 0.3}


@query("weighted_matrices", f"""WITH {O.PAIRS}, {O.SITES}, {DIFF_SQL},
ranges AS (SELECT prop, max(d) - min(d) AS s FROM dif GROUP BY prop),
wm AS (SELECT x, y, sum(CASE prop {' '.join(f"WHEN '{k}' THEN {w}e0" for k, w in TWO_MATRICES.items())} END * d / s) AS d
  FROM dif JOIN ranges USING (prop) WHERE prop IN ({', '.join(f"'{k}'" for k in TWO_MATRICES)}) GROUP BY x, y)
SELECT a, b, round(coalesce(sum(d), 0), 6) AS total FROM sites LEFT JOIN wm USING (x, y) GROUP BY a, b""")
def weighted_matrices(spark, sf_dir) -> DataFrame:
    """Two range-scaled matrices, weighted and collapsed to one table."""
    cells = N.difference_cells(standard_scales(spark)).filter(F.col("prop").isin(list(TWO_MATRICES)))
    weights = spark.createDataFrame(list(TWO_MATRICES.items()), "prop_name string, weight double")
    out = PO.table_features(pairs(spark, sf_dir), N.weighted_table(N.range_scale_cells(cells), weights), "x2")
    return out.select("a", "b", array_sum("x2").alias("total"))


def _class_sql(grouping: int, col: str) -> str:
    return "CASE " + " ".join(f"WHEN strpos('{letters}', {col}) > 0 THEN {i}" for i, letters in enumerate(GROUPINGS[grouping])) + " ELSE 9 END"


@query("group_diff", f"WITH {O.PAIRS}, {O.SITES} SELECT a, b, " + ", ".join(
    f"count(*) FILTER (WHERE {_class_sql(g, 'x')} <> {_class_sql(g, 'y')}) AS g{g}" for g in GROUPINGS) + " FROM sites GROUP BY a, b")
def group_diff(spark, sf_dir) -> DataFrame:
    out = pairs(spark, sf_dir)
    for g in GROUPINGS:
        out = PO.grouping_features(out, g, f"d{g}")
    return out.select("a", "b", *[F.aggregate(f"d{g}", F.lit(0).cast("bigint"), lambda s, x: s + x).alias(f"g{g}") for g in GROUPINGS])


@query("combined_features", f"""WITH {O.PAIRS}, {O.SITES}, {DIFF_SQL}, {WEIGHT_SQL},
wd AS (SELECT x, y, sum(w * d) AS d FROM dif JOIN weights USING (prop) GROUP BY x, y),
ms AS (SELECT x, y, d / (SELECT max(d) - min(d) FROM dif WHERE prop = 'polarity') AS d FROM dif WHERE prop = 'polarity'),
c AS (SELECT '{AMINO_ACIDS}' AS alphabet)
SELECT a, b, CAST(192 AS INTEGER) AS n_features, CAST(count(*) FILTER (WHERE strpos(alphabet, x) <> strpos(alphabet, y)) AS DOUBLE) AS x0,
  round(coalesce(sum(wd.d), 0), 6) AS x1, round(coalesce(sum(ms.d), 0), 6) AS x2 FROM sites LEFT JOIN wd USING (x, y) LEFT JOIN ms USING (x, y), c GROUP BY a, b""")
def combined_features(spark, sf_dir) -> DataFrame:
    cells = N.difference_cells(standard_scales(spark))
    scalar = N.weighted_table(cells, scalar_weights(spark))
    matrix = N.table_set(N.range_scale_cells(cells.filter("prop = 'polarity'")))[0]
    out = PO.combined_features(pairs(spark, sf_dir), scalar, matrix)
    return out.select("a", "b", F.size("features").alias("n_features"), array_sum("x0").alias("x0"), array_sum("x1").alias("x1"), array_sum("x2").alias("x2"))


@query("top_n_slice", f"""WITH {O.PAIRS}, {O.SITES}, {DIFF_SQL}, {WEIGHT_SQL}, best AS (SELECT prop, w FROM weights ORDER BY w DESC, prop LIMIT 2)
SELECT a, b, round(coalesce(sum(w * d), 0), 6) AS total FROM sites LEFT JOIN (SELECT x, y, w, d FROM dif JOIN best USING (prop)) USING (x, y) GROUP BY a, b""")
def top_n_slice(spark, sf_dir) -> DataFrame:
    """The two heaviest properties only, taken before any pair is touched."""
    best = N.top_n(scalar_weights(spark), 2)
    table = N.weighted_table(N.difference_cells(standard_scales(spark)), best)
    out = PO.table_features(pairs(spark, sf_dir), table, "x")
    return out.select("a", "b", array_sum("x").alias("total"))


HASH = O.unit_hash("a || '|' || b")
FOLD_HASH = O.unit_hash("a || '|' || b || '|fold'")


@query("split_pairs", f"WITH {O.PAIRS} SELECT a, b, {HASH} < 0.2 AS is_test FROM pairs")
def split_pairs(spark, sf_dir) -> DataFrame:
    return PO.split_pairs(A.distances(spark, sf_dir)).select("a", "b", "is_test")


@query("split_exact", f"""WITH {O.PAIRS}, r AS (SELECT a, b, row_number() OVER (ORDER BY {HASH}, a, b) AS rn, count(*) OVER () AS n FROM pairs)
SELECT a, b, rn <= floor(0.2 * n) AS is_test FROM r""")
def split_exact(spark, sf_dir) -> DataFrame:
    return PO.split_exact(A.distances(spark, sf_dir)).select("a", "b", "is_test")


@query("validation_split", f"""WITH {O.PAIRS}, t AS (SELECT a, b FROM pairs WHERE NOT ({HASH} < 0.2)),
r AS (SELECT a, b, row_number() OVER (ORDER BY {O.unit_hash("a || '|' || b", 7)}, a, b) AS rn, count(*) OVER () AS n FROM t)
SELECT a, b, rn <= greatest(1, floor(0.1 * n)) AS is_validation FROM r""")
def validation_split(spark, sf_dir) -> DataFrame:
    train = PO.split_pairs(A.distances(spark, sf_dir)).filter("NOT is_test")
    return PO.validation_split(train).select("a", "b", "is_validation")


@query("split_names", f"""WITH {O.PAIRS}, s AS (SELECT a, b, {O.unit_hash('a')} < 0.2 AS ta, {O.unit_hash('b')} < 0.2 AS tb FROM pairs)
SELECT a, b, CASE WHEN ta AND tb THEN 'test' WHEN ta OR tb THEN 'mixed' ELSE 'train' END AS part FROM s""")
def split_names(spark, sf_dir) -> DataFrame:
    return PO.split_pairs_by_name(A.distances(spark, sf_dir)).select("a", "b", "part")


@query("kfold", f"WITH {O.PAIRS} SELECT a, b, CAST(floor({FOLD_HASH} * 10) AS INTEGER) AS fold FROM pairs")
def kfold(spark, sf_dir) -> DataFrame:
    return PO.kfold(A.distances(spark, sf_dir)).select("a", "b", "fold")


@query("euclidean_pairs", f"WITH {O.POINTS} SELECT a, b, round({O.L2}, 6) AS dist FROM steps")
def euclidean_pairs(spark, sf_dir) -> DataFrame:
    out = PO.pair_distances(A.point_pairs(spark, sf_dir), A.points(spark, sf_dir))
    return out.select("a", "b", F.round("dist", 6).alias("dist"))


PREDICTED = "SELECT a, b, dist * 0.5 AS prediction FROM pairs WHERE " + HASH + " < 0.2"


@query("patch_distances", f"""WITH {O.PAIRS}, pred AS ({PREDICTED}), both_ways AS (SELECT a, b, dist FROM pairs UNION ALL SELECT b, a, dist FROM pairs),
pp AS (SELECT a, b, prediction FROM pred UNION ALL SELECT b, a, prediction FROM pred)
SELECT a, b, dist, coalesce(prediction, dist) AS patched FROM both_ways LEFT JOIN pp USING (a, b) WHERE a IN (SELECT a FROM pp) AND b IN (SELECT a FROM pp)""")
def patch_distances(spark, sf_dir) -> DataFrame:
    far = cut_lineage(A.distances(spark, sf_dir), "distances")
    predicted = PO.split_pairs(far).filter("is_test").select("a", "b", (F.col("dist") * 0.5).alias("prediction"))
    return PO.patch_distances(PO.both_directions(far), predicted).select("a", "b", "dist", "patched")


@query("distance_scores", f"""WITH {O.POINTS}, t AS (SELECT *, {O.L2} AS truth FROM steps),
s AS (SELECT truth AS t, {O.L2.replace("CAST(p[i] AS DOUBLE)", "(CAST(p[i] AS DOUBLE) * 0.9 + 0.01 * i)").replace("CAST(q[i] AS DOUBLE)", "(CAST(q[i] AS DOUBLE) * 0.9 + 0.01 * i)")} AS p FROM t WHERE a < b)
SELECT count(*) AS n, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(avg(abs(t - p)), 6) AS mae,
  round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2, round(covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p)), 6) AS pearson FROM s""")
def distance_scores(spark, sf_dir) -> DataFrame:
    pts = A.points(spark, sf_dir)
    truth = PO.pair_distances(A.point_pairs(spark, sf_dir), pts)
    moved = pts.withColumn("point", F.transform("point", lambda v, i: v * 0.9 + 0.01 * (i + 1)))
    scores = M.distance_scores(moved, truth)
    return scores.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2", "pearson")])
