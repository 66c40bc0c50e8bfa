"""Queries over property tables, scaling, imputing and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from serospark.functions import sites as X
from serospark.functions.constants import AMINO_ACIDS, SCALES
from serospark.operators import metrics as M
from serospark.operators import normalise as N
from serospark.operators import pairs as PO
from serospark.plans import adapters as A
from serospark.plans import oracles as O
from serospark.plans.pair_queries import HASH, pairs
from serospark.plans.registry import query

LETTERS = f"(SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS aa, unnest(range(0, 20)) AS i)"


@query("zscore_by", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) / stddev_pop(p_retailprice) OVER (PARTITION BY p_brand), 6) AS zscore FROM part")
def zscore_by(spark, sf_dir) -> DataFrame:
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return N.zscore_by(part, ["p_brand"], "p_retailprice").select("p_partkey", F.round("zscore", 6).alias("zscore"))


@query("range_scale_by", "SELECT p_partkey, round(p_retailprice / (max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand)), 6) AS scaled FROM part")
def range_scale_by(spark, sf_dir) -> DataFrame:
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return N.range_scale_by(part, ["p_brand"], "p_retailprice").select("p_partkey", F.round("scaled", 6).alias("scaled"))


# One property per brand: mean price of its parts, by size class (twenty classes as letters).
PROPS_SQL = f"""props AS (SELECT p_brand AS prop, CAST(substr(p_brand, 7) AS BIGINT) AS ord, i, aa, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT p_brand FROM part), {LETTERS} l LEFT JOIN (SELECT p_brand AS pb, p_size % 20 AS c, avg(p_retailprice) AS v FROM part GROUP BY 1, 2) ON pb = p_brand AND c = i)"""


def brand_props(spark, sf_dir) -> DataFrame:
    means = A.table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 20).alias("c")).agg(F.avg("p_retailprice").alias("v"))
    by_class = means.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
    vals = F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)) for i in range(20)])
    return by_class.select(F.col("p_brand").alias("prop"), F.substring("p_brand", 7, 9).cast("bigint").alias("ord"), vals.alias("vals"))


@query("zscore_props", f"WITH {PROPS_SQL} SELECT prop, aa, round((v - avg(v) OVER (PARTITION BY prop)) / stddev_pop(v) OVER (PARTITION BY prop), 6) AS value FROM props")
def zscore_props(spark, sf_dir) -> DataFrame:
    long = N.vals_to_long(N.zscore_vals(brand_props(spark, sf_dir)))
    return long.select("prop", "aa", F.round("value", 6).alias("value"))


@query("drop_correlated", f"""WITH RECURSIVE {PROPS_SQL}, c AS (SELECT p.ord AS i, q.ord AS j, corr(p.v, q.v) AS r FROM props p JOIN props q ON p.aa = q.aa AND p.ord < q.ord GROUP BY p.ord, q.ord),
o AS (SELECT ord, row_number() OVER (ORDER BY ord) AS n FROM (SELECT DISTINCT ord FROM props)),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT g.n + 1, CASE WHEN bool_or(abs(c.r) > 0.25) THEN g.kept ELSE list_append(g.kept, o.ord) END
  FROM g JOIN o ON o.n = g.n + 1 LEFT JOIN c ON c.j = o.ord AND list_contains(g.kept, c.i) GROUP BY g.n, g.kept, o.ord)
SELECT DISTINCT prop FROM props JOIN (SELECT unnest(kept) AS ord FROM g WHERE n = (SELECT max(n) FROM g)) USING (ord)""")
def drop_correlated(spark, sf_dir) -> DataFrame:
    return N.drop_correlated(brand_props(spark, sf_dir), 0.25, block=8).select("prop")


# One matrix per line number from supplier and part classes; three of them with an even diagonal.
MATS_SQL = f"""mats AS (SELECT 'M' || n AS prop, CAST(n AS BIGINT) AS ord, p.i AS i, q.i AS j, p.aa AS aa_i, q.aa AS aa_j,
    CASE WHEN n <= 3 AND p.i = q.i THEN 5.0 ELSE coalesce(c, 0.0) END AS value
  FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem), {LETTERS} p, {LETTERS} q
  LEFT JOIN (SELECT l_linenumber AS k, l_suppkey % 20 AS si, l_partkey % 20 AS pi, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2, 3) ON k = n AND si = p.i AND pi = q.i)"""


def line_matrices(spark, sf_dir) -> DataFrame:
    counts = A.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 20).cast("int").alias("i"), (F.col("l_partkey") % 20).cast("int").alias("j")
    ).agg(F.count(F.lit(1)).cast("double").alias("c"))
    found = counts.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * 20 + F.col("j")).alias("k"), "c"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.when((F.col("n") <= 3) & (k % 21 == 0), F.lit(5.0)).otherwise(
        F.coalesce(F.try_element_at("m", k), F.lit(0.0))))
    return found.select(F.concat(F.lit("M"), F.col("n").cast("string")).alias("prop"), F.col("n").cast("bigint").alias("ord"), cells.alias("cells"))


@query("constant_diagonal", f"""WITH {MATS_SQL}, d AS (SELECT prop, min(value) AS v FROM mats WHERE i = j GROUP BY prop HAVING min(value) = max(value))
SELECT prop, aa_i, aa_j, value - v AS value FROM mats JOIN d USING (prop)""")
def constant_diagonal(spark, sf_dir) -> DataFrame:
    return N.cells_to_long(N.constant_diagonal(line_matrices(spark, sf_dir))).select("prop", "aa_i", "aa_j", "value")


@query("range_scaled_matrices", f"WITH {MATS_SQL} SELECT prop, aa_i, aa_j, round(value / (max(value) OVER (PARTITION BY prop) - min(value) OVER (PARTITION BY prop)), 6) AS value FROM mats")
def range_scaled_matrices(spark, sf_dir) -> DataFrame:
    long = N.cells_to_long(N.range_scale_cells(line_matrices(spark, sf_dir)))
    return long.select("prop", "aa_i", "aa_j", F.round("value", 6).alias("value"))


@query("symmetrise", f"""WITH {MATS_SQL} SELECT prop, aa_i, aa_j, value FROM mats WHERE i >= j
UNION ALL SELECT prop, aa_j, aa_i, value FROM mats WHERE i > j""")
def symmetrise(spark, sf_dir) -> DataFrame:
    long = N.cells_to_long(line_matrices(spark, sf_dir))
    place = lambda c: F.instr(F.lit(AMINO_ACIDS), F.col(c))
    return N.symmetrise(long.filter(place("aa_i") >= place("aa_j"))).select("prop", "aa_i", "aa_j", "value")


@query("target_scaler", f"""WITH {O.PAIRS}, train AS (SELECT avg(dist) AS m, stddev_pop(dist) AS s FROM pairs WHERE NOT ({HASH} < 0.2))
SELECT a, b, round((dist - m) / s, 6) AS dist FROM pairs, train""")
def target_scaler(spark, sf_dir) -> DataFrame:
    far = PO.split_pairs(A.distances(spark, sf_dir))
    scaler = N.fit_target_scaler(far.filter("NOT is_test"))
    return N.apply_target_scaler(far, scaler).select("a", "b", F.round("dist", 6).alias("dist"))


@query("standard_scaler", """WITH c AS (SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS site, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, site, round((v - avg(v) OVER (PARTITION BY site)) / stddev_pop(v) OVER (PARTITION BY site), 5) AS value FROM c""")
def standard_scaler(spark, sf_dir) -> DataFrame:
    pts = A.points(spark, sf_dir)
    scaled = N.apply_standard_scaler(pts, N.fit_standard_scaler(pts, "point"), "point")
    return scaled.select("vec_id", F.posexplode("point").alias("site", "value")).withColumn("value", F.round("value", 5))


# Volume difference per site, unknown where a letter is.
VOL_SQL = f"""{O.SITES}, {O.scale_values('vol', SCALES['volume'])}, {O.scale_values('pol', SCALES['polarity'])},
vp AS (SELECT a, b, site, abs(p.v - q.v) AS v, abs(r.v - s.v) AS z FROM sites LEFT JOIN vol p ON p.aa = x LEFT JOIN vol q ON q.aa = y LEFT JOIN pol r ON r.aa = x LEFT JOIN pol s ON s.aa = y),
mn AS (SELECT site, avg(v) AS mv, avg(z) AS mz FROM vp GROUP BY site),
im AS (SELECT a, b, site, coalesce(v, mv) AS v, coalesce(z, mz) AS z FROM vp JOIN mn USING (site))"""


def _two_blocks(spark, sf_dir) -> DataFrame:
    cells = N.table_set(N.difference_cells(N.scale_rows({k: SCALES[k] for k in ("volume", "polarity")}, spark)))
    out = PO.table_features(pairs(spark, sf_dir), cells[0], "v", unknown_is_null=True)
    return PO.table_features(out, cells[1], "z", unknown_is_null=True).select("a", "b", "dist", "v", "z")


@query("mean_impute", f"WITH {O.PAIRS}, {VOL_SQL} SELECT a, b, round(sum(v), 5) AS total FROM im GROUP BY a, b")
def mean_impute(spark, sf_dir) -> DataFrame:
    filled = N.mean_impute(_two_blocks(spark, sf_dir), "v")
    return filled.select("a", "b", F.round(X.array_total(F.col("v")), 5).alias("total"))


@query("residualise", f"""WITH {O.PAIRS}, {VOL_SQL}, fit AS (SELECT site, coalesce(regr_slope(z, v), 0) AS k, coalesce(regr_intercept(z, v), avg(z)) AS c FROM im GROUP BY site)
SELECT a, b, round(sum(abs(z - (k * v + c))), 4) AS total FROM im JOIN fit USING (site) GROUP BY a, b""")
def residualise(spark, sf_dir) -> DataFrame:
    blocks = _two_blocks(spark, sf_dir)
    filled = N.mean_impute(N.mean_impute(blocks, "v"), "z")
    out = N.residualise(filled, "v", "z", "r")
    return out.select("a", "b", F.round(X.array_total(F.col("r"), absolute=True), 4).alias("total"))


@query("residual_fit", """SELECT CAST(l_linenumber AS BIGINT) AS site, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_linenumber""")
def residual_fit(spark, sf_dir) -> DataFrame:
    """Per line number as site: the arrays hold one value in that place and none elsewhere."""
    item = A.table(spark, sf_dir, "lineitem")
    def spread(col):
        return F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when(i == F.col("l_linenumber"), F.col(col)))
    fit = N.residual_fit(item.select(spread("l_quantity").alias("x"), spread("l_extendedprice").alias("y")), "x", "y")
    return fit.select((F.col("site") + 1).cast("bigint").alias("site"), F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


LOGITS_SQL = """prop_logits AS (SELECT l_returnflag AS head, p_brand AS prop_name, avg(l_quantity) AS logit FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
head_logits AS (SELECT l_returnflag AS head, avg(l_discount) AS logit FROM lineitem GROUP BY 1),
sm AS (SELECT head, prop_name, exp(logit) / sum(exp(logit)) OVER (PARTITION BY head) AS w FROM prop_logits),
hs AS (SELECT head, exp(logit) / sum(exp(logit)) OVER () AS h FROM head_logits),
fused AS (SELECT prop_name, sum(w * h) AS weight FROM sm JOIN hs USING (head) GROUP BY prop_name)"""


def fused_weights(spark, sf_dir) -> DataFrame:
    item = A.table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_discount")
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("prop_name"))
    props = item.join(part, "l_partkey").groupBy(F.col("l_returnflag").alias("head"), "prop_name").agg(F.avg("l_quantity").alias("logit"))
    heads = item.groupBy(F.col("l_returnflag").alias("head")).agg(F.avg("l_discount").alias("logit"))
    return N.fuse_weights(heads, props)


@query("fuse_weights", f"WITH {LOGITS_SQL} SELECT prop_name, round(weight, 6) AS weight FROM fused")
def fuse_weights(spark, sf_dir) -> DataFrame:
    return fused_weights(spark, sf_dir).select("prop_name", F.round("weight", 6).alias("weight"))


@query("top_n", f"WITH {LOGITS_SQL} SELECT prop_name, round(weight, 6) AS weight FROM fused ORDER BY fused.weight DESC, prop_name LIMIT 5")
def top_n(spark, sf_dir) -> DataFrame:
    return N.top_n(fused_weights(spark, sf_dir), 5).select("prop_name", F.round("weight", 6).alias("weight"))


@query("select_by_names", f"WITH {LOGITS_SQL}, {PROPS_SQL}, best AS (SELECT prop_name, weight FROM fused ORDER BY weight DESC, prop_name LIMIT 5) SELECT prop, round(any_value(weight), 6) AS weight, round(sum(v), 4) AS total FROM props JOIN best ON prop = prop_name GROUP BY prop")
def select_by_names(spark, sf_dir) -> DataFrame:
    chosen = N.select_by_names(brand_props(spark, sf_dir), N.top_n(fused_weights(spark, sf_dir), 5))
    return chosen.select("prop", F.round("weight", 6).alias("weight"), F.round(F.aggregate("vals", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


SCORES = """count(*) AS n, round(sqrt(avg((t - p) * (t - p))), 4) AS rmse, round(avg(abs(t - p)), 4) AS mae,
  round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2, round(corr(t, p), 6) AS pearson"""


@query("regression_metrics", f"SELECT l_returnflag, l_linestatus, {SCORES} FROM (SELECT l_returnflag, l_linestatus, l_extendedprice AS t, l_quantity * 1000.0 * (1 - l_discount) AS p FROM lineitem) GROUP BY ALL")
def regression_metrics(spark, sf_dir) -> DataFrame:
    item = A.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("dist"), (F.col("l_quantity") * 1000.0 * (1 - F.col("l_discount"))).alias("prediction"))
    out = M.regression_metrics(item, by=["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("pearson", 6).alias("pearson"))


@query("feature_ablation", " UNION ALL ".join(
    f"SELECT '{name}' AS feature_set, {SCORES} FROM (SELECT l_extendedprice AS t, {expr} AS p FROM lineitem)"
    for name, expr in {"x0": "l_quantity * 1000.0", "x0,x1": "l_quantity * 1000.0 * (1 - l_discount)", "x0,x2": "l_quantity * 1000.0 * (1 + l_tax)", "x0,x1,x2": "l_quantity * 1000.0 * (1 - l_discount) * (1 + l_tax)"}.items()))
def feature_ablation(spark, sf_dir) -> DataFrame:
    item = A.table(spark, sf_dir, "lineitem").withColumn("dist", F.col("l_extendedprice"))
    base, less, more = F.col("l_quantity") * 1000.0, 1 - F.col("l_discount"), 1 + F.col("l_tax")
    sets = {"x0": base, "x0,x1": base * less, "x0,x2": base * more, "x0,x1,x2": base * less * more}
    out = M.feature_ablation(item, sets)
    return out.select("feature_set", "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("pearson", 6).alias("pearson"))
