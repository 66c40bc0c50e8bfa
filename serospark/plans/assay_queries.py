"""Queries over assay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from serospark.operators import graph as G
from serospark.operators import titres as T
from serospark.plans import adapters as A
from serospark.plans import oracles as O
from serospark.plans.registry import query

MERGED = f"WITH RECURSIVE {O.ASSAY}, {O.kinds('assay')}, {O.SUMMARY}"


@query("censored_pair_titre", f"""{MERGED}
SELECT virus_1, virus_2, n_rows, n_numeric, n_below, n_missing, kind, titre FROM merged WHERE virus_1 <> virus_2""")
def censored_pair_titre(spark, sf_dir) -> DataFrame:
    merged = T.drop_self_pairs(T.merge_reports(A.assay(spark, sf_dir)))
    return merged.select("virus_1", "virus_2", "n_rows", "n_numeric", "n_below", "n_missing", "kind", "titre")


@query("merged_reports", f"{MERGED} SELECT virus_1, virus_2, kind, titre FROM merged")
def merged_reports(spark, sf_dir) -> DataFrame:
    return T.merge_reports(A.assay(spark, sf_dir)).select("virus_1", "virus_2", "kind", "titre")


@query("directed_pair_titre", f"""WITH {O.ASSAY}, {O.kinds('assay').replace('least(test, ref)', 'test').replace('greatest(test, ref)', 'ref')}, {O.SUMMARY}
SELECT virus_1, virus_2, kind, titre FROM merged""")
def directed_pair_titre(spark, sf_dir) -> DataFrame:
    pairs = T.canonical_pair(A.assay(spark, sf_dir), directed=True)
    return T.censored_mean(pairs).select("virus_1", "virus_2", "kind", "titre")


@query("titre_quarantine", f"{MERGED} SELECT virus_1, virus_2, n_rows FROM summary WHERE n_illegal > 0")
def titre_quarantine(spark, sf_dir) -> DataFrame:
    return T.quarantine(T.canonical_pair(A.assay(spark, sf_dir))).select("virus_1", "virus_2", "n_rows")


@query("titre_kinds", f"WITH {O.ASSAY}, {O.kinds('assay')} SELECT report, k AS kind, count(*) AS n FROM (SELECT k, report FROM (SELECT *, CASE WHEN regexp_full_match(titre, '[0-9]+') THEN 'number' WHEN titre = '*' THEN 'missing' WHEN regexp_matches(titre, '^<[0-9]') THEN 'below' ELSE 'illegal' END AS k FROM assay)) GROUP BY report, k")
def titre_kinds(spark, sf_dir) -> DataFrame:
    from serospark.functions.titres import titre_kind

    return A.assay(spark, sf_dir).groupBy("report", titre_kind(F.col("titre")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("collapsed_titres", f"""{MERGED},
m AS (SELECT 'A/' || s_suppkey AS name, 'A/' || s_nationkey AS rep FROM supplier),
mapped AS (SELECT x.rep AS test, y.rep AS ref, titre FROM merged JOIN m x ON virus_1 = x.name JOIN m y ON virus_2 = y.name),
{O.kinds('mapped').replace('kinds AS', 'kinds2 AS')},
{O.SUMMARY.replace('summary', 'summary2').replace('merged AS', 'merged2 AS').replace('FROM kinds', 'FROM kinds2')}
SELECT virus_1, virus_2, n_rows, kind, titre FROM merged2 WHERE virus_1 <> virus_2""")
def collapsed_titres(spark, sf_dir) -> DataFrame:
    name_map = A.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("A/"), F.col("s_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("A/"), F.col("s_nationkey").cast("string")).alias("representative"))
    collapsed = T.collapse_to_representatives(T.merge_reports(A.assay(spark, sf_dir)), name_map)
    return collapsed.select("virus_1", "virus_2", "n_rows", "kind", "titre")


VALUE = "CASE WHEN titre LIKE '%<%' THEN TRY_CAST(replace(titre, '<', '') AS DOUBLE) / 2 WHEN titre LIKE '%*%' THEN NULL ELSE TRY_CAST(titre AS DOUBLE) END"


@query("titre_log_distance", f"""WITH {O.ASSAY}
SELECT l_orderkey, l_linenumber, test, ref, round(max(log2({VALUE})) OVER () - log2({VALUE}), 6) AS distance FROM assay""")
def titre_log_distance(spark, sf_dir) -> DataFrame:
    far = T.titre_distance(A.assay(spark, sf_dir))
    return far.select("l_orderkey", "l_linenumber", "test", "ref", F.round("distance", 6).alias("distance"))


@query("column_basis_distance", f"""WITH {O.ASSAY}, cells AS (
  SELECT *, titre LIKE '<%' AS censored, log2(CAST(replace(titre, '<', '') AS DOUBLE) / 10) AS lt FROM assay
  WHERE regexp_full_match(titre, '<?[0-9]+'))
SELECT l_orderkey, l_linenumber, test, ref, censored, round(max(lt) OVER (PARTITION BY ref) - lt, 6) AS distance FROM cells""")
def column_basis_distance(spark, sf_dir) -> DataFrame:
    far = T.column_basis_distance(A.assay(spark, sf_dir))
    return far.select("l_orderkey", "l_linenumber", "test", "ref", "censored", F.round("distance", 6).alias("distance"))


@query("titre_matrix", f"""WITH {O.ASSAY}, {O.kinds("(SELECT test, l_returnflag AS ref, titre FROM assay JOIN lineitem USING (l_orderkey, l_linenumber))")
    .replace('least(test, ref)', 'test').replace('greatest(test, ref)', 'ref')
    .replace("(SELECT test, l_returnflag AS ref, titre FROM assay JOIN lineitem USING (l_orderkey, l_linenumber))", f"(SELECT 'A/' || l_suppkey AS test, 'S/' || l_returnflag AS ref, {O.TITRE} AS titre FROM lineitem)")}, {O.SUMMARY}
SELECT virus_1, coalesce(max(titre) FILTER (WHERE virus_2 = 'S/A'), '*') AS "S/A", coalesce(max(titre) FILTER (WHERE virus_2 = 'S/N'), '*') AS "S/N",
  coalesce(max(titre) FILTER (WHERE virus_2 = 'S/R'), '*') AS "S/R" FROM merged GROUP BY virus_1""")
def titre_matrix(spark, sf_dir) -> DataFrame:
    cells = A.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("A/"), F.col("l_suppkey").cast("string")).alias("test"),
        F.concat(F.lit("S/"), F.col("l_returnflag")).alias("ref"),
        A.titre_text().alias("titre"))
    return T.to_matrix(T.censored_mean(T.canonical_pair(cells, directed=True)))


@query("duplicate_cells", f"WITH {O.ASSAY} SELECT test, ref, count(*) AS n FROM assay GROUP BY test, ref HAVING count(*) > 1")
def duplicate_cells(spark, sf_dir) -> DataFrame:
    return T.duplicate_cells(A.assay(spark, sf_dir), "test", "ref")


@query("prune_sparse", f"""WITH RECURSIVE {O.SPARSE}, {O.kinds('sparse')}, {O.SUMMARY},
rounds AS (
  SELECT 0 AS n, virus_1, virus_2, titre, CAST(kind = 'number' AS INTEGER) AS num, false AS stop FROM merged
  UNION ALL
  SELECT n + 1, virus_1, virus_2, titre, num, total = count(*) OVER () AS stop FROM (
    SELECT *, sum(num) OVER (PARTITION BY virus_1) AS ra, sum(num) OVER (PARTITION BY virus_2) AS rb, count(*) OVER () AS total
    FROM rounds WHERE NOT stop) WHERE ra >= 4 AND rb >= 4)
SELECT virus_1, virus_2, titre FROM rounds WHERE stop""")
def prune_sparse(spark, sf_dir) -> DataFrame:
    merged = T.merge_reports(A.sparse_assay(spark, sf_dir)).select("virus_1", "virus_2", "titre")
    return G.prune_sparse(merged)


# Min-label rounds; twelve are more than the depth of these graphs.
LABELS = f"""{O.MONTHLY}, {O.kinds('monthly')}, {O.SUMMARY},
links AS (SELECT virus_1 AS x, virus_2 AS y FROM merged WHERE kind = 'number' UNION SELECT virus_2, virus_1 FROM merged WHERE kind = 'number'),
labels AS (
  SELECT 0 AS n, x AS name, x AS component FROM (SELECT DISTINCT x FROM links)
  UNION ALL
  SELECT n + 1, name, component FROM (
    SELECT l.n, l.name, least(l.component, min(o.component)) AS component
    FROM labels l JOIN links ON links.x = l.name JOIN labels o ON o.name = links.y WHERE l.n < 12 GROUP BY l.n, l.name, l.component)),
comps AS (SELECT name, component FROM labels WHERE n = 12)"""


@query("connected_components", f"WITH RECURSIVE {LABELS} SELECT name, component FROM comps")
def connected_components(spark, sf_dir) -> DataFrame:
    merged = T.merge_reports(A.monthly_assay(spark, sf_dir))
    return G.connected_components(T.numeric_edges(merged))


@query("largest_component", f"""WITH RECURSIVE {LABELS},
best AS (SELECT component FROM comps GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
inside AS (SELECT name FROM comps JOIN best USING (component))
SELECT virus_1, virus_2, titre FROM merged WHERE virus_1 IN (SELECT name FROM inside) AND virus_2 IN (SELECT name FROM inside)""")
def largest_component(spark, sf_dir) -> DataFrame:
    merged = T.merge_reports(A.monthly_assay(spark, sf_dir)).select("virus_1", "virus_2", "titre")
    return G.largest_component(merged)


@query("turn_chains", """SELECT CAST(conv_id AS VARCHAR) || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS name,
  CAST(conv_id AS VARCHAR) || ':' || lpad(CAST(min(turn) OVER (PARTITION BY conv_id) AS VARCHAR), 6, '0') AS component FROM (SELECT DISTINCT conv_id, turn FROM conversations)
  QUALIFY count(*) OVER (PARTITION BY conv_id) > 1""")
def turn_chains(spark, sf_dir) -> DataFrame:
    """Components of long paths: each conversation turn linked to the one before it."""
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    def node(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.lpad(turn.cast("string"), 6, "0"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next"))
    edges = turns.join(following, ["conv_id", "turn"]).select(node(F.col("turn")).alias("a"), node(F.col("next")).alias("b"))
    return G.connected_components(edges)


@query("semi_filter_pairs", f"""{MERGED}, rich AS (SELECT 'A/' || s_suppkey AS name FROM supplier WHERE s_acctbal > 0)
SELECT virus_1, virus_2, titre FROM merged WHERE virus_1 IN (SELECT name FROM rich) AND virus_2 IN (SELECT name FROM rich)""")
def semi_filter_pairs(spark, sf_dir) -> DataFrame:
    names = A.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("A/"), F.col("s_suppkey").cast("string")))
    return T.semi_filter_pairs(T.merge_reports(A.assay(spark, sf_dir)).select("virus_1", "virus_2", "titre"), names)


@query("remap_pairs", f"""WITH {O.ASSAY}, m AS (SELECT 'A/' || s_suppkey AS name, 'N/' || s_nationkey AS rep FROM supplier)
SELECT x.rep AS test, y.rep AS ref, count(*) AS n FROM assay JOIN m x ON test = x.name JOIN m y ON ref = y.name GROUP BY x.rep, y.rep""")
def remap_pairs(spark, sf_dir) -> DataFrame:
    name_map = A.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("A/"), F.col("s_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("N/"), F.col("s_nationkey").cast("string")).alias("representative"))
    mapped = T.remap_pairs(A.assay(spark, sf_dir).select("test", "ref"), name_map, "test", "ref")
    return mapped.groupBy("test", "ref").agg(F.count(F.lit(1)).alias("n"))


@query("involved_names", f"WITH {O.ASSAY} SELECT test AS name FROM assay UNION SELECT ref FROM assay")
def involved_names(spark, sf_dir) -> DataFrame:
    return T.involved_names(A.assay(spark, sf_dir), "test", "ref")
