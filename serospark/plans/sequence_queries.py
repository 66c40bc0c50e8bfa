"""Queries over aligned sequences (all stretches of all documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from serospark.functions import residues as R
from serospark.functions.constants import AMINO_ACIDS
from serospark.operators import sequences as S
from serospark.plans import adapters as A
from serospark.plans import oracles as O
from serospark.plans.registry import query

STRAIN = "'D/' || doc_id"
GAPS = "(length(seq) - length(replace(seq, '-', '')))"


def _records(spark, sf_dir) -> DataFrame:
    """Every document is one strain; its stretches are the strain's records."""
    return A.sequences(spark, sf_dir).select(
        F.concat(F.lit("D/"), F.col("doc_id").cast("string")).alias("name"), "seq", "file", "pos")


@query("best_record", f"""WITH {O.WINDOWS} SELECT name, seq, pos FROM (
  SELECT {STRAIN} AS name, seq, pos, row_number() OVER (PARTITION BY doc_id
    ORDER BY CASE WHEN regexp_matches(seq, '[-X]') THEN 1 ELSE 0 END, length(replace(replace(seq, '-', ''), 'X', '')) DESC, file, pos) AS rn FROM win) WHERE rn = 1""")
def best_record(spark, sf_dir) -> DataFrame:
    return S.best_record(_records(spark, sf_dir)).select("name", "seq", "pos")


@query("fewest_gaps", f"""WITH {O.WINDOWS} SELECT name, seq, pos FROM (
  SELECT {STRAIN} AS name, seq, pos, row_number() OVER (PARTITION BY doc_id ORDER BY {GAPS}, file, pos) AS rn FROM win) WHERE rn = 1""")
def fewest_gaps(spark, sf_dir) -> DataFrame:
    return S.fewest_gaps(_records(spark, sf_dir)).select("name", "seq", "pos")


YEAR = "CASE WHEN regexp_matches(name, '/[0-9]{4}$') THEN CAST(regexp_extract(name, '/([0-9]{4})$', 1) AS INTEGER) ELSE CAST('20' || regexp_extract(name, '/([0-9]{2,3})$', 1) AS INTEGER) END"
REPS = f"""{O.WINDOWS}, reps AS (SELECT seq, name AS representative FROM (
  SELECT seq, name, row_number() OVER (PARTITION BY seq ORDER BY {YEAR}, file, pos) AS rn FROM win) WHERE rn = 1)"""


@query("strain_years", f"WITH {O.WINDOWS} SELECT CAST({YEAR} AS INTEGER) AS year, count(*) AS n FROM win GROUP BY 1")
def strain_years(spark, sf_dir) -> DataFrame:
    return A.sequences(spark, sf_dir).groupBy(R.year_of(F.col("name")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("representatives", f"WITH {REPS} SELECT seq, representative FROM reps")
def representatives(spark, sf_dir) -> DataFrame:
    return S.representatives(A.sequences(spark, sf_dir))


@query("representative_map", f"WITH {REPS} SELECT name, representative FROM win JOIN reps USING (seq)")
def representative_map(spark, sf_dir) -> DataFrame:
    return S.representative_map(A.sequences(spark, sf_dir))


@query("dedupe_sequences", f"WITH {O.WINDOWS} SELECT seq, name FROM (SELECT seq, name, row_number() OVER (PARTITION BY seq ORDER BY file, pos) AS rn FROM win) WHERE rn = 1")
def dedupe_sequences(spark, sf_dir) -> DataFrame:
    return S.dedupe_sequences(A.sequences(spark, sf_dir)).select("seq", "name")


@query("region_slice", f"WITH {O.WINDOWS} SELECT name, substr(seq, 17, 40) AS seq FROM win WHERE NOT contains(substr(seq, 17, 40), '-')")
def region_slice(spark, sf_dir) -> DataFrame:
    return S.drop_gapped(S.ha1_region(A.sequences(spark, sf_dir), 16, 56)).select("name", "seq")


@query("ha1_slice", f"WITH {O.long_stretches(O.WINDOWS)} SELECT name, substr(seq, 17, 329) AS seq FROM win WHERE NOT contains(substr(seq, 17, 329), '-')")
def ha1_slice(spark, sf_dir) -> DataFrame:
    """The default slice, of stretches of 361 letters."""
    return S.drop_gapped(S.ha1_region(A.sequences(spark, sf_dir, A.LONG_WINDOW))).select("name", "seq")


@query("gap_report", f"WITH {O.WINDOWS} SELECT count(*) FILTER (WHERE NOT contains(seq, '-')) AS n_kept, count(*) FILTER (WHERE contains(seq, '-')) AS n_dropped FROM win")
def gap_report(spark, sf_dir) -> DataFrame:
    return S.gap_report(A.sequences(spark, sf_dir))


@query("glycosylation_sites", f"""WITH {O.WINDOWS} SELECT name, CAST(len(m) AS INTEGER) AS n_sites, CAST(coalesce(list_sum(m), 0) AS BIGINT) AS site_sum FROM (
  SELECT name, list_filter(range(1, 63), lambda i: regexp_full_match(substr(seq, CAST(i AS INTEGER), 3), 'N[^P][ST]')) AS m FROM win)""")
def glycosylation_sites(spark, sf_dir) -> DataFrame:
    found = A.sequences(spark, sf_dir).select("name", R.glycosylation_sites(F.col("seq")).alias("m"))
    return found.select("name", F.size("m").alias("n_sites"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("site_sum"))


CELLS = f"{O.WINDOWS}, cells AS (SELECT name, CAST(i AS INTEGER) AS site, substr(seq, CAST(i + 1 AS INTEGER), 1) AS residue FROM win, range(0, 64) r(i))"


@query("site_residues", f"WITH {CELLS} SELECT site, residue, count(*) AS n FROM cells WHERE residue <> '-' GROUP BY site, residue")
def site_residues(spark, sf_dir) -> DataFrame:
    return S.site_residues(A.sequences(spark, sf_dir))


@query("variable_sites", f"WITH {CELLS} SELECT site, count(DISTINCT residue) AS n_residues FROM cells WHERE residue <> '-' GROUP BY site HAVING count(DISTINCT residue) > 1")
def variable_sites(spark, sf_dir) -> DataFrame:
    return S.variable_sites(A.sequences(spark, sf_dir))


@query("encode_residues", f"WITH {CELLS} SELECT name, string_agg(CAST(strpos('{AMINO_ACIDS}', residue) - 1 AS VARCHAR), ',' ORDER BY site) AS codes FROM cells GROUP BY name")
def encode_residues(spark, sf_dir) -> DataFrame:
    coded = S.encode_table(A.sequences(spark, sf_dir))
    return coded.select("name", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("project_variable_sites", f"""WITH {CELLS}, kept AS (SELECT site FROM cells WHERE residue <> '-' GROUP BY site HAVING count(DISTINCT residue) > 1)
SELECT name, string_agg(residue, '' ORDER BY site) AS seq FROM cells JOIN kept USING (site) GROUP BY name""")
def project_variable_sites(spark, sf_dir) -> DataFrame:
    return S.project_variable_sites(A.sequences(spark, sf_dir)).select("name", "seq")


@query("name_from_header", """SELECT doc_id, trim(split_part(source || ' | ' || lang, '|', 1)) AS pipe_name,
  CASE WHEN length(w[2]) - length(replace(w[2], '/', '')) < 2 THEN w[2] || CASE WHEN len(w) > 2 THEN ' ' || w[3] ELSE '' END ELSE w[2] END AS space_name
FROM (SELECT doc_id, source, lang, list_filter(regexp_split_to_array('id' || doc_id || ' A/' || lang || CASE WHEN doc_id % 2 = 0 THEN '/x/' ELSE ' ' END || doc_id || ' HA', '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def name_from_header(spark, sf_dir) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    pipe = F.concat(F.col("source"), F.lit(" | "), F.col("lang"))
    space = F.concat(F.lit("id"), doc, F.lit(" A/"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "/x/").otherwise(" "), doc, F.lit(" HA"))
    return docs.select("doc_id", R.name_from_pipe_header(pipe).alias("pipe_name"), R.name_from_space_header(space).alias("space_name"))


@query("keep_named", f"WITH {O.WINDOWS} SELECT 'D/' || doc_id AS name, count(*) AS n FROM win WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id")
def keep_named(spark, sf_dir) -> DataFrame:
    names = A.table(spark, sf_dir, "labels").filter("quality = 1").select(F.concat(F.lit("D/"), F.col("doc_id").cast("string")))
    return S.keep_named(_records(spark, sf_dir), names).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("common_names", f"""WITH {O.PAIRS}, good AS (SELECT * FROM win WHERE NOT contains(seq, '-')),
known AS (SELECT a AS name FROM pairs UNION SELECT b FROM pairs)
SELECT 'sequence' AS part, count(*) AS n FROM good WHERE name IN (SELECT name FROM known)
UNION ALL SELECT 'distance', count(*) FROM pairs WHERE a IN (SELECT name FROM good) AND b IN (SELECT name FROM good)""")
def common_names(spark, sf_dir) -> DataFrame:
    kept, cut = S.common_names(S.drop_gapped(A.sequences(spark, sf_dir)), A.distances(spark, sf_dir))
    def counted(df, part):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return counted(kept, "sequence").union(counted(cut, "distance"))


@query("short_names", "SELECT 'D/' || doc_id AS name, CASE WHEN quality IS NULL THEN NULL ELSE 'q' || quality || 't' || toxic END AS short_name FROM documents LEFT JOIN labels USING (doc_id)")
def short_names(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("D/"), F.col("doc_id").cast("string"))
    labels = A.table(spark, sf_dir, "labels").select(
        name.alias("full_name"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("short_name"))
    return S.short_names(A.table(spark, sf_dir, "documents").select(name.alias("name")), labels)


@query("first_n", f"WITH {O.WINDOWS} SELECT name, seq FROM win ORDER BY file, pos LIMIT 200")
def first_n(spark, sf_dir) -> DataFrame:
    return S.first_n(A.sequences(spark, sf_dir), 200).select("name", "seq")
