"""Queries that write a table derived from the inputs in a file format and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from serospark.functions.constants import AMINO_ACIDS, RECORD_PAIR_ORDER
from serospark.operators import pairs as PO
from serospark.operators import sequences as S
from serospark.operators import titres as T
from serospark.plans import adapters as A
from serospark.plans import oracles as O
from serospark.plans.normalise_queries import LOGITS_SQL, MATS_SQL, PROPS_SQL, brand_props, fused_weights, line_matrices
from serospark.plans.registry import query
from serospark.session import scratch_path
from serospark.sources import fasta, ledger, properties, tables, web


@query("titre_files", f"WITH {O.ASSAY} SELECT report, test, ref, titre, count(*) AS n FROM assay GROUP BY ALL")
def titre_files(spark, sf_dir) -> DataFrame:
    """One CSV per report month, read back as a folder; the month comes from the file name."""
    path = scratch_path(spark, "titres")
    assay = A.assay(spark, sf_dir)
    named = assay.select(F.col("test").alias("Test Virus"), F.col("ref").alias("Reference Virus"), F.col("titre").alias("Titre"), "report")
    named.write.partitionBy("report").option("header", True).csv(path)
    raw = tables.read_titres(spark, f"{path}/*")
    month = F.regexp_extract(F.col("_metadata.file_path"), "report=([^/]+)", 1)
    return raw.drop("report").withColumn("report", month).groupBy("report", "test", "ref", "titre").agg(F.count(F.lit(1)).alias("n"))


@query("curated_titres_file", f"WITH {O.ASSAY}, {O.kinds('assay')}, {O.SUMMARY} SELECT virus_1 AS test, virus_2 AS ref, titre FROM merged")
def curated_titres_file(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "curated")
    tables.write_titres(T.merge_reports(A.assay(spark, sf_dir)), path)
    return tables.read_titres(spark, path).drop("report")


@query("sequence_file", f"WITH {O.WINDOWS} SELECT name, seq FROM win")
def sequence_file(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "sequences")
    seqs = A.sequences(spark, sf_dir).select(F.col("name").alias("short_name"), F.col("seq").alias("HA1_sequence"), "doc_id")
    tables.write_table(seqs, path, "csv")
    return tables.read_sequences(spark, path).select("name", "seq")


@query("fasta_records", f"WITH {O.WINDOWS} SELECT 'D/' || doc_id AS id, 'D/' || doc_id || ' ' || name AS description, seq FROM win")
def fasta_records(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "fasta")
    seqs = A.sequences(spark, sf_dir).select(F.concat(F.lit("D/"), F.col("doc_id").cast("string"), F.lit(" "), F.col("name")).alias("name"), "seq")
    fasta.write_fasta(seqs, path)
    return fasta.read_fasta(spark, path).select("id", "description", "seq")


@query("fasta_first_record", f"WITH {O.WINDOWS} SELECT 'D/' || doc_id AS name, seq FROM win WHERE w = 0")
def fasta_first_record(spark, sf_dir) -> DataFrame:
    """Reading order survives the file: the first record of each strain is its first stretch."""
    path = scratch_path(spark, "fasta")
    seqs = A.sequences(spark, sf_dir).select(F.concat(F.lit("D/"), F.col("doc_id").cast("string")).alias("name"), "seq")
    fasta.write_fasta(seqs, path)
    read = fasta.read_fasta(spark, path).select(F.col("id").alias("name"), "seq", "file", "pos")
    return S.first_by(read, ["name"], [F.col("file"), F.col("pos")]).select("name", "seq")


@query("distance_matrix_file", """WITH m AS (SELECT n_name AS a, r_name AS b, CAST(n_nationkey * 10 + r_regionkey AS DOUBLE) AS dist FROM nation, region),
s AS (SELECT n_name AS a, r_name AS b, sum(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT a, b, round(v, 2) AS dist FROM (SELECT n_name AS a, r_name AS b FROM nation, region) LEFT JOIN s USING (a, b) WHERE a IN (SELECT a FROM s) AND b IN (SELECT b FROM s)""")
def distance_matrix_file(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "matrix")
    supplier, nation, region = (A.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    sums = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    long = sums.groupBy(F.col("n_name").alias("a"), F.col("r_name").alias("b")).agg(F.round(F.sum("s_acctbal"), 2).alias("dist"))
    tables.write_table(tables.distance_matrix(long), path, "csv")
    return tables.read_distance_matrix(spark, path)


@query("coordinate_file", "SELECT 'V/' || vec_id AS name, round(CAST(list_avg(embedding) AS DOUBLE), 5) AS \"MDS1\", round(CAST(list_max(embedding) AS DOUBLE), 5) AS \"MDS2\" FROM embeddings")
def coordinate_file(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "coordinates")
    mean = F.aggregate("point", F.lit(0.0), lambda s, x: s + x) / F.size("point")
    tables.write_table(A.points(spark, sf_dir).select("name", mean.alias("MDS1"), F.array_max("point").alias("MDS2")), path, "csv")
    return tables.read_coordinates(spark, path).select("name", F.round("MDS1", 5).alias("MDS1"), F.round("MDS2", 5).alias("MDS2"))


@query("name_map_file", "SELECT s_name AS full_name, 'S/' || s_suppkey AS short_name FROM supplier")
def name_map_file(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "names")
    names = A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("full_name"), F.concat(F.lit("S/"), F.col("s_suppkey").cast("string")).alias("short_name"))
    tables.write_table(names, path, "csv")
    return tables.read_name_map(spark, path)


@query("weights_file", f"WITH {LOGITS_SQL} SELECT prop_name, round(weight, 6) AS weight FROM fused")
def weights_file(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "weights")
    tables.write_weights(fused_weights(spark, sf_dir), path)
    return tables.read_weights(spark, path).select("prop_name", F.round("weight", 6).alias("weight"))


PAIRWISE = "".join(p.replace("/", "") for p in RECORD_PAIR_ORDER)


@query("property_records", f"""WITH {PROPS_SQL}, r AS (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) % 3 <> 0)
SELECT prop, substr('{PAIRWISE}', CAST(i + 1 AS INTEGER), 1) AS aa, round(v, 6) AS value FROM props WHERE prop IN (SELECT p_brand FROM r)""")
def property_records(spark, sf_dir) -> DataFrame:
    """Brand properties as scalar records; those of brands with a part count divisible by 3 hold an NA."""
    path = scratch_path(spark, "aaindex")
    sizes = A.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("prop")).agg(F.count(F.lit(1)).alias("n"))
    text = F.transform("vals", lambda v: F.format_string("%.6f", F.round(v, 6)))
    def row(start):
        return F.array_join(F.slice(text, start, 10), "    ")
    last = F.when(F.col("n") % 3 == 0, F.regexp_replace(row(11), r"\S+$", "NA")).otherwise(row(11))
    record = F.concat(F.lit("H "), F.regexp_replace("prop", "#", "_"), F.lit("\nD invented\nI    A/L     R/K     N/M\n  "), row(1), F.lit("\n  "), last, F.lit("\n//"))
    brand_props(spark, sf_dir).join(sizes, "prop").select(record).write.text(path)
    from serospark.operators.normalise import vals_to_long

    read = properties.read_property_records(spark, path).select(F.regexp_replace("prop", "_", "#").alias("prop"), F.lit(0).cast("bigint").alias("ord"), "vals")
    return vals_to_long(read).select("prop", "aa", "value")


def _matrix_records(spark, sf_dir) -> DataFrame:
    """Odd matrices as full records, even ones as lower triangles, all over the standard letters."""
    def row(i, width):
        return F.array_join(F.transform(F.slice("cells", i * 20 + 1, width), lambda v: F.format_string("%.1f", v)), " ")
    full = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: row(i, F.lit(20)))
    half = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: row(i, i + 1))
    head = F.concat(F.lit("H "), F.col("prop"), F.lit(f"\nD invented\nM rows = {AMINO_ACIDS}, cols = {AMINO_ACIDS}\n"))
    lines = F.when(F.col("ord") % 2 == 1, full).otherwise(half)
    return line_matrices(spark, sf_dir).select(F.concat(head, F.array_join(lines, "\n"), F.lit("\n//")))


MATS_READ = f"{MATS_SQL}, seen AS (SELECT m.prop, m.aa_i, m.aa_j, CASE WHEN m.ord % 2 = 1 OR m.i >= m.j THEN m.value ELSE t.value END AS value FROM mats m JOIN mats t ON t.prop = m.prop AND t.i = m.j AND t.j = m.i)"


@query("property_matrices", f"WITH {MATS_READ} SELECT prop, aa_i, aa_j, value FROM seen")
def property_matrices(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "aaindex")
    _matrix_records(spark, sf_dir).write.text(path)
    return properties.matrices_to_long(properties.read_property_matrices(spark, path))


@query("matrix_csvs", f"WITH {MATS_READ} SELECT prop, aa_i, aa_j, value FROM seen")
def matrix_csvs(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "aaindex")
    _matrix_records(spark, sf_dir).write.text(path)
    out = scratch_path(spark, "matrices")
    properties.write_property_matrices(properties.read_property_matrices(spark, path, alphabet=None), out)
    return properties.read_matrix_csvs(spark, out)


@query("property_json", f"WITH {PROPS_SQL} SELECT prop, aa, round(v, 6) AS value FROM props")
def property_json(spark, sf_dir) -> DataFrame:
    from serospark.operators.normalise import vals_to_long

    path = scratch_path(spark, "json")
    properties.write_property_json(brand_props(spark, sf_dir), path)
    read = properties.read_property_json(spark, path).withColumn("ord", F.lit(0).cast("bigint"))
    return vals_to_long(read).select("prop", "aa", F.round("value", 6).alias("value"))


@query("matrix_json", f"WITH {MATS_SQL} SELECT prop, aa_i, aa_j, value FROM mats")
def matrix_json(spark, sf_dir) -> DataFrame:
    from serospark.operators.normalise import cells_to_long

    path = scratch_path(spark, "json")
    properties.write_matrix_json(line_matrices(spark, sf_dir), path)
    read = properties.read_matrix_json(spark, path).withColumn("ord", F.lit(0).cast("bigint"))
    return cells_to_long(read).select("prop", "aa_i", "aa_j", "value")


@query("ledger_pending", "SELECT p_brand AS matrix_name, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' GROUP BY p_brand HAVING count(*) >= 14) GROUP BY p_brand")
def ledger_pending(spark, sf_dir) -> DataFrame:
    """Brands without a ledger row; the ledger is appended in two steps."""
    path = scratch_path(spark, "ledger")
    schema = "matrix_name string, rmse double"
    part = A.table(spark, sf_dir, "part")
    done = part.filter("p_type = 'ECONOMY'").groupBy(F.col("p_brand").alias("matrix_name")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 14")
    candidates = part.groupBy(F.col("p_brand").alias("matrix_name")).agg(F.count(F.lit(1)).alias("n"))
    first = ledger.ledger_pending(candidates, ledger.ledger_read(spark, path, schema), ["matrix_name"])
    ledger.ledger_append(first.join(done.select("matrix_name"), "matrix_name", "left_semi").select("matrix_name", F.lit(1.0).alias("rmse")), path)
    ledger.ledger_append(done.select("matrix_name", F.lit(2.0).alias("rmse")), path)
    return ledger.ledger_pending(candidates, ledger.ledger_read(spark, path, schema), ["matrix_name"])


@query("extract_links", """WITH h AS (SELECT url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hs FROM pages),
u AS (SELECT url, CAST(i - 1 AS INTEGER) AS position, replace(replace(replace(replace(hs[i], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS href FROM h, unnest(range(1, len(hs) + 1)) t(i)),
c AS (SELECT url, position, CASE position % 3 WHEN 0 THEN href WHEN 1 THEN 'down' || href ELSE '../up' || href END AS href, position % 3 AS k FROM u),
f AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(/.*)$', 1), '[^/]*$', '') AS folder FROM c)
SELECT url, position, site || CASE k WHEN 0 THEN href WHEN 1 THEN folder || href ELSE regexp_replace(folder, '[^/]*/$', '') || substr(href, 4) END AS link FROM f""")
def extract_links(spark, sf_dir) -> DataFrame:
    """Every navigation target, a third each from the root, below the page and above it; anchors in comments and scripts are none."""
    pages = A.table(spark, sf_dir, "pages")
    anchors = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    def anchor(href, i):
        own = (F.when(i % 3 == 0, F.concat(F.lit('<a href="'), href, F.lit('">'))).when(i % 3 == 1, F.concat(F.lit("<A class=x HREF = 'down"), F.replace(href, F.lit("'"), F.lit("&#39;")), F.lit("'>")))
               .otherwise(F.concat(F.lit('<a title="a > b" href="../up'), href, F.lit('">'))))
        return F.concat(F.lit('<!-- <a href="/no"> --><script>"<a href=\'/no\'>"</script><p title="<a href=/no>">'), own)
    return web.extract_links(pages.select("url", F.array_join(F.transform(anchors, anchor), "").alias("html")), "")


@query("report_period", """SELECT url, n, CASE WHEN m <> '' THEN regexp_extract(n, '(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*-?([0-9]{4})', 1) || '-' || lower(m)
  WHEN y <> '' THEN regexp_extract(n, '([0-9]{4})_', 1) || '-' || lower(y) END AS period FROM (
  SELECT url, n, regexp_extract(n, '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}-?[0-9]{4}', 1) AS m, regexp_extract(n, '[0-9]{4}_(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)', 1) AS y FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_orderstatus = 'F' THEN 'report-' || lower(strftime(o_orderdate, '%B')) || '-' || strftime(o_orderdate, '%Y') || '.pdf'
    WHEN o_orderstatus = 'O' THEN 'who_' || strftime(o_orderdate, '%Y') || '_' || lower(strftime(o_orderdate, '%b')) || '.pdf' ELSE 'interim-' || o_orderkey || '.pdf' END AS n FROM orders))""")
def report_period(spark, sf_dir) -> DataFrame:
    """File names with month and year, year and month, or neither, from the order dates."""
    when = F.col("o_orderdate")
    name = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("report-"), F.lower(F.date_format(when, "MMMM")), F.lit("-"), F.date_format(when, "yyyy"), F.lit(".pdf")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("who_"), F.date_format(when, "yyyy"), F.lit("_"), F.lower(F.date_format(when, "MMM")), F.lit(".pdf")))
        .otherwise(F.concat(F.lit("interim-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    )
    files = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), name.alias("n"))
    return files.withColumn("period", web.report_period(F.col("n")))
