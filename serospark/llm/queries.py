"""The queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from serospark.llm import (
    boilerplate, chat, decontaminate, langid, packing, pii, repair, simhash, sketches, tokenids, toxicity, urlfilter, vectorcodes)
from serospark.llm.common import counted_lookup
from serospark.session import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


CHAT_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (SELECT *, length(t2) + length(r2) + 9 AS n FROM (SELECT *,
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lb;'), ']', '&rb;') AS t2,
    replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lb;'), ']', '&rb;') AS r2 FROM all_turns))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id"""


@query("op7_chat_formatting", CHAT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    output = cut_lineage(chat.format_chats(chat.events_from_turns(turns.unionByName(extra))), "chats")
    parsed = output.withColumns({
        "turns": chat.parse(F.col("formatted")), "masked": chat.masked_text(F.col("formatted"), F.col("loss"))})
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
p AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, p.n, item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op8_decontamination", DECONTAMINATION_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return hits.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


RULES = (
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
)

URL_SQL = r"""
WITH parts AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels GROUP BY doc_id),
bare AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad) AS seen, coalesce(sum(bad), 0) AS bad
    FROM parts LEFT JOIN known USING (page_id) GROUP BY host),
hosts AS (SELECT host, seen, bad, CASE WHEN address THEN name WHEN long THEN regexp_extract(name, '([^.]*\.)?[^.]*\.[^.]*$') ELSE regexp_extract(name, '([^.]*\.)?[^.]*$') END AS domain,
    CASE WHEN address THEN name WHEN long THEN regexp_extract(name, '[^.]*\.[^.]*$') ELSE regexp_extract(name, '[^.]*$') END AS suffix
    FROM (SELECT *, regexp_full_match(name, '[0-9.]+|\[.*\]') AS address, regexp_extract(name, '[^.]*\.[^.]*$') IN (@LONG) AS long FROM bare)),
domains AS (SELECT domain, suffix, sum(seen) AS seen, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(seen) AS seen, sum(bad) AS bad FROM domains GROUP BY ALL),
levels AS (SELECT 1 AS level, seen, bad FROM suffixes UNION ALL SELECT 2, seen, bad FROM domains UNION ALL SELECT 3, seen, bad FROM hosts),
sums AS (SELECT level, CAST(sum(bad) AS DOUBLE) AS k, CAST(sum(seen) AS DOUBLE) AS n, CAST(sum(seen * seen) AS DOUBLE) AS n2,
    sum(CASE WHEN seen > 0 THEN CAST(bad * bad AS DOUBLE) / seen END) AS kk, count(*) FILTER (WHERE seen > 0) AS g FROM levels GROUP BY level),
moments AS (SELECT *, (k + 0.5e0) / (n + 1) AS mu, (k + 0.5e0) / (n + 1) * (1 - (k + 0.5e0) / (n + 1)) AS v FROM sums),
rhos AS (SELECT level, mu, CASE WHEN n > 0 AND (n - n2 / n - (g - 1)) * v > 0
    THEN (kk - 2 * mu * k + mu * mu * n - (g - 1) * v) / ((n - n2 / n - (g - 1)) * v) END AS rho FROM moments),
weights AS (SELECT level, mu, greatest(1.0e0, least(1000.0e0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000.0e0 END)) AS w FROM rhos),
top AS (SELECT suffix, (bad + w * mu) / (seen + w) AS up FROM suffixes, weights WHERE level = 1),
middle AS (SELECT domain, (bad + w * up) / (seen + w) AS up FROM domains JOIN top USING (suffix), weights WHERE level = 2),
low AS (SELECT host, bad + w * up AS a, seen - bad + w * (1 - up) AS b FROM hosts JOIN middle USING (domain), weights WHERE level = 3),
rated AS (SELECT host, a / (a + b) AS bad_share, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM low),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bound >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, bad_share, bound
FROM ruled JOIN rated USING (host)""".replace("@LONG", ", ".join(f"'{s}'" for s in urlfilter.LONG_SUFFIXES))


@query("op9_url_filters", URL_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels", "doc_id", "quality").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urlfilter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), outcomes, RULES)


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_token_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    tokenids.write_ids(table(spark, sf_dir, "documents", "doc_id", "text"), word_tokenizer(), path)
    return tokenids.read_ids(spark, path)


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), word_tokenizer())


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.edited_likeness(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketches.text_of(F.col("own")).alias("fingerprint"), sketches.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("own"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"))


def held_out():
    return toxicity.remainder("doc_id") == 2


def learnt(df: DataFrame) -> DataFrame:
    """Rows that may be learnt from."""
    return df.filter(toxicity.remainder("doc_id") != 2)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(documents, learnt(table(spark, sf_dir, "labels", "doc_id", "toxic")))
    scored = toxicity.score(documents, model, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(learnt(documents))
    # The contract knows no rejected language: what the fitted bound rejects is a column of its own.
    found = langid.identify(documents, model, "doc_id", keep_rejected=True)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")
    return found.select(
        "doc_id", *[count(k) for k in range(len(pii.KINDS))], F.sha2(pii.listed_spans(F.col("base")), 256).alias("base_sha256"),
        pii.listed_spans(F.col("spans")).alias("spans"))


@query("op11_html_extraction")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boilerplate.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


VECTOR_SQL = r"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, j, v[4*j+1] AS a, v[4*j+2] AS b, v[4*j+3] AS c, v[4*j+4] AS d FROM kept, (SELECT unnest(range(16)) AS j)),
book0 AS MATERIALIZED (SELECT j, e, a, b, c, d FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
near0 AS MATERIALIZED (SELECT p.vec_id, p.j, min(((p.a-k.a)**2 + (p.b-k.b)**2 + (p.c-k.c)**2 + (p.d-k.d)**2)::BIGINT * 64 + e) AS m FROM parts p JOIN book0 k USING (j) GROUP BY ALL),
mean0 AS (SELECT j, m % 64 AS e, floor(sum(a)::DOUBLE / count(*))::BIGINT AS a, floor(sum(b)::DOUBLE / count(*))::BIGINT AS b,
    floor(sum(c)::DOUBLE / count(*))::BIGINT AS c, floor(sum(d)::DOUBLE / count(*))::BIGINT AS d FROM parts JOIN near0 USING (vec_id, j) GROUP BY ALL),
book1 AS MATERIALIZED (SELECT j, e, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b, coalesce(n.c, o.c) AS c, coalesce(n.d, o.d) AS d FROM book0 o LEFT JOIN mean0 n USING (j, e)),
near1 AS MATERIALIZED (SELECT p.vec_id, p.j, min(((p.a-k.a)**2 + (p.b-k.b)**2 + (p.c-k.c)**2 + (p.d-k.d)**2)::BIGINT * 64 + e) AS m FROM parts p JOIN book1 k USING (j) GROUP BY ALL),
mean1 AS (SELECT j, m % 64 AS e, floor(sum(a)::DOUBLE / count(*))::BIGINT AS a, floor(sum(b)::DOUBLE / count(*))::BIGINT AS b,
    floor(sum(c)::DOUBLE / count(*))::BIGINT AS c, floor(sum(d)::DOUBLE / count(*))::BIGINT AS d FROM parts JOIN near1 USING (vec_id, j) GROUP BY ALL),
book2 AS MATERIALIZED (SELECT j, e, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b, coalesce(n.c, o.c) AS c, coalesce(n.d, o.d) AS d FROM book1 o LEFT JOIN mean1 n USING (j, e)),
near2 AS MATERIALIZED (SELECT p.vec_id, p.j, min(((p.a-k.a)**2 + (p.b-k.b)**2 + (p.c-k.c)**2 + (p.d-k.d)**2)::BIGINT * 64 + e) AS m FROM parts p JOIN book2 k USING (j) GROUP BY ALL),
coded AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(m % 64), 2, '0')), '' ORDER BY j) AS code, sum(m // 64)::BIGINT AS error
    FROM near2 JOIN kept USING (vec_id) GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY j, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


@query("op12_vector_codes", VECTOR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectorcodes.encode(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    rows = cut_lineage(coded.rows.withColumn("class", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("of"))), "codes")
    labels = rows.groupBy("class").agg(F.sum("error").alias("label_error"))
    return counted_lookup(rows, labels, "class").select(
        F.col("id").alias("vec_id"), vectorcodes.code_text(F.col("codes")).alias("code"), "error", "label_error",
        F.lit(vectorcodes.codebooks_digest(coded.codebooks)).alias("codebooks_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as the repair query damages them; nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, role, text = F.crc32(key) % 20, F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), twice.alias("_copy")).drop("_copy")


REPAIR_SQL = r"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS i))),
named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM named, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, left(role, 1) AS o FROM damaged),
faults AS (SELECT *, shown = '' AS blank, shown <> '' AND again > 1 AS dup, shown <> '' AND again = 1 AND right(shown, 1) NOT IN ('.', '!', '?') AS cut,
    lag(o) OVER (PARTITION BY conv_id ORDER BY i) AS po FROM placed),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE i > 1 AND po || o NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
-- Best ways to finish from rows i on, per state: eight digits of cost, then the edits. g0..g3 may insert first.
best AS (SELECT conv_id, n AS i, '00000000' AS g0, '00000004II' AS g1, '00000002I' AS g2, '00000000' AS g3 FROM stats
  UNION ALL SELECT conv_id, i - 1, least(n0, up2 || substr(n2, 9), up3 || substr(n3, 9)), least(n1, lpad(CAST(CAST(left(n2, 8) AS INT) + 2 AS VARCHAR), 8, '0') || 'I' || substr(n2, 9), up3 || substr(n3, 9)),
    least(n2, lpad(CAST(CAST(left(n3, 8) AS INT) + 2 AS VARCHAR), 8, '0') || 'I' || substr(n3, 9), lpad(CAST(CAST(left(n2, 8) AS INT) + 4 AS VARCHAR), 8, '0') || 'II' || substr(n2, 9)),
    least(n3, lpad(CAST(CAST(left(n2, 8) AS INT) + 2 AS VARCHAR), 8, '0') || 'I' || substr(n2, 9), up3 || substr(n3, 9))
  FROM (SELECT *, lpad(CAST(CAST(left(n2, 8) AS INT) + 2 AS VARCHAR), 8, '0') || 'I' AS up2, lpad(CAST(CAST(left(n3, 8) AS INT) + 4 AS VARCHAR), 8, '0') || 'II' AS up3 FROM (
    SELECT conv_id, i, least(d0, CASE WHEN ok AND o = 's' THEN k || substr(g1, 9) END, CASE WHEN ok AND o = 'u' THEN k2 || substr(g2, 9) END, CASE WHEN ok THEN r2 || substr(g2, 9) END) AS n0,
      least(d1, CASE WHEN ok AND o = 'u' THEN k2 || substr(g2, 9) END, CASE WHEN ok THEN r2 || substr(g2, 9) END) AS n1,
      least(d2, CASE WHEN ok AND o = 'a' THEN k3 || substr(g3, 9) END, CASE WHEN ok THEN r3 || substr(g3, 9) END) AS n2,
      least(d3, CASE WHEN ok AND o = 'u' THEN k2 || substr(g2, 9) END, CASE WHEN ok THEN r2 || substr(g2, 9) END) AS n3
    FROM (SELECT b.*, f.o, NOT f.blank AND NOT f.dup AS ok,
        lpad(CAST(CAST(left(g0, 8) AS INT) + 3 AS VARCHAR), 8, '0') || 'D' || substr(g0, 9) AS d0, lpad(CAST(CAST(left(g1, 8) AS INT) + 3 AS VARCHAR), 8, '0') || 'D' || substr(g1, 9) AS d1,
        lpad(CAST(CAST(left(g2, 8) AS INT) + 3 AS VARCHAR), 8, '0') || 'D' || substr(g2, 9) AS d2, lpad(CAST(CAST(left(g3, 8) AS INT) + 3 AS VARCHAR), 8, '0') || 'D' || substr(g3, 9) AS d3,
        lpad(CAST(CAST(left(g1, 8) AS INT) + CAST(f.cut AS INT) AS VARCHAR), 8, '0') || 'K' AS k, lpad(CAST(CAST(left(g2, 8) AS INT) + CAST(f.cut AS INT) AS VARCHAR), 8, '0') || 'K' AS k2,
        lpad(CAST(CAST(left(g3, 8) AS INT) + CAST(f.cut AS INT) AS VARCHAR), 8, '0') || 'K' AS k3, lpad(CAST(CAST(left(g2, 8) AS INT) + 2 + CAST(f.cut AS INT) AS VARCHAR), 8, '0') || 'R' AS r2,
        lpad(CAST(CAST(left(g3, 8) AS INT) + 2 + CAST(f.cut AS INT) AS VARCHAR), 8, '0') || 'R' AS r3
      FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i)))),
found AS (SELECT conv_id, CAST(left(g0, 8) AS BIGINT) AS cost, substr(g0, 9) AS audit FROM best WHERE i = 0),
edits AS (SELECT conv_id, p, substr(audit, p, 1) AS e, count(*) FILTER (WHERE substr(audit, p, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
    count(*) FILTER (WHERE substr(audit, p, 1) <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS out FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM found)),
made AS (SELECT e.*, f.role, f.text, f.o, max(CASE WHEN out = 1 AND e = 'K' AND f.o = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
    FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i),
lines AS (SELECT conv_id, p, CASE WHEN e = 'K' THEN role WHEN (out - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM made WHERE e <> 'D'),
joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS repaired FROM lines GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query("op13_conversation_repair", REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = repair.repair(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    rows = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
