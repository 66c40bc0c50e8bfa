"""Shared SQL fragments: the adapters of ``adapters`` in ANSI SQL."""

TITRE = """CASE WHEN l_linenumber = 7 THEN '*'
      WHEN l_discount < 0.005 THEN '<20'
      WHEN l_discount < 0.025 THEN '<40'
      WHEN l_linenumber = 6 AND floor(l_tax * 100 + 0.5) = 8 AND l_discount > 0.095 THEN '160.0'
      ELSE CAST(CAST(10 * pow(2, floor(l_tax * 100 + 0.5)) AS INTEGER) AS VARCHAR) END"""

ASSAY = f"""assay AS (SELECT 'A/' || l_suppkey AS test, 'A/' || CAST(l_quantity AS INTEGER) AS ref,
    {TITRE} AS titre, strftime(l_shipdate, '%Y-%m') AS report, l_orderkey, l_linenumber FROM lineitem)"""

SPARSE = f"""sparse AS (SELECT 'T/' || l_orderkey AS test, 'R/' || l_partkey AS ref, {TITRE} AS titre FROM lineitem)"""

MONTHLY = f"""monthly AS (SELECT 'T/' || strftime(l_shipdate, '%Y-%m') || '/' || l_suppkey AS test,
    'R/' || strftime(l_shipdate, '%Y-%m') || '/' || CAST(l_quantity AS INTEGER) AS ref, {TITRE} AS titre FROM lineitem)"""


def kinds(source: str) -> str:
    """CTE ``kinds``: canonical pairs of ``source`` with titre kind and value."""
    return f"""kinds AS (SELECT least(test, ref) AS virus_1, greatest(test, ref) AS virus_2, titre,
    CASE WHEN regexp_full_match(titre, '[0-9]+') THEN 'number' WHEN titre = '*' THEN 'missing'
         WHEN regexp_matches(titre, '^<[0-9]') THEN 'below' ELSE 'illegal' END AS k,
    TRY_CAST(replace(titre, '<', '') AS BIGINT) AS v FROM {source})"""


SUMMARY = """summary AS (SELECT virus_1, virus_2, count(*) AS n_rows,
    count(*) FILTER (WHERE k = 'number') AS n_numeric, count(*) FILTER (WHERE k = 'below') AS n_below,
    count(*) FILTER (WHERE k = 'missing') AS n_missing, count(*) FILTER (WHERE k = 'illegal') AS n_illegal,
    avg(v) FILTER (WHERE k = 'number') AS m, min(v) FILTER (WHERE k = 'below') AS lo
  FROM kinds GROUP BY virus_1, virus_2),
merged AS (SELECT virus_1, virus_2, n_rows, n_numeric, n_below, n_missing,
    CASE WHEN n_numeric > 0 THEN 'number' WHEN n_below > 0 THEN 'below' ELSE 'missing' END AS kind,
    CASE WHEN n_numeric > 0 THEN CAST(CAST(floor(m) AS BIGINT) AS VARCHAR) WHEN n_below > 0 THEN '<' || lo ELSE '*' END AS titre
  FROM summary WHERE n_illegal = 0)"""

WINDOWS = """letters AS (SELECT doc_id, lang, source,
    translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUZ', '-----') AS s FROM documents),
win AS (SELECT 'A/' || lang || '/' || doc_id || '-' || w || '/' ||
      CASE WHEN doc_id % 2 = 0 THEN CAST(1968 + doc_id % 35 AS VARCHAR) ELSE lpad(CAST(doc_id % 26 AS VARCHAR), 2, '0') END AS name,
    rpad(substr(s, w * 64 + 1, 64), 64, '-') AS seq, source AS file, doc_id * 4294967296 + w AS pos, doc_id, CAST(w AS INTEGER) AS w
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(s) / 64.0) AS BIGINT))) AS w FROM letters))"""

PAIRS = WINDOWS + """,
pairs AS (SELECT x.name AS a, y.name AS b, x.seq AS seq_a, y.seq AS seq_b, levenshtein(x.seq, y.seq) / 8.0 AS dist
  FROM win x JOIN win y ON x.doc_id = y.doc_id AND y.w = x.w + 1)"""



def long_stretches(sql: str) -> str:
    """The same tables cut into stretches of 361 letters."""
    return sql.replace("64.0", "361.0").replace(" 64 ", " 361 ").replace("64)", "361)").replace(" 64,", " 361,")


# Sites of a pair table, zero-based.
SITES = """sites AS (SELECT a, b, dist, CAST(i AS INTEGER) AS site, substr(seq_a, CAST(i + 1 AS INTEGER), 1) AS x, substr(seq_b, CAST(i + 1 AS INTEGER), 1) AS y
  FROM pairs, range(0, 64) r(i))"""

POINTS = """points AS (SELECT 'V/' || vec_id AS name, vec_id, label, embedding FROM embeddings),
steps AS (SELECT 'V/' || e.vec_id AS a, 'V/' || o.vec_id AS b, e.embedding AS p, o.embedding AS q
  FROM embeddings e, (VALUES (1), (2), (3), (5), (8)) s(d), embeddings o WHERE o.vec_id = e.vec_id + s.d)"""

L2 = "sqrt(list_sum(list_transform(range(1, len(p) + 1), lambda i: (CAST(p[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(p[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)))))"


def scale_values(name: str, values) -> str:
    """A residue scale as a two-column VALUES table."""
    from serospark.functions.constants import AMINO_ACIDS

    rows = ", ".join(f"('{aa}', CAST({float(v)!r} AS DOUBLE))" for aa, v in zip(AMINO_ACIDS, values))
    return f"{name}(aa, v) AS (VALUES {rows})"


def unit_hash(text: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5({text} || '|{seed}'), 1, 8)) AS BIGINT) / 4294967296.0"
