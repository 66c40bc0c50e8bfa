"""Every query of the subpackage: SQL twins, or brute force where SQL has no form."""

import hashlib
import math
import re
import string
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from serospark.llm import queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = [r.asDict() for r in queries.QUERIES[name](spark, SF_DIR).collect()]
        return made[name]
    return get


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(result, duck, name):
    found = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, row))) for row in found.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(row.items())) for row in result(name))
    assert sorted(result(name)[0]) == sorted(columns) and got == want


@pytest.fixture(scope="module")
def ids(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in documents.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_op6_against_the_tokenizer(result, ids):
    want, start = [], 0
    for doc_id, own in ids.items():
        want.append((doc_id, start, len(own), crc(own)))
        start += len(own)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in result("op6_token_ids")) == want


def test_op3_packs_every_piece_gapless(result, ids):
    rows = result("op3_packing")
    want = sorted((d, p, p * 4096, len(own[p * 4096:(p + 1) * 4096]), crc(own[p * 4096:(p + 1) * 4096]))
                  for d, own in ids.items() for p in range(-(-len(own) // 4096)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 4096
    assert len(sequences) <= math.ceil(sum(sequences.values()) / 4096) * 1.02 + 1


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1_against_brute_force(result, documents):
    prints = {d: simhash(t) for d, t in documents.items()}
    component = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if component[b] < component[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    component[a], changed = component[b], True
    want = {d: (f"{prints[d]:016x}", component[d]) for d in prints}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op1_simhash")} == want


FORMS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_forms(text):
    found = []
    for k, (name, form) in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
            good = {"email": True, "ip": name == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[name]
            if good:
                found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_op2_base_spans_against_plain_patterns(result, documents):
    for row in result("op2_pii"):
        base = base_forms(documents[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row["spans"].split(",")) | {""}
        assert [row[f"n_{k}"] for k, _ in FORMS] == [sum(s.startswith(k) for s in base) for k, _ in FORMS]


def test_op4_scores_every_document(result, documents):
    rows = result("op4_toxicity")
    assert sorted(r["doc_id"] for r in rows) == list(documents)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_op4_and_op5_on_held_out_documents(spark):
    """At the 0.1 tables there is enough to learn from."""
    folder = SF_DIR.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES["op4_toxicity"](spark, folder).filter("held_out").collect() if r["doc_id"] in labels]
    right = sum(r["predicted"] and labels[r["doc_id"]] for r in held)
    assert right >= 0.85 * sum(r["predicted"] for r in held) and right >= 0.85 * sum(labels[r["doc_id"]] for r in held)
    found = queries.QUERIES["op5_language"](spark, folder).filter("held_out")
    joined = found.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in joined) >= 0.99 * len(joined)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_op10_against_exact_sets(result, documents):
    texts, rows, errors = list(documents.values()), {r["doc_id"]: r for r in result("op10_fingerprints")}, []
    for i, (doc_id, text) in enumerate(documents.items()):
        row, following = rows[doc_id], texts[(i + 1) % len(texts)]
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, row["near_edited"]), (following, row["near_next"])):
            a, b = shingles(text), shingles(other)
            errors.append(abs(near - (len(a & b) / len(a | b) if a | b else 1)))
        hashes = sorted({int(np.int64(xxhash_of(s)) & (2**63 - 1)) for s in shingles(text)})[:64] if len(text.split()) < 5 else None
        if hashes is not None:
            assert row["fingerprint"] == "".join(f"{h:016x}" for h in hashes)
    assert max(errors) < 0.3 and np.mean(errors) < 0.05


def xxhash_of(text):
    return np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64)


def test_pipeline_against_its_parts(spark, documents, duck, result):
    """Kept ids follow from the brute-force forms of the filtering stages, each on what the one before kept."""
    docs, sizes = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).persist()
        sizes.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rejected = {r["doc_id"] for r in result("op4_toxicity") if r["predicted"]}
    assert set(sizes[0]) == set(documents) - rejected
    # The stage links sets of five-word shingles of Jaccard index 0.8 or more.
    lower = {ord(c): c.lower() for c in string.ascii_uppercase}
    sets, component = {d: shingles(sizes[0][d].translate(lower)) for d in sorted(sizes[0])}, {}
    for d, own in sets.items():
        near = {component[e] for e in component if own == sets[e] or 5 * len(own & sets[e]) >= 4 * len(own | sets[e])}
        for e in [e for e, c in component.items() if c in near]:
            component[e] = min(near | {d})
        component[d] = min(near | {d})
    assert set(sizes[1]) == {d for d, c in component.items() if c == d}
    dirty = {r["doc_id"] for r in result("op8_decontamination") if r["contaminated"]}
    assert set(sizes[2]) == set(sizes[1]) - dirty
    assert set(sizes[3]) == set(sizes[2]) and not any(base_forms(t) for t in sizes[3].values() if "@" in t)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in packed.collect()} == set(sizes[3])
    assert corpus_pipeline.run(spark, SF_DIR).count() == packed.count()
