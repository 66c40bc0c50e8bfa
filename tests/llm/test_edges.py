"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from serospark import session
from serospark.llm import chat, components, decontaminate, golay, langid, packing, pii, resembling, simhash, sketches, subwords, texts, tokenids, tokens, toxicity, urlfilter
from serospark.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}x" for i in range(60_000))
# Every operator has to pass these rows: nulls, blanks, a long text, repeats, and columns that clash with its own names.
SCHEMA = "doc_id long, text string, row long, key string, fp long, range int, place int, score string, marks int, base int, length int, n_chars long"
ROWS = [
    (3, "alpha beta gamma delta epsilon"), (3, "alpha beta gamma delta epsilon"), (1, None), (2, ""), (5, "   \n\t "), (None, "a text without an id"),
    (None, None), (7, LONG), (4, "Éric ÉCRIT à 12:30, «ici»! 😀 e\u0301"), (6, "alpha beta gamma delta epsilon zeta")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4, "s", 5, 6, 7, len(t or "")) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words_of_long_texts():
    data = (LONG + "\n" + LONG).encode()
    assert b"".join(texts.pieces(data, 1000)) == data
    assert texts.single_spaced(b"  a\t b\n\n" + data) == b" ".join([b"a", b"b", *data.split()])
    assert list(texts.pieces(b"x" * 50, 10)) == [b"x" * 50]


def test_encoder_equals_the_tokenizer():
    odd = [
        "", "  ", "don't I'll A.B c;d x<|endoftext|>y E\u0301 \u0130stanbul ΟΔΟΣ \x1c\x1da b\xa0c\x85d …", "ß ŒUVRE!!! ?? a.,b 12ab34 ǅ ﬁ",
        "\U0001F600 x <|startoftext|> <|ENDOFTEXT|> a<|endoftext|>. end.", "a\u0301\u0323 \u0323x J\u030c \u01f0", "It's' (so'). x's, 's. A%%% b&&&; É***",
        None, LONG[:5000], *[t for _, t in ROWS if t and len(t) < 1000]]
    for path, cut in ((TOKENIZER, 1 << 20), (TOKENIZER, 90), (public_tokenizers.path("byte_bpe_50k.json"), 90)):
        encoder = tokens.Encoder(path, words_kept=50, slice_bytes=cut)
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]
        ids, sizes = encoder.batch(pa.array(odd))
        assert (encoder.words is None) == (path != TOKENIZER)
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        closed, sizes = encoder.closed(pa.array(odd), 1)
        assert closed.tolist() == [i for w in want for i in [*w, 1]] and sizes.tolist() == [len(w) + 1 for w in want]
        assert [len(a) for a in encoder.batch(pa.array([], pa.string()))] == [0, 0]


@pytest.mark.parametrize("high", [1, 2, 50, 49_408, 2**31, 2**60, 2**63])
@pytest.mark.parametrize("n", [0, 1, 59, 61, 16_383, 16_385, 40_000])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64)
    if high == 2**63:
        ids[::3] = rng.integers(0, 9, len(ids[::3]), dtype=np.uint64)
    words, offsets, escapes = tokenids.encode_ids(ids)
    assert (tokenids.decode_ids(words, offsets, escapes, n) == ids).all()
    assert len(escapes) == (ids >= 2**60).sum()


def test_token_files(spark, docs, empty):
    path = scratch_path(spark, "test-ids")
    tokenids.write_ids(docs, TOKENIZER, path, partitions=3)
    rows = sorted(tokenids.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 3, 4, 5, 6, 7]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 5)] == [1, 1, 1]
    nothing = scratch_path(spark, "test-ids")
    tokenids.write_ids(empty, TOKENIZER, nothing)
    assert tokenids.read_ids(spark, nothing).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, TOKENIZER, capacity=64).collect()
    full = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full.get(r["sequence_id"], 0) and r["length"] <= 64
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(full.values()) <= 64 and len({(r["doc_id"], r["piece"], r["offset"], r["sequence_id"]) for r in rows}) == len(rows)
    assert sum(r["doc_id"] == 3 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packing_holds_ids_of_few_texts(monkeypatch):
    """A batch is encoded in portions; pieces, places and ranks are those of the whole batch."""
    held = []

    class Watched(tokens.Encoder):
        def closed(self, texts, end_id):
            held.append(sum(len(t or "") for t in texts.to_pylist()))
            return super().closed(texts, end_id)

    made = Watched(TOKENIZER)
    monkeypatch.setattr(packing, "encoder", lambda path: made)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": staticmethod(lambda: 3)}))}))
    listed = [t for _, t in ROWS if t is None or len(t) < 100] * 40 + [LONG[:5000], None, "", "alpha beta"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(listed)), pa.int64()), "text": pa.array(listed, pa.string())})
    found = [pa.Table.from_batches(packing.cut_pieces(TOKENIZER, 64, 1, size)(iter([batch, batch.slice(0, 0)]))).to_pylist() for size in (1 << 30, 500)]
    assert found[0] == found[1] and len(found[0]) > len(listed)
    assert max(held[1:]) == 5000 and sorted(held[1:])[-2] <= 500


@pytest.mark.parametrize("seed", range(6))
def test_packing_plans_hold_every_length(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(rng.integers(1, 101, rng.integers(0, 3000)), minlength=101)
    if seed == 5:
        histogram[:] = 0
        histogram[51] = 10**12  # counts may be of any size, no two of these fit together
    runs = packing.best_plan(histogram, 100)
    held = np.zeros(101, np.int64)
    for count, lengths in runs:
        assert count > 0 and sum(lengths) <= 100
        for n in lengths:
            held[n] += count
    assert (held == histogram).all()
    used = sum(r.count for r in runs)
    assert used == 10**12 if seed == 5 else used <= -(-(histogram @ np.arange(101)) // 100) * 1.05 + 1


def test_golay_keys_meet_at_two_errors():
    patterns = [{int(p) for p in row if p >= 0} for row in golay.PATTERNS]
    errors = [0, *(1 << a for a in range(23)), *(1 << a | 1 << b for a, b in combinations(range(23), 2))]
    for e in errors:
        moved = int(golay.syndrome(np.array([e]))[0])
        assert all(any(p ^ e in patterns[s ^ moved] for p in patterns[s]) for s in range(2048))


def near_components(values, bits=4):
    label = {v: v for v in values}
    order = sorted(values)
    changed = True
    while changed:
        changed = False
        for a, b in combinations(order, 2):
            if (a ^ b).bit_count() <= bits and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("bucket, bits", [(2048, 4), (12, 4), (12, 3), (12, 0)])
def test_links_connect_like_brute_force(spark, bucket, bits):
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        for _ in range(30):
            v = base
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                v ^= 1 << b
            values.add(v)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    prints = spark.createDataFrame([(v, s) for v, s in ((float(i), s) for i, s in enumerate(signed.values()))], "doc_id double, fp long")
    got = {}
    for r in prints.join(simhash.classes(prints, max_bits=bits, bucket=bucket), "fp").collect():
        got.setdefault(r["component_id"], set()).add(r["fp"])
    want = {}
    for v, root in near_components(values, bits).items():
        want.setdefault(root, set()).add(signed[v])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5000)] + [(1, 0)] * 5
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(101)) and all(found[2000 + i] == 1000 for i in range(300)) and 5000 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[5] == {(0, 1)} and len(by[3]) == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 6, 7] and ids.count(None) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("bucket", [64, 2])
def test_pipeline_keeps_one_of_resembling_texts(spark, docs, empty, bucket):
    """All pairs of five-word Jaccard 0.8 or more are found, and no others are linked: brute force over edited copies."""
    rng, made = np.random.default_rng(8), []
    for base in range(12):
        words = [f"b{base}w{i}" for i in range(90)] + [f"common{i}" for i in range(30)]
        for _ in range(25):
            own = list(words)
            for at in rng.integers(0, len(own), rng.integers(0, 6)).tolist():
                own[at] = f"edit{rng.integers(10**9)}"
            made.append(" ".join(own))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in made]
    root = list(range(len(made)))
    for a, b in combinations(range(len(made)), 2):
        if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in resembling.keep_one(frame, bucket).collect())
    assert got == sorted(set(root)) and 12 < len(got) < len(made)
    if bucket == 64:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == got
    kept = resembling.keep_one(docs, bucket)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "7", "None"]
    assert resembling.keep_one(empty, bucket).count() == 0


def test_personal_data_forms():
    spans = lambda t: [t[s:e] for s, e, _ in pii.base_spans(t)]
    assert spans("a@b.c@d.e f@@g.h x.@y-.z. a@b.") == ["a@b.c", "x.@y-.z"]
    assert spans("1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4") == ["1.2.3.4", "5.6.7.8", "01.002.3.4"]
    assert spans("4111 1111 1111 1111 +1 (979) 555-6697") == ["4111 1111 1111 1111", "+1 (979) 555-6697"]
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@" * 1000) == []
    assert pii.masked("x a@b.c y", [(2, 7, 0), (3, 5, 1)]) == "x [EMAIL] y"


def test_contexts_discover_unseen_identifiers(spark, docs, empty):
    lines = [(i, f"Please write to mailbox user{i}@example.com every day, thanks number {i}") for i in range(12)]
    lines += [(100, "Please write to mailbox user77_at_example every day, thanks"), (101, "He saw user78_at_example on a wall"), (102, None), (103, "")]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    own = "Please write to mailbox user77_at_example every day, thanks"
    start = own.index("user77")
    assert [tuple(s) for s in found[100]["spans"]] == [(start, start + len("user77_at_example"), 0)] and found[100]["base"] == []
    assert not found[101]["spans"] and not found[102]["spans"] and not found[103]["spans"] and len(found[5]["spans"]) == 1
    rows = pii.find(docs).collect()
    assert len(rows) == len(ROWS)
    clean = pii.redact(spark.createDataFrame([(1, "mail a@b.co now", "x"), (1, "mail a@b.co now", "y"), (None, None, "z"), (None, "1.2.3.4", "w")],
                                             "doc_id long, text string, base string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["base"]) for r in clean.collect()) == [
        (0, "", "z"), (0, "[IP]", "w"), (1, "mail [EMAIL] now", "x"), (1, "mail [EMAIL] now", "y")]
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def test_grouped_and_spelt_out_identifiers_are_masked_in_full(spark):
    """Numbers in groups and spelt-out addresses are candidates as a whole, and no part of them stays."""
    cut = lambda t: [t[s:e] for s, e, _, whole in pii._identifiers(t, pii.base_spans(t), pii.Bootstrap()) if whole]
    assert cut("call 020 7946 0958, or (487) 555-7209. Page 3 - 4, in 1999. 20 were 4111 1111 1111 1112!") == [
        "020 7946 0958", "(487) 555-7209", "4111 1111 1111 1112"]
    assert cut("ask jane.doe at host dot com or al (at) sub.host.org, look at the dot") == ["jane.doe at host dot com", "al (at) sub.host.org"]
    assert cut("1.2.3.4 020 7946 0958 a@b.co") == ["020 7946 0958"] and cut("1 " * 100_000) == [] and cut("1" * 200_000 + " 2") == []
    phone, card, mail = "my direct telephone line {} before the next noon", "then charge card number {} for the whole sum", "please write to mailbox {} every single day"
    lines = [(i, phone.format(f"+1 (979) 555-{1000 + i}")) for i in range(20)]
    lines += [(20 + i, mail.format(f"user{i}@example.com")) for i in range(20)]
    lines += [(40 + i, card.format(c)) for i, c in enumerate(
        str(n) for n in range(4111111111110000, 4111111111110200) if pii._luhn(str(n)))]
    lines += [(100, phone.format("020 7946 0958")), (101, phone.format("(487) 555-7209")), (102, card.format("4111 1111 1111 1112")), (103, mail.format("name at host dot com")),
              (104, "there were 020 7946 0958 of them")]
    frame = spark.createDataFrame(lines, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert [clean[i] for i in range(100, 105)] == [phone.format("[PHONE]"), phone.format("[PHONE]"), card.format("[CARD]"), mail.format("[EMAIL]"), lines[-1][1]]
    assert all(len(r["spans"]) == 1 for r in pii.find(frame).filter("doc_id < 104").collect())


def test_subword_model_learns_and_shares_grams():
    rng = np.random.default_rng(0)
    filler = [f"{a}{b}" for a in ("lo", "mi", "ta", "ne", "ru") for b in ("ran", "tis", "vek", "pol")]
    made, labels = [], []
    for i in range(600):
        words = rng.choice(filler, 30).tolist()
        if i % 3 == 0:
            words[5] = ("grumblefitz", "grumblefits", "grumblefit")[i % 9 // 3]
        made.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = subwords.train(made, labels)
    clean, known, unseen = model.probabilities([" ".join(filler + filler[:10]), " ".join([*filler, "grumblefitz"]), " ".join([*filler, "grumblefix"])])[:, 1]
    assert clean < 0.3 < unseen and known > 0.5
    whole = model.logits([LONG * 3])
    subwords.CHUNK, kept = 5000, subwords.CHUNK
    assert np.allclose(whole, model.logits([LONG * 3]), atol=0.05)
    subwords.CHUNK = kept


def test_toxicity_edges(docs, empty):
    labels = docs.select("doc_id", F.when(F.col("doc_id") == 3, 1).otherwise(0).alias("toxic"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model, "doc_id").collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.remove_toxic(docs, model, 2.0).count() == len(ROWS) and toxicity.remove_toxic(docs, model, 0.0).count() == 0
    none = toxicity.fit(empty, labels.limit(0))
    assert [r["score"] for r in toxicity.score(docs, none, "doc_id").collect()] == [pytest.approx(0.5)] * len(ROWS)
    assert toxicity.score(empty, model, "doc_id").count() == 0


def test_language_edges(spark, docs, empty):
    rows = [(i, ("the cat and the dog are here " if i % 2 else "der hund und die katze sind hier ") * 3, "en" if i % 2 else "de") for i in range(200)]
    rows += [(500, None, "en"), (501, "the same again", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(
        [(1, "the dog and the cat"), (2, "die katze und der hund"), (3, None), (4, ""), (5, "12 - 34 !"), (6, "é"), (7, "½ ² ①"), (8, "_ª_")], "doc_id long, text string"), model, "doc_id", keep_rejected=True).collect()}
    assert [found[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and found[6]["lang_pred"] in ("en", "de")
    assert found[7]["lang_pred"] == "und" and found[7]["score"] == 0 and found[8]["lang_pred"] in ("en", "de")
    assert 0 < model.reject <= 1 and all(found[i]["rejected"] for i in (3, 4, 5, 7)) and not found[1]["rejected"] | found[2]["rejected"]
    assert {r["lang_pred"] for r in langid.identify(docs.limit(0).unionByName(docs.filter("doc_id = 2")), model, "doc_id").collect()} == {"und"}
    strict = langid.identify(docs, model, "doc_id", reject_below=1.01)
    assert {r["lang_pred"] for r in strict.collect()} == {"und"} and strict.count() == len(ROWS)
    none = langid.fit(empty.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, none, "doc_id").collect()} == {"und"}


def test_samples_are_bounded_by_rows_and_know_every_class(spark):
    """A chosen id on thousands of rows gives one text; a class of 3 in 10,000 has its part, and shares correct for it."""
    docs = spark.range(10_000).select((F.col("id") % 2000).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.range(5000).select(F.lit(7).cast("long"), F.lit("again")))
    answers = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") < 3).cast("int").alias("answer"))
    found, shares = toxicity.sample_texts(docs, answers, 100)
    assert sorted({y for y, _ in found}) == [0, 1] and sum(y for y, _ in found) == 3 and len(found) == 53
    assert shares[1] == pytest.approx((3 / 2000) / (3 / 53)) and shares[0] == pytest.approx((1997 / 2000) / (50 / 53))
    only, _ = toxicity.sample_texts(docs, answers.filter("doc_id = 7"), 1)
    assert len(only) == 1
    model = subwords.Model([0, 1], np.zeros((1 << 10, 2), np.float32), np.log([0.5, 0.5]), 10)
    model.weigh({0: 1.5, 1: 0.5})
    assert model.probabilities([""])[0] == pytest.approx([0.75, 0.25])
    assert toxicity.sample_texts(docs, answers.limit(0), 5) == ([], {})


def test_registered_domains(spark):
    want = {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.example.org": ("example.org", "org"),
        "localhost": ("localhost", "localhost"), "": ("", ""), "me:pw@www.example.com:8080": ("example.com", "com"), "192.168.3.4:80": ("192.168.3.4", "192.168.3.4"), "[::1]:9": ("[::1]", "[::1]")}
    rows = spark.createDataFrame([(h,) for h in want], "host string").select(
        "host", urlfilter.registered_domain(F.col("host")).alias("d"), urlfilter.suffix_of(F.col("host")).alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in rows} == want


def test_late_edits_reach_their_message(spark):
    log = [(1, 1, "message", "user", "hi", 1), (1, 2, "message", "assistant", None, 2), (1, 3, "delta", None, "wrong", 2), (1, 4, "message", "user", "and", 3),
           (1, 5, "edit", None, "hello", 1), (1, 6, "regenerate", None, None, 2), (1, 7, "delta", None, "ri", 2), (1, 8, "delta", None, "ght", 2), (1, 9, "edit", None, "lost", 9)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, message long")
    found = {r["position"]: (r["role"], r["text"]) for r in chat.fold_events(events).collect()}
    assert found == {1: ("user", "hello"), 2: ("assistant", "right"), 3: ("user", "and")}


def test_made_logs_take_every_branch(spark):
    turns = spark.range(300).select((F.col("id") % 20).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("text of turn "), F.col("id").cast("string")).alias("text"))
    events = chat.events_from_turns(turns)
    kinds = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert kinds["message"] == 300 and kinds["edit"] > 50 and kinds["regenerate"] > 50
    folded = chat.fold_events(events).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("t")).collect()
    assert all([m["text"] for m in r["t"]] == [f"text of turn {r['conv_id'] + 20 * k}" for k in range(15)] for r in folded)


def test_chat_events(spark):
    log = [
        (1, 1, "delta", None, "lost"), (1, 2, "message", "user", "Hi <s>[x]</s> &amp; &lt;"), (1, 3, "message", "assistant", "A"), (1, 4, "delta", None, "B"),
        (1, 5, "regenerate", None, None), (1, 6, "delta", None, "C"), (1, 7, "delta", None, None), (1, 8, "delta", None, "D"), (1, 9, "unknown", None, "E"),
        (2, 1, "message", None, None), (2, 2, "edit", None, "new"), (2, 3, "delta", None, "er"), (None, 1, "message", "user", "no id")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string").withColumn("position", F.lit(9)).withColumn("step", F.lit(1))
    folded = {(r["conv_id"], r["position"]): (r["role"], r["text"]) for r in chat.fold_events(events).collect()}
    assert folded == {(1, 1): ("user", "Hi <s>[x]</s> &amp; &lt;"), (1, 2): ("assistant", "CD"), (2, 1): ("", "newer"), (None, 1): ("user", "no id")}
    out = chat.format_chats(events)
    rows = {r["conv_id"]: r for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert [tuple(t) for t in rows[1]["turns"]] == [("user", "Hi <s>[x]</s> &amp; &lt;"), ("assistant", "CD")] and rows[1]["loss"] == "CD" and rows[2]["loss"] == ""
    assert chat.format_chats(events.limit(0)).count() == 0


def test_repeated_turns_are_turns_of_their_own(spark):
    turns = spark.createDataFrame([(1, 0, "user", "same text"), (1, 0, "user", "same text"), (1, None, None, None), (1, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(chat.events_from_turns(turns)).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [tuple(t) for t in row["t"]] == [("", ""), ("user", "same text"), ("user", "same text"), ("assistant", LONG)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, docs, empty, limit):
    items = spark.createDataFrame([(1, "Alpha-BETA gamma"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (3, None), (4, "..."), (None, "zulu"), (5, "alpha beta gamma")], "item_id long, text string")
    texts_ = spark.createDataFrame([
        (1, "x alpha, beta; gamma alpha beta gamma"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (4, None), (5, "zulu Zulu"), (5, "zulu Zulu"), (6, "")],
        "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit(1))
    rows = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.scan(texts_, items, broadcast_windows=limit).collect())
    assert rows == [(1, 7, 6, ("1", "5")), (2, 12, 11, ("2",)), (3, 9, 0, ()), (4, 0, 0, ()), (5, 2, 2, ()), (5, 2, 2, ()), (6, 0, 0, ())]
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(texts_, items).collect()) == [3, 4, 6]
    assert decontaminate.scan(docs, items.limit(0)).filter("n_hit > 0").count() == 0 and decontaminate.scan(empty, items).count() == 0
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == len(ROWS)


def test_url_filters(spark):
    pages = spark.createDataFrame(
        [(1, "http://WWW.Good.com/a?b"), (2, "https://bad.com#x"), (3, "no scheme"), (4, None), (None, "http://bad.com/q"), (2, "https://bad.com#x"), (5, "a://b://c/d\n?e"), (6, "http://sub.bad.com/ok/1")],
        "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("bad", F.lit(1))
    outcomes = spark.createDataFrame([(2, 1), (2, 0), (1, 0), (4, None)], "page_id long, bad int")
    rules = [urlfilter.Rule("bad.com", "/", "block"), urlfilter.Rule("bad.com", "/ok", "allow")]
    rows = sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, outcomes, rules).collect()), key=str)
    assert [r[:4] for r in rows] == [
        (0, "bad.com", "/q", "bad.com/"), (1, "www.good.com", "/a", None), (2, "bad.com", "", None), (2, "bad.com", "", None), (3, "", "", None), (4, "", "", None),
        (5, "b:", "//c/d\n", None), (6, "sub.bad.com", "/ok/1", "bad.com/ok")]
    assert rows[0][4] == "block" and rows[-1][4] == "allow"
    assert urlfilter.filter_urls(pages, outcomes.limit(0)).count() == 8 and urlfilter.filter_urls(pages.limit(0), outcomes).count() == 0


def test_host_reputation_shrinks_towards_its_domain(spark):
    hosts = spark.createDataFrame([("a.x.com", 200, 190), ("b.x.com", 0, 0), ("c.y.com", 200, 2), ("d.y.com", 1, 1), ("", 0, 0)], "host string, seen long, bad long")
    rated = {r["host"]: r for r in urlfilter.reputations(hosts).collect()}
    assert rated["b.x.com"]["mean"] > 0.5 > rated["d.y.com"]["bound"] and rated["c.y.com"]["mean"] < 0.05
    assert rated["a.x.com"]["bound"] > 0.9 and rated[""]["bound"] < rated[""]["mean"]


def test_sketches(spark, docs, empty):
    rows = {}
    for r in sketches.edited_likeness(docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == len(ROWS) and rows[1][0]["own"] == [] and rows[3][0]["own"] == rows[3][1]["own"]
    # 7 is the last id, so a null id comes after it; the first of these has a null text.
    assert rows[7][0]["edited"] == LONG[:len(LONG) - len(LONG) // 4]
    assert sketches.edited_likeness(empty).count() == 0
    one = sketches.edited_likeness(docs.filter("doc_id = 6")).first()
    text = ROWS[-1][1]
    assert one["edited"] == text[:len(text) - len(text) // 4] + text[:len(text) // 4]


def test_next_rows_cross_range_bounds(spark):
    ids = [i * i for i in range(300)] + [9, 10**12]
    frame = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["next"]["text"]) for r in sketches.with_next(frame, ["text"], range_rows=7).orderBy("doc_id", "text").collect()]
    assert len(got) == len(ids) and [t for _, _, t in got] == [t for _, t, _ in got[1:]] + [got[0][1]]


def test_sketch_algebra(spark):
    words = [f"w{i}" for i in range(3000)]
    row = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]), " ".join(words[:1000]))], "a string, b string, c string").select(
        *[sketches.sketch(sketches.shingle_hashes(F.col(c)), 512).alias(c) for c in "abc"])
    got = row.select(
        sketches.resemblance(F.col("a"), F.col("b"), 512).alias("near"), sketches.containment(F.col("c"), F.col("a"), 512).alias("inside"),
        sketches.distinct_count(F.col("a"), 512).alias("n"), sketches.merge(F.col("a"), F.col("c"), 512).alias("m"), "a").first()
    assert abs(got["near"] - 1 / 3) < 0.08 and got["inside"] > 0.8 and abs(got["n"] - 1996) < 300 and got["m"] == got["a"]
    union = row.select(F.explode(F.array("a", "b")).alias("s")).agg(sketches.merged_sketch(F.col("s"), 512).alias("u")).first()["u"]
    assert union == sorted(set(got["a"]) | set(row.first()["b"]))[:512] and hashlib.sha256(str(union).encode()).hexdigest()


def test_a_written_table_leaves_no_shuffle_files(spark):
    """What a plan shuffled is deleted with its end, also while the plan is still referred to (F1)."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().toSet()
    plan = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    table = session.cut_lineage(plan, "counts")
    left = disk.getAllFiles().toSet().diff(before).mkString(" ")
    assert "shuffle_" not in left and table.count() == 7 == plan.count()
    assert spark.conf.get(session.CLEANUP) == "false"


def test_texts_are_shuffled_once_to_keep_one_of_equal_rows(spark):
    """Equal rows meet in the shuffle that the join with the kept rows needs (F1)."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (1, base), (2, base + " end"), (None, "other words of a text that stands alone"), (None, "other words of a text that stands alone"), (4, None), (5, "")]
    kept = resembling.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_row") == 2  # one of the texts, one of the kept rows
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == [(False, 1, base), (False, 4, None), (True, 0, "other words of a text that stands alone")]
