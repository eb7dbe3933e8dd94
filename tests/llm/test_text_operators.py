import hashlib
import json
import random
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visiontables.llm import fingerprints, language, licenses, packing, quality_rules, toxicity, words

# ---- words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBé \n\t\r.\x00中", max_size=12), max_size=8))
def test_scan_finds_each_word(texts):
    want = [[words.hash_word(w) for w in plain.WORD(t.translate(plain.ASCII_LOWER))] for t in texts]
    got = [w.tolist()[b[k]:b[k + 1]] for low, high, w, b in words.scan(pa.array(texts, pa.string())) for k in range(high - low)]
    assert got == want


def test_scan_of_long_texts_in_segments(monkeypatch):
    texts = ["ab cd", "x" * 50 + " " + "y" * 3, None, "é " * 40, "z" * 200]
    whole = [w.tolist() for _, _, w, _ in words.scan(pa.array(texts))]
    monkeypatch.setattr(words, "SEGMENT", 16)
    cut = [w.tolist() for _, _, w, _ in words.scan(pa.array(texts))]
    assert sum(whole, []) == sum(cut, [])


# ---- quality rules


def test_quality_measures_match_plain_version(spark, documents, odd):
    for docs in (documents, odd):
        rows = quality_rules.quality_measures(docs).collect()
        want = sorted((repr(plain.base_rule(r["text"])) for r in docs.collect()))
        assert sorted(repr((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in rows) == want
        assert all(not r["kept"] for r in rows if r["base_failed"])


def test_quality_verdicts(spark):
    noise = random.Random(1)
    words_ = ["".join(noise.choices("abcdefghijklmnopqrstuvwxyz", k=noise.randint(2, 9))) for _ in range(400)]
    prose = " ".join(noise.choices(words_, [1 / (k + 1) for k in range(400)], k=900))
    junk = " ".join("".join(chr(noise.randint(0x4e00, 0x9000)) for _ in range(9)) for _ in range(300))
    texts = {"prose": prose, "repetitive": " ".join(f"{w} {w} {w} {w} {w} {w} {w} {w} {w} {w}" for w in words_[:80]), "junk": junk}
    got = {r["doc_id"]: r for r in quality_rules.quality_measures(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got["prose"]["kept"] and not got["repetitive"]["kept"]
    assert quality_rules._verdict(5000, 0.99, 3, 0, 0) == "incompressible" and quality_rules._verdict(5000, 0.1, 3, 0, 0) == "repetitive"
    assert quality_rules._verdict(5000, 0.5, 4, 2, 0) == "repetitive chunks" and quality_rules._verdict(5000, 0.5, 4, 0, 2) == "incompressible chunks" and quality_rules._verdict(5000, 0.5, 4, 1, 1) is None


def test_quality_keeps_rows_whole(documents, odd, none):
    kept = quality_rules.keep_good(documents)
    assert kept.columns == documents.columns
    want = {r["doc_id"] for r in quality_rules.quality_measures(documents).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and want
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.quality_measures(none).count() == 0


# ---- packing


def _check_packing(docs, out, capacity=packing.CAPACITY):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, s, len(ids[s:s + capacity]), zlib.crc32(np.asarray(ids[s:s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    rows = out.collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_packing_is_exact_and_tight(documents, odd, none):
    n, total = _check_packing(documents, packing.pack_documents(documents))
    assert n <= 1.02 * total / packing.CAPACITY + 1
    _check_packing(odd, packing.pack_documents(odd))
    assert packing.pack_documents(none).count() == 0


def test_packing_merges_in_rounds(documents):
    many = documents.repartition(20)
    n, total = _check_packing(many, packing.pack_documents(many, items_per_task=40))
    alone, _ = _check_packing(many, packing.pack_documents(many))
    assert alone <= n <= 1.1 * total / packing.CAPACITY + 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit([(s, k) for k, s in enumerate(sizes)], 20)
    assert sorted(sum(bins, [])) == list(range(len(sizes)))
    loads = sorted(sum(sizes[k] for k in b) for b in bins)
    assert all(x <= 20 for x in loads) and (len(loads) < 2 or loads[0] + loads[1] > 20)


def test_words_encode_as_texts_do():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    texts = ["It's A'S don't x1y2", "İI ǅ ß ẞ ÀÈ- ..a.. <|endoftext|> Σας 中文", "", None, "scum, scum; SCUM!", "\x1c a\x1d\x85b c"]
    for _ in range(2):
        for text, ids in zip(texts, encoder.texts(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == fresh.encode(text or "", add_special_tokens=False).ids


# ---- fingerprints


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
def test_fingerprints_of_edits(spark, documents, odd, rows_per_range):
    twins = spark.createDataFrame([(5, "b b b"), (5, "a a a"), (9, None), (1, "c"), (None, "n")], "doc_id long, text string")
    for docs in (documents, odd, twins, documents.limit(1)):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-(r[0] if r[0] is not None else -1 << 62), r[1] or "", r[1] is not None))
        texts = [r[1] or "" for r in rows]
        want = []
        for k, t in enumerate(texts):
            after = texts[(k + 1) % len(texts)]
            half = len(t) // 2
            edited = (t[:len(t) - half] + after[:half]).encode()
            a, b, c = (fingerprints.digest(x) for x in (t.encode(), edited, after.encode()))
            want.append((rows[k][0], len(t), hashlib.sha256(edited).hexdigest(), fingerprints.shown(a), fingerprints.shown(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
        assert sorted(map(repr, map(tuple, fingerprints.fingerprint_edits(docs, rows_per_range).collect()))) == sorted(map(repr, want))


def test_fingerprint_likeness(spark, documents, none):
    rows = fingerprints.fingerprint_edits(documents).collect()
    near = np.asarray([(r["near_edited"], r["near_next"]) for r in rows if r["n_chars"] > 300])
    assert ((near >= 0) & (near <= 1)).all() and (near[:, 0] > near[:, 1]).mean() > 0.95
    assert fingerprints.likeness(fingerprints.digest(b""), fingerprints.digest(b"")) == 1 and fingerprints.parsed(fingerprints.shown(b"\x00\xff\x10")) == b"\x00\xff\x10"
    two = spark.createDataFrame([("one text", "one text"), (None, ""), ("a", None)], "a string, b string")
    got = two.select(fingerprints.fingerprint_likeness(fingerprints.fingerprint("a"), fingerprints.fingerprint("b"))).collect()
    assert got[0][0] == 1 and got[1][0] == 1
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_likeness_of_short_texts():
    draw = np.random.default_rng(5)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    for words in (1, 2, 5, 10, 20, 100, 500):
        unrelated, edited = [], []
        for _ in range(40):
            a, b = [word() for _ in range(words)], [word() for _ in range(words)]
            own = fingerprints.digest(" ".join(a).encode())
            unrelated.append(fingerprints.likeness(own, fingerprints.digest(" ".join(b).encode())))
            edited.append(fingerprints.likeness(own, fingerprints.digest(" ".join([*a[:-1], b[0]] if words > 1 else a).encode())))
            assert fingerprints.likeness(own, own) == 1
        assert np.mean(unrelated) < 0.25 and np.mean(edited) > np.mean(unrelated) + (0.3 if words > 2 else 0), words
    few = [fingerprints.digest(t) for t in (b"", b"a", b"abcde")]
    assert [[fingerprints.likeness(a, b) for b in few] for a in few] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


# ---- licences


def _plain_base(text):
    own = licenses.tokens(text or "")
    found = {}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found.setdefault(label, []).extend(k for k in range(len(own) - len(p) + 1) if own[k:k + len(p)] == p)
    places = sorted(x for v in found.values() for x in v)
    return len(own), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(k for k, v in found.items() if v))


def test_license_base_matches_plain_version(spark, documents, odd):
    tricky = spark.createDataFrame([(1, "MIT-License mit license"), (2, "the MIT\nLICENSE, Apache   license; general public-license"), (3, "mité license mit licenses"), (4, "gnu general public license v2 general public license")], "doc_id long, text string")
    for docs in (documents, odd, tricky):
        rows = licenses.scan_licenses(docs).collect()
        got = sorted(repr((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows)
        assert got == sorted(repr(_plain_base(r["text"])) for r in docs.collect())
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_license_spans(spark, none):
    mit = licenses.TEMPLATES["mit"][0].split()
    texts = ["lorem " + " ".join(mit) + " ipsum", "lorem " + " ".join(mit[:12] + ["odd", "words"] + mit[12:]), "Redistribution and use in source and binary forms are nice", "All rights reserved. All rights reserved.", "the of the and or to"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0]["labels"] == rows[1]["labels"] == "mit" and rows[0]["score"] == 1 and rows[1]["score"] == 1
    assert rows[0]["spans"][0]["first_word"] == 1 and rows[0]["spans"][0]["last_word"] == len(licenses.tokens(" ".join(mit)))
    assert rows[2]["labels"] == "" and 0 < rows[2]["score"] < licenses.COVERED
    assert rows[3]["labels"] == "all-rights-reserved" and [s["first_word"] for s in rows[3]["spans"]] == [0, 3]
    assert rows[4]["labels"] == "" and rows[4]["score"] == 0
    assert licenses.scan_licenses(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=15))
def test_suffix_automaton(sequences, stream):
    known = {tuple(s[a:b]): {(k, b - 1)} for k, s in enumerate(sequences) for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    for k, s in enumerate(sequences):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                known[tuple(s[a:b])].add((k, b - 1))
    made = licenses.SuffixAutomaton(sequences)
    for at, (state, length) in enumerate(made.statistics(stream)):
        want = max([n for n in range(at + 2) if n == 0 or tuple(stream[at + 1 - n:at + 1]) in known])
        assert length == want and (not length or made.ends[state] == known[tuple(stream[at + 1 - length:at + 1])])


def test_quality_chunks_cover_the_text():
    """Noise in a last piece of less than half a chunk counts: every byte of a longer text is in a chunk."""
    rng = random.Random(5)
    prose = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(900)).encode()[:2048].decode()
    noise = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n // 3))
    got = quality_rules.measure(pa.array([prose[:1000] + " " + prose[:1000] + " " + noise(950), prose[:2048], prose + "a", prose * 2])).to_pylist()
    assert [r["n_chunks"] for r in got] == [2, 1, 2, 2]
    mixed = quality_rules.measure(pa.array(["ab " * 1000 + noise(950), prose + " " + "x" * 1020])).to_pylist()
    assert [r["n_chunks"] for r in mixed] == [2, 2]
    assert mixed[0]["n_low_chunks"] == 1 and mixed[1]["n_chunks"] == 2


# ---- toxicity


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(3)
    text = rng.choice(list(b"abc "), 400).astype(np.uint8)
    all_grams = toxicity.grams(text, 3)
    levels = []
    keys, counts = np.unique(all_grams, return_counts=True)
    for n in (3, 2, 1):
        levels.insert(0, toxicity._Level(keys, counts.astype(float)))
        keys, counts = np.unique(keys & toxicity._mask(n - 1), return_counts=True)
    for context in (b"ab", b"c ", b"zz"):
        base = (context[0] << 16) | (context[1] << 8)
        every = np.arange(256, dtype=np.uint64) + np.uint64(base)
        p = np.full(256, 1 / 256)
        for n, level in enumerate(levels, 1):
            p = level.probability(every & toxicity._mask(n), p)
        assert abs(p.sum() - 1) < 1e-9


def test_toxicity_ratios_match_plain_version():
    rng = np.random.default_rng(5)
    n = 5
    texts = [rng.choice(list(b"abcde fgh"), 300, p=[.2, .2, .1, .1, .1, .1, .1, .05, .05]).astype(np.uint8) for _ in range(6)]
    texts[0][50:55] = list(b"hghgh")
    count = lambda own, k: dict(zip(*np.unique(np.concatenate([toxicity.grams(t, k) for t in own]), return_counts=True), strict=True))
    toxic, ordinary = count(texts[:2], n), count(texts[2:4], n)

    def kinds(table, k):
        out = {}
        for key in table:
            low = int(key) & ((1 << (8 * k)) - 1)
            out[low] = out.get(low, 0) + 1
        return out

    shared, below = [], count(texts, n - 1)
    for k in range(n - 2, 0, -1):
        below = kinds(below, k)
        shared.insert(0, below)

    def p(levels, key, k):
        if k == 0:
            return 1 / 256
        low = int(key) & ((1 << (8 * k)) - 1)
        context = {w: c for w, c in levels[k - 1].items() if int(w) >> 8 == low >> 8}
        lower = p(levels, key, k - 1)
        if not context:
            return lower
        return (max(levels[k - 1].get(low, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(context) * lower) / sum(context.values())

    models = [[*shared, kinds(own, n - 1), {int(k): v for k, v in own.items()}] for own in (toxic, ordinary)]
    keys = np.unique(np.asarray([*toxic, *ordinary], dtype=np.uint64))
    pair = lambda t: np.asarray([t.get(k, 0) for k in keys.tolist()])
    toxic, ordinary = ({int(k): v for k, v in t.items()} for t in (toxic, ordinary))
    table = lambda t: (np.asarray(sorted(t), dtype=np.uint64), np.asarray([t[k] for k in sorted(t)], dtype=float))
    made = toxicity.ratios(keys, pair(toxic), pair(ordinary), [table(t) for t in shared], n)
    tried = np.concatenate([toxicity.grams(t, n) for t in texts])
    want = [np.log(p(models[0], k, n) / p(models[1], k, n)) for k in tried.tolist()]
    assert np.allclose(made.of(tried, n), want)


def test_toxicity_features_in_segments(monkeypatch):
    model = toxicity.Ratios((np.asarray([1], np.uint64), np.asarray([0.0])), (np.zeros(0, np.uint64), np.zeros(0)), None)
    monkeypatch.setattr(toxicity.Ratios, "of", lambda self, keys, n: (keys % np.uint64(7)).astype(float))
    data = np.frombuffer(b"some text that goes on and on, with marks; and so on " * 9, dtype=np.uint8)
    whole = toxicity.features(data, model)
    monkeypatch.setattr(toxicity, "SEGMENT", 40)
    assert np.allclose(whole, toxicity.features(data, model))


def test_toxicity_models_count_all_labels(spark):
    """The joined ratios are those of the model in memory, and each labelled document of folds 1 to 3 is counted."""
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choices("abcd", k=4)) for _ in range(12)), int(k % 3 == 0)) for k in range(90)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int")
    taught = [(np.frombuffer(t.encode(), np.uint8), x) for k, t, x in rows if zlib.crc32(str(k).encode()) % 5 in (1, 2, 3)]
    keys = np.unique(np.concatenate([toxicity.grams(t) for t, _ in taught]))
    pair = [np.bincount(np.searchsorted(keys, np.concatenate([toxicity.grams(t) for t, x in taught if x == c])), minlength=len(keys)) for c in (1, 0)]
    classes = toxicity.class_counts(docs, marks)
    got = sorted((r["gram"], r["toxic"], r["ordinary"]) for r in classes.collect())
    assert got == list(zip(keys.tolist(), pair[0].tolist(), pair[1].tolist(), strict=True))
    all_grams = np.unique(np.concatenate([toxicity.grams(np.frombuffer(t.encode(), np.uint8)) for _, t, _ in rows]))
    shared, below = [], np.unique(all_grams & toxicity._mask(4))
    start = below
    for k in (3, 2, 1):
        below, counts = np.unique(below & toxicity._mask(k), return_counts=True)
        shared.insert(0, (below, counts.astype(float)))
    model = toxicity.ratios(keys, *pair, shared)
    frame = lambda x: spark.createDataFrame([(int(k),) for k in x], "gram long")
    joined = {r["gram"]: r["ratio"] for r in toxicity.gram_ratios(frame(all_grams), classes, frame(start)).collect()}
    assert np.allclose([joined.get(int(k), 0.0) for k in all_grams], model.of(all_grams, 5))
    # fewer rows for the weights leave the class models, and with them the ratios, as they are
    few, many = ({r["doc_id"]: r["mean_ratio"] for r in toxicity.score_toxicity(docs, marks, most).collect()} for most in (5, 1000))
    assert few == pytest.approx(many) and any(many.values())
    want = {k: toxicity.features(np.frombuffer(t.encode(), np.uint8), model)[0] for k, t, _ in rows}
    assert many == pytest.approx(want)


def test_toxicity_finds_held_out(spark, none, odd, labels):
    rng = random.Random(7)
    plain_words, bad = ["lamp", "river", "stone", "walk", "green", "paper", "music", "table", "under", "seven"], ["zorkig", "vlumpa", "zorkeln"]
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        words_ = [rng.choice(plain_words) for _ in range(60)]
        for _ in range(3 * toxic):
            words_[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(words_), int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1, x) for k, _, x in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score_toxicity(none, labels).count() == 0
    edge = toxicity.score_toxicity(odd, marks.unionAll(marks)).collect()
    assert len(edge) == odd.count() and all(0 <= r["score"] <= 1 for r in edge)
    nothing = toxicity.score_toxicity(docs.limit(5), marks.limit(0)).collect()
    assert {r["predicted"] for r in nothing} == {0}


# ---- language


def test_language_held_out(documents):
    rows = language.identify_language(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}


def test_language_edges(spark, documents, odd, none):
    both = documents.select("doc_id", "text", "lang").unionAll(odd.select(F.col("doc_id") + 1_000_000, "text", F.lit(None).cast("string")))
    got = {r["doc_id"]: r for r in language.identify_language(both).where("doc_id >= 1000000 or doc_id is null").collect()}
    for k in (1_000_000, 1_000_001, 1_000_002, 1_000_006, 1_000_007):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
    assert got[1_000_005]["lang_pred"] != "und"
    assert language.identify_language(none).count() == 0
    alone = language.identify_language(documents.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in alone} == {"und"}
    assert all(len(v) <= 500 for v in language.dictionaries(documents, size=500, sampled=3).values())
    json.dumps(sorted(language.dictionaries(documents, size=500, sampled=3)))
