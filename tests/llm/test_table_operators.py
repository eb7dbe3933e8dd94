import random

import corpus_pipeline
import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visiontables.llm import components, jaccard, mixing, packing, quality_classifier, quality_rules, urls
from visiontables.llm.logistic import fit
from visiontables.llm.queries import ORACLES

# ---- components


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "a long, b long").select(F.lpad(F.col("a").cast("string"), 4, "0").alias("a") if kind == "string" else "a", F.lpad(F.col("b").cast("string"), 4, "0").alias("b") if kind == "string" else "b")
    got = {int(r["node"]): int(r["root"]) for r in components.components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == plain.union({n for e in real for n in e}, real)
    assert components.components(df.limit(0)).count() == 0


# ---- n-gram Jaccard join


def _near(rng, n_docs, copies):
    vocabulary = [f"v{k}" for k in range(200)]
    rows = []
    for _ in range(n_docs):
        base = rng.choices(vocabulary, k=rng.choice((2, 4, 12, 30, 80, 200)))
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += rng.choices(vocabulary, k=rng.randint(1, max(1, len(own) // 12)))
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def _as_map(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(("n", "percent", "task"), [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 80, 300)])
def test_similarity_components(spark, documents, n, percent, task):
    rows = _near(random.Random(n * percent), 40, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _as_map(jaccard.similarity_components(docs, n, percent, task, 20_000 if task > 300 else 5)) == plain.similar(rows, n, percent)
    if task > 300:
        assert _as_map(jaccard.similarity_components(documents, n, percent)) == plain.similar([(r["doc_id"], r["text"]) for r in documents.collect()], n, percent)


def test_large_clusters_settle_by_their_hub(spark):
    """One cluster far beyond a task: near copies of one text, and a chain that only its neighbours link."""
    words = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(w if i != k % 120 else f"n{k}" for i, w in enumerate(words))) for k in range(60)]
    rows += [(100 + k, " ".join(words[:-3 * k or None] + [f"c{j}" for j in range(3 * k)])) for k in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _as_map(jaccard.similarity_components(docs, 3, 90, 900, 12)) == plain.similar(rows, 3, 90)


@pytest.mark.parametrize("few", [2, 64])
def test_chained_cluster_meets_in_its_keys(spark, monkeypatch, few):
    """Neighbours share a passage, so chance makes one cluster of all; documents are dealt out by keys and not to each other's tiles."""
    passage = lambda k: [f"p{k}w{j}" for j in range(10)]
    rows = [(k, " ".join(passage(k) + passage(k + 1))) for k in range(240)]
    rows += [(1000 + k, " ".join(passage(k % 8 * 30) + [f"u{k}x{j}" for j in range(10)])) for k in range(64)]
    rows += [(2000 + k, " ".join([f"n{k}", *passage(5 * k)[1:], *passage(5 * k + 1)])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, pairs = [], jaccard._pairs
    monkeypatch.setattr(jaccard, "FEW", few, raising=False)
    monkeypatch.setattr(jaccard, "_pairs", lambda tasks, *more: dealt.append(tasks.count()) or pairs(tasks, *more))
    assert _as_map(jaccard.similarity_components(docs, 3, 70, 2_000_000, 12)) == plain.similar(rows, 3, 70)
    assert sum(dealt) < 20 * len(rows)


def test_many_points_lose_no_link():
    """Families of near copies that stars connect, others at the limit, and loners, with and without parts known before."""
    rng = np.random.default_rng(7)
    families = [rng.choice(1 << 40, int(size), replace=False).astype(np.uint64) for size in (60, 61, 64, 200, 300)]
    sets = [np.sort(np.concatenate((f[int(rng.integers(0, 9)):], rng.choice(1 << 40, int(rng.integers(0, 5))).astype(np.uint64)))) for f in families for _ in range(50)]
    sets += [np.sort(rng.choice(1 << 40, int(rng.integers(1, 90))).astype(np.uint64)) for _ in range(60)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (both := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 90 * (len(sets[i]) + len(sets[j]) - both)]
    everything = range(len(sets))
    assert plain.union(everything, jaccard.linked(sets, 90)) == plain.union(everything, pairs)
    known = np.where(np.arange(len(sets)) % 5 == 0, len(sets), np.arange(len(sets)))
    as_pairs = [(i, 0) for i in everything if i % 5 == 0]
    assert plain.union(everything, jaccard.linked(sets, 90, known) + as_pairs) == plain.union(everything, pairs + as_pairs)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([70, 80, 90]))
def test_linked_sets_share_a_key(seed, percent):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 120))
    a = rng.choice(1 << 40, size, replace=False).astype(np.uint64)
    gone = int(rng.integers(0, size * (100 - percent) // (100 + percent) + 1))
    b = np.concatenate((a[gone:], rng.choice(1 << 40, gone, replace=False).astype(np.uint64) + np.uint64(1 << 41)))
    if rng.random() < 0.5:
        b = b[:max(1, len(b) - int(rng.integers(0, 3)))]
    both = len(np.intersect1d(a, b))
    if 100 * both < percent * (len(a) + len(b) - both):
        return
    one, other = np.sort(a), np.sort(b)
    common = np.sort(rng.choice(a, int(size * rng.choice((0, 0.2, 0.9, 1))), replace=False))
    keys = [set(jaccard.keys_of(s, np.asarray([0, len(s)]), percent, common)[0].tolist()) for s in (one, other)]
    same = jaccard.class_of(one, np.asarray([0, len(one)]))[0] == jaccard.class_of(other, np.asarray([0, len(other)]))[0]
    assert same or keys[0] & keys[1]


def test_tree_loses_no_link():
    rng = np.random.default_rng(4)
    bases = [rng.choice(1 << 40, 60, replace=False).astype(np.uint64) for _ in range(30)]
    sets = [np.sort(np.concatenate((b[int(rng.integers(0, 5)):], rng.choice(1 << 40, 2).astype(np.uint64)))) for b in bases for _ in range(12)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (both := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    assert plain.union(range(len(sets)), jaccard.linked(sets, 80)) == plain.union(range(len(sets)), pairs)


def test_similarity_edges(spark, odd, none):
    got = sorted(jaccard.similarity_components(odd, 3, 90).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[11]["component_id"] == by[10]["component_id"] == 10 and by[0]["n_shingles"] == 0 and by[0]["component_id"] == 0
    assert by[None]["component_id"] is None and by[None]["n_shingles"] == 1
    assert jaccard.similarity_components(none).count() == 0
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "1", "2", "None", "4", "5", "6", "7", "8", "9", "10", "12", "13"])
    with pytest.raises(ValueError):
        jaccard.similarity_components(odd, 3, 50)


# ---- URL filters


def test_url_edges(spark):
    rows = [(1, "http://a.net/es/x", None), (2, "http://b.org/1", '<link rel="canonical" href="https://a.net/es/x#t">'),
            (3, "http://c.org/?utm_a=1&utm_b&k=2#q", "<META http-equiv='Refresh' content='0; url=http://b.org/1'>"), (4, "http://d.org", '<link href=http://k.example.com/en/q rel="x canonical">'),
            (5, "nothing", None), (None, None, "<link>"), (6, "http://e.org/p", "<link rel=canonical href=http://www.example.com/en/><link rel=canonical href=http://d.org>"),
            (7, "HTTP://C.ORG/?k=2", ""), (8, "x://www.EXAMPLE.com/en/?a", ""), (9, "http://sub.example.com/en/", ""), (9, "http://sub.example.com/en/", ""), (10, "http://net/es/", ""), (11, "ftp://inet/es/", ""), (12, "http://com", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("verdict", F.lit(1))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "a.net", "/es/x", "net/es/", "block"), (2, "b.org", "/1", None, "block"), (3, "c.org", "/", None, "block"), (4, "d.org", "", None, "allow"), (5, "", "", None, "allow"),
        (None, "", "", None, "allow"), (6, "e.org", "/p", None, "allow"), (7, "c.org", "/", None, "block"), (8, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (9, "sub.example.com", "/en/", "example.com/en/", "block"), (9, "sub.example.com", "/en/", "example.com/en/", "block"), (10, "net", "/es/", "net/es/", "block"),
        (11, "inet", "/es/", None, "allow"), (12, "com", "", None, "allow")], key=repr)
    moved = spark.createDataFrame([("http://f.org/", "http://g.org/"), ("http://g.org/", "http://x.net/fr/1")], "from_url string, to_url string")
    more = spark.createDataFrame([(1, "https://f.org/#z", None)], "page_id long, url string, html string")
    assert urls.judge_urls(more, moved).first()["verdict"] == "block" and urls.judge_urls(more).first()["verdict"] == "allow"
    assert urls.judge_urls(pages.limit(0)).count() == 0


HREFS = ["/en/y", "y.html", "../y", "./y/./z", "../../../up", "a/../b/..", "..", "?id=1", "?id=1#t", "#t", "", "//example.com/en/9", "//Example.com", "mailto:a@b", "javascript:go(1)", "http:x", "https://h.org/a/../b", "/go?u=http://x.org/",
         "x/y?u=//q", "/", "//", "a b", "/a/b/../c?x=../d", "é/../ü", ".hidden", "...", "/.."]
BASES = ["http://a.org/d/e/f?q=1#z", "https://A.org", "http://a.org/", "http://a.org/d/", "http://a.org?x=/y/", "ftp://b.net/es/p;v"]


def test_links_lead_where_browsers_go(spark):
    from urllib.parse import urljoin, urlsplit

    pairs = [(t, b) for b in BASES for t in HREFS]
    df = spark.createDataFrame(pairs, "target string, page string")
    got = {(r["target"], r["page"]): r["u"] for r in df.select("*", urls.address_of(urls.resolved(F.col("target"), F.col("page"))).alias("u")).collect()}
    for t, b in pairs:
        if t in ("", "#t", "mailto:a@b", "javascript:go(1)", "http:x"):
            assert got[t, b] is None
        elif "h.org" not in t and t != "//":
            want = urlsplit(urljoin(b, t))
            path = want.path or ("/" if t in ("..", "../y") else "")
            assert got[t, b] == want.netloc.lower() + path + (f"?{want.query}" if want.query else ""), (t, b)


def test_aliases_by_relative_links_match_sql(spark):
    import duckdb

    link = lambda h: f'<link rel="canonical" href="{h}">'
    rows = [(k, f"{b.split('#')[0].rstrip('/')}/{k}/p", link(h)) for k, (b, h) in enumerate((b, h) for b in BASES for h in HREFS)]
    rows += [(1000, "http://a.org/en/y", link("//example.com/en/9")), (1001, "http://b.net/x", link("es/n")), (1002, "http://c.org/1", '<meta http-equiv="refresh" content="0;url=../2">'), (1003, "http://c.org/2", link("//d.net/fr/"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["alias_of"]) for r in urls.judge_urls(pages).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    res = con.execute(ORACLES["op5_url_filters"])
    names = [c[0] for c in res.description]
    want = {r[names.index("page_id")]: (r[names.index("verdict")], r[names.index("alias_of")]) for r in res.fetchall()}
    assert got == want
    assert [got[k][0] for k in (1000, 1001, 1002, 1003)] == ["block"] * 4


# ---- quality classifier


def test_classifier_on_labels(spark, documents, labels):
    got = quality_classifier.classify_quality(documents, labels).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.95
    assert all(0 < r["score"] < 1 and 0 < r["path_prior"] < 1 for r in got)
    kept = quality_classifier.keep_good(documents, labels)
    assert kept.columns == documents.columns and 0 < kept.count() < documents.count()


def test_priors_shrink_to_the_levels_above(spark, documents, labels):
    """A good-looking document among bad ones of its site has a lower prior than elsewhere, the less the fewer they are."""
    bad, good = "BAD!! STUFF!! " * 60, documents.where("lang = 'en'").orderBy(F.desc("n_chars")).first()["text"]
    rows = [(10_000 + k, bad, "spam", "x") for k in range(60)] + [(20_000, good, "spam", "x"), (20_001, good, "spam", "y"), (20_002, good, "fresh", "x"), (20_003, good, None, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in quality_classifier.classify_quality(documents.select("doc_id", "text", "source", "lang").unionAll(more), labels).where("doc_id >= 20000").collect()}
    assert got[20_000]["path_prior"] < got[20_002]["path_prior"] - 0.1 and got[20_001]["path_prior"] < got[20_002]["path_prior"]
    assert abs(got[20_002]["path_prior"] - got[20_003]["path_prior"]) < 0.05


def test_classifier_edges(odd, none, labels):
    got = quality_classifier.classify_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(r["score"] is not None for r in got)
    assert quality_classifier.keep_good(odd, labels).columns == odd.columns
    assert quality_classifier.classify_quality(none, labels).count() == 0
    alike = quality_classifier.classify_quality(odd, labels.limit(0)).select("evidence").distinct().count()
    assert alike == 1


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))
    model = fit(x, y.astype(float), ridge=1e-6)
    assert np.allclose((model.bias, *model.weights), (1, 2, -1), atol=0.25)


# ---- mixing


def _raked(cells, names, rate, rounds=mixing.ROUNDS):
    tokens = np.asarray([c[-1] for c in cells], float)
    p, wanted = np.full(len(cells), rate), rate * tokens.sum()
    goals = []
    for k, name in enumerate(names):
        values = np.asarray([str(c[k]) for c in cells])
        has = {v: tokens[values == v].sum() for v in set(values) if tokens[values == v].sum() > 0}
        left, goal = dict(has), {}
        while left:
            level = (wanted - sum(goal.values())) / sum(t ** mixing.POWERS[name] for t in left.values())
            full = [v for v, t in left.items() if level * t ** mixing.POWERS[name] >= t]
            goal |= {v: left.pop(v) for v in full} if full else {v: level * t ** mixing.POWERS[name] for v, t in left.items()}
            left = left if full else {}
        goals.append((values, goal))
    for _ in range(rounds):
        was = p.copy()
        for values, goal in goals:
            for v, g in goal.items():
                p[values == v] = np.minimum(1, p[values == v] * g / (tokens * p)[values == v].sum())
        if np.abs(p - was).max() <= mixing.STILL:
            break
    return p


def test_raking_matches_plain_version(spark):
    rng = random.Random(9)
    cells = [(s, lang, t, rng.choice((0, 5, 50, 500, 5000))) for s in ("a", "b", "c", None) for lang in ("en", "de", None) for t in ("x", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = {(r["source"], r["lang"], r["topic"]): r["p"] for r in mixing.rake(df, rate=0.5).collect()}
    want = _raked(cells, ("source", "lang", "topic"), 0.5)
    assert len(got) == len(cells) and all(abs(got[c[:3]] - w) < 0.01 for c, w in zip(cells, want, strict=True) if c[-1])


def test_mixing_meets_targets(spark, documents, odd, none):
    rows = [(k, "word " * (20 + k % 60), f"s{k % 3 if k % 10 else 0}", "en" if k % 4 else "de") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    shares = {"source": {"s0": 0.3, "s1": 0.3, "s2": 0.4}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mix_documents(docs, topic=F.lit("one"), rate=0.3, shares=shares)
    total = got.agg(F.sum("tokens")).first()[0]
    for name, want in shares.items():
        for r in got.groupBy(name).agg(F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("tokens"))).alias("s")).collect():
            assert abs(r["e"] / (0.3 * total) - want[r[name]]) < 0.01 and abs(r["s"] / (0.3 * total) - want[r[name]]) < 0.06
    chosen = mixing.sample_documents(documents)
    assert chosen.columns == documents.columns
    assert {r["doc_id"] for r in chosen.collect()} == {r["doc_id"] for r in mixing.mix_documents(documents).where("sampled").collect()}
    edge = mixing.mix_documents(odd).collect()
    assert len(edge) == odd.count() and all(0 <= r["probability"] <= 1 for r in edge)
    assert mixing.mix_documents(none).count() == 0 and mixing.sample_documents(odd).columns == odd.columns


def test_raking_ends_at_the_goals(spark, monkeypatch):
    """Small shares of values that go together: every marginal within a thousandth of its own goal, or a warning; as a table alike."""
    cells = [("a", "en", 90_000), ("a", "de", 3000), ("b", "en", 2000), ("b", "de", 50_000), (None, "en", 700), (None, "de", 9000)]
    df = spark.createDataFrame(cells, "source string, lang string, tokens long")
    shares = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.85, "de": 0.15}}
    got = mixing.rake(df, ("source", "lang"), 0.05, shares).collect()
    for name, of in shares.items():
        for value, share in of.items():
            assert abs(sum(r["tokens"] * r["p"] for r in got if r[name] == value) / (share * 0.05 * 154_700) - 1) <= 1e-3
    ps = []
    for most in (mixing.SMALL, 0):
        monkeypatch.setattr(mixing, "SMALL", most)
        with pytest.warns(UserWarning, match="misses"):
            ps.append({(r["source"], r["lang"]): r["p"] for r in mixing.rake(df, ("source", "lang"), 0.05, shares, rounds=1).collect()})
    assert ps[0] == pytest.approx(ps[1], rel=1e-4)


def test_topic_cues(spark):
    cues = {"a | b": "prose", "a | b | c": "table", "see @x.": "prose", "ann@x.org": "contact", "silicense": "prose", "Licensed": "legal"}
    got = spark.createDataFrame([(t,) for t in cues], "text string").select("text", mixing.topic_of(F.col("text")).alias("topic")).collect()
    assert {r["text"]: r["topic"] for r in got} == cues


# ---- pipeline


def test_pipeline_stages(spark, documents):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = documents
    plans = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, sf)
        assert after.columns == documents.columns
        kept = {r["doc_id"] for r in after.collect()}
        assert kept <= set(before) and kept
        if name == "quality rules":
            want = {r["doc_id"] for r in quality_rules.quality_measures(docs).where("kept").collect()}
            assert not any(plain.base_rule(before[k])[5] for k in kept)
        elif name == "quality classifier":
            want = {r["doc_id"] for r in quality_classifier.classify_quality(docs, labels).where("kept").collect()}
        elif name == "n-gram Jaccard join":
            want = {v[1] if v[0] else k for k, v in plain.similar(list(before.items()), 5, 80).items()}
        else:
            want = {r["doc_id"] for r in mixing.mix_documents(docs).where("sampled").collect()}
        assert kept == want
        plans[name] = len(kept)
        docs = spark.createDataFrame(after.collect(), documents.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(last)
    assert len({r["sequence_id"] for r in whole}) <= 1.05 * sum(r["length"] for r in whole) / packing.CAPACITY + 1


def test_pipeline_edges(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == odd.columns
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_rows_keep_columns_of_any_name(spark, documents, labels):
    names = ["_kept", "_twice", "_row", "_mix_", "_mix_topic_", "_mix_p_", "_evidence_", "_quality_verdict_", "_site_", "_host_", "_n"]
    mine = documents.limit(60).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    mine = mine.unionAll(mine.limit(3).withColumn("text", F.lit("other words")))
    for kept in (jaccard.keep_first(mine), mixing.sample_documents(mine, rate=0.5), quality_classifier.keep_good(mine, labels)):
        assert kept.columns == mine.columns
        rows = kept.collect()
        assert rows and {tuple(r[n] for n in names) for r in rows} == {tuple(range(len(names)))}
