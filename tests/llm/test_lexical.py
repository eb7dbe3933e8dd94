import math
import random
import re
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest

from visiontables.llm import lexical

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall


def ranked(docs, items, k):
    """Every item against every document."""
    terms = [TERMS((t or "").translate(plain.ASCII_LOWER)) for _, t in docs]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for own in terms for t in set(own))
    counts = [Counter(own) for own in terms]
    out = []
    for item_id, text in items:
        asked = set(TERMS((text or "").translate(plain.ASCII_LOWER)))
        scored = []
        for at, ((doc_id, _), own, count) in enumerate(zip(docs, terms, counts)):
            m = 10 + 90 * len(own) * n_docs // total if own else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * count[t] // (1000 * count[t] + 8 * m)) for t in asked if count[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, at))
        out += [(item_id, r + 1, docs[s[3]][0], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def _docs(rng, n):
    words = [f"w{k}" for k in range(60)] + ["É", "été", "x9"]
    weights = [1 / (k + 1) for k in range(len(words))]
    topics = [rng.sample(words, 8) for _ in range(5)]
    rows = []
    for k in range(n):
        own = rng.choices(words, weights, k=rng.choice((1, 5, 40))) + rng.choices(rng.choice(topics), k=10)
        rows.append((k, rng.choice((" ", "-", "\n")).join(w.upper() if rng.random() < 0.2 else w for w in own)))
    return rows + [(n + k, rows[0][1]) for k in range(n // 3)]  # a hot group of copies


@pytest.mark.parametrize(("n", "sizes"), [(300, {}), (300, dict(part=40, size=4, sample=20, batch=200)), (60, dict(part=7, size=2, sample=500)), (40, dict(part=1, size=1, sample=3))])
def test_same_as_brute_force(spark, n, sizes):
    rng = random.Random(n)
    docs = _docs(rng, n)
    items = [(k, " ".join(rng.choices(docs[rng.randrange(len(docs))][1].split() + ["unknown"], k=6))) for k in range(12)]
    got = lexical.search_terms(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=5, **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 5)


def test_odd_rows(spark, odd, none):
    items = [(1, "A ab É"), (None, "same words"), (1, "A ab É"), (2, None), (3, ""), (4, "nowhere"), (5, "x" * 70_000), (6, "w5x5 w6x6 1")]
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lexical.search_terms(odd, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 10)
    assert lexical.search_terms(none, asked).count() == lexical.search_terms(odd, asked.limit(0)).count() == 0


def test_blocks_bound_their_documents():
    rng = np.random.default_rng(3)
    items = lexical.Items.of([0, 1], pa.array(["a b c d", "c d e"]))
    impacts = rng.integers(0, 50, size=(200, len(items.vocabulary))) * (rng.random((200, len(items.vocabulary))) < 0.4)
    part = lexical.Part(np.arange(len(items.vocabulary)), impacts.astype(np.int64), items, size=8)
    for column in range(len(items.vocabulary)):
        docs, begins, coordinates, summaries = part.list_of(column)
        assert sorted(docs) == np.flatnonzero(impacts[:, column]).tolist() and len(begins) > 3
        for b, e, high in zip(begins, [*begins[1:], len(docs)], summaries, strict=True):
            assert (impacts[docs[b:e]][:, coordinates].max(axis=0) == high).all()
    for item in (0, 1):
        scores = impacts[:, items.terms[item]].sum(axis=1)
        bound = int(np.sort(scores)[-10])
        found = part.candidates(item, bound)
        assert set(np.flatnonzero(scores >= bound)) <= set(found) and len(found) < len(scores)
