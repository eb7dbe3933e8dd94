import hashlib
import random

import pytest

from visiontables.llm import exact_copies


def _plain(rows, last):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    pick = max if last else min
    return sorted((i, pick(groups[t or ""]), len(groups[t or ""]), i == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize(("parts", "steps", "keep"), [(1, 3, "last"), (2, 1, "first"), (7, 1, "last"), (7, 3, "first"), (37, 2, "last")])
def test_copies_by_any_tree(spark, parts, steps, keep):
    rng = random.Random(parts)
    texts = [None, "", " ", "a", "A", "same " * 400, "same " * 400 + " ", "é", "é", "long " * 50_000] + [f"t{k}" for k in range(90)]
    rows = [(i, rng.choice(texts) if i % 3 else "hot") for i in range(600)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = exact_copies.exact_copies(docs, keep, steps).collect()
    assert sorted(map(tuple, got)) == _plain(rows, keep == "last")
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert sorted(map(tuple, exact_copies.keep_one(docs, keep, steps).collect()), key=lambda r: r[0]) == sorted(r for r in rows if r[0] in kept)


def test_odd_rows(spark, odd, none):
    got = exact_copies.exact_copies(odd)
    rows = got.collect()
    assert got.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    assert len(rows) == odd.count() and sum(r["kept"] for r in rows) == len({r["text"] or "" for r in odd.collect()})
    twice = [r for r in rows if r["doc_id"] == 4]
    assert [r["group_size"] for r in twice] == [2, 2] and sum(r["kept"] for r in twice) == 1
    assert exact_copies.exact_copies(none).count() == 0 and exact_copies.keep_one(none).columns == odd.columns
    assert exact_copies.keep_one(odd).columns == odd.columns


def test_null_ids_stay_only_alone(spark):
    docs = spark.createDataFrame([(None, "x"), (3, "x"), (None, "y"), (None, "y"), (5, None), (4, "")], "doc_id long, text string")
    for keep, of_empty in (("last", 5), ("first", 4)):
        rows = exact_copies.exact_copies(docs, keep).collect()
        assert [r["kept"] for r in rows if r["doc_id"] == 3] == [True] and {r["keep_id"] for r in rows if r["group_size"] == 2} == {3, None, of_empty}
        assert sum(r["kept"] for r in rows) == 3
