"""Bags counted in their own rows: against counts in Python, ids in several rows included, and no word goes through a shuffle."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from stockloom.operators import text as X

ROWS = [(1, "One two two, three"), (2, "two Three three 4 four"), (3, None), (4, "77 --"), (5, "one"), (5, "ONE two"), (None, "a b"), (None, "b c"), (6, "two three four"), (7, "İstanbul one")]
PAIRS = [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (1, 5), (6, 2), (9, 1)]


def bag(rows, i):
    return Counter(t for k, text in rows if k == i for t in re.findall("[a-z]+", (text or "").lower()))


@pytest.mark.parametrize("rows", [ROWS, [r for r in ROWS if r[0] not in (5, None)]])
def test_bags(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: (len(b), sum(b.values())) for i in {k for k, _ in rows} if (b := bag(rows, i))}
    got = X.bag_sizes(docs).collect()
    assert len(got) == len(want) and {r.doc_id: (r.kinds, r.words) for r in got} == want
    pairs = spark.createDataFrame(PAIRS, "doc_id long, prior_doc_id long")
    found = X.cosine(pairs, docs, "doc_id", "prior_doc_id").collect()
    assert sorted((r.doc_id, r.prior_doc_id) for r in found) == sorted(PAIRS)
    for r in found:
        x, y = bag(rows, r.doc_id), bag(rows, r.prior_doc_id)
        norm = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        assert r.similarity == (pytest.approx(sum(x[t] * y[t] for t in x) / norm) if norm else None)


def test_words_stay_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    pairs = spark.createDataFrame([(2, 1)], "doc_id long, prior_doc_id long")
    for df in (X.bag_sizes(docs), X.cosine(pairs, docs, "doc_id", "prior_doc_id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Generate explode" not in plan
