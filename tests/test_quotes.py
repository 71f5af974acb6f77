"""Short quotes by automaton against looking for each in each, in blocks and at once."""

from __future__ import annotations

import random
import re

from stockloom.operators import text as X


def plain(t):
    t = t.translate(str.maketrans(X.FOLDED[:-1], X.PLAIN)).replace(X.FOLDED[-1], "")
    for a, b in X.LIGATURES:
        t = t.replace(a, b)
    return re.sub(r"\s+", " ", t).strip().lower()


def test_against_brute_force(spark):
    r = random.Random(8)
    words = ["Net", "sales", "fell", "by 5%", "“risk”", "co–op", "proﬁt", "a b", "don’t", "very­long", "x\ty", "\n"]
    draw = lambda n: " ".join(r.choice(words) for _ in range(n))
    segments = [(k, draw(r.randint(0, 60))) for k in range(60)] + [(99, None)]
    cut = lambda t, a: t[a : a + r.randint(5, 60)]
    claims = [(f"c{k}", draw(r.randint(1, 9))) for k in range(100)] + [("none", None), ("empty", "")]
    claims += [(f"d{k}", cut(t, r.randint(0, 30)).swapcase()) for k, t in segments if t]
    want = {}
    for i, q in claims:
        q = plain(q or "")
        places = [d for d, t in segments if len(q) >= 12 and q in plain(t or "")]
        if places:
            want[i] = (min(places), len(places))
    assert len(want) > 40
    c, s = spark.createDataFrame(claims, "item_id string, text string"), spark.createDataFrame(segments, "doc_id int, text string")
    for small in (100_000, 20):
        got = X.grounded(c, s, small=small)
        assert {x.item_id: (x.doc_id, x.places) for x in got.collect()} == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert X.grounded(c.limit(0), s).count() == 0 and X.grounded(c, s.limit(0)).count() == 0
