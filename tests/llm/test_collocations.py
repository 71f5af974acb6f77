"""Collocations: the index against counting, shards against whole texts, the operator against its rule told plainly."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from stockloom.llm import collocations as C


def test_index_counts_and_places():
    r = np.random.default_rng(0)
    for _ in range(80):
        n = int(r.integers(2, 250))
        w = r.integers(0, int(r.integers(1, 8)), n)
        w[0] = w[-1] = 0
        for length in (2, 3, 4, 5):
            at, place, count = C.phrases(w, length)
            here = [i for i in range(n - length + 1) if (w[i : i + length] > 0).all()]
            assert {tuple(w[p : p + length]): c for p, c in zip(place, count, strict=True)} == Counter(tuple(w[i : i + length]) for i in here)
            assert np.flatnonzero(at >= 0).tolist() == here
            assert all((w[place[at[i]] :][:length] == w[i : i + length]).all() for i in here)


def test_left_and_right_intervals_stay_in_step():
    r = np.random.default_rng(1)
    w = r.integers(0, 4, 200)
    w[0] = w[-1] = 0
    index = C.Index(w, 4)
    one = index.single()
    for sides in (("left", "right", "left"), ("right", "right", "left"), ("right", "left", "left")):
        now, names = one, [(k,) for k in np.unique(w[w > 0]).tolist()]
        for side in sides:
            new, _, _ = index.extend(now, side)
            names = [((x, *names[o]) if side == "left" else (*names[o], x)) for o, x in zip(new["of"], new["word"], strict=True)]
            now = new
            for k, name in enumerate(names):
                for half, way in (("left", 1), ("right", -1)):
                    rows = index.half(half).order[now[half][k] : now[half][k] + now["count"][k]]
                    text = w[::way]
                    assert all(tuple(text[p : p + len(name)]) == name[::way] for p in rows)


def by_rule(rows, floor, top, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= floor}
    out = []
    for (lang, p), a in cand.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(other == lang and len(q) > len(p) and 100 * b >= 100 * a and inside(q) for (other, q), b in cand.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], n[lang]))
    ranked, place = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, left, right, total, -score))
    return ranked


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_operator(spark, monkeypatch, size):
    monkeypatch.setattr(C, "SHARD_WORDS", size)  # many shards, or one of a language and task
    monkeypatch.setattr(C, "HELD_WORDS", 2 * size)
    r = random.Random(2)
    vocabulary = ["the", "The", "of", "é x", "New", "york", "city", "a", "b", "c\t", "d,", "e.", "f\n", "\x0bg"]
    rows = [(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) + r.choice(["", " ", "new york city hall"]), r.choice(["en", "fr", None])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("x " * 50, "de"), ("Ä Ö ä ö " * 9, "de")]
    df = spark.createDataFrame([(i % 7, t, lang, 0) for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string, n int").repartition(3)
    for floor, top in ((4, 2000), (6, 5)):
        assert sorted(map(tuple, C.collocations(df, floor=floor, top=top).collect())) == sorted(by_rule(rows, floor, top))


def test_wide_products_and_nothing(spark):
    big = 3_000_000_000_000
    f = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 9), ("en", "", 0, 9 * big)], "lang string, phrase string, size int, f long")
    import stockloom.llm.collocations as module

    real, module.frequent = module.frequent, lambda *_: f
    try:
        assert [tuple(x) for x in C.collocations(f).collect()] == [("en", 1, "a b", big, big + 7, big + 9, 9 * big, 1000 * big * 9 * big // ((big + 7) * (big + 9)))]
    finally:
        module.frequent = real
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(empty).count() == 0


def test_no_row_holds_a_shard(spark, monkeypatch):
    """A shard's phrases and survivors lie and travel as rows of a bounded size, so that readers hold no more than a few of them."""
    seen, real = [], C.shared.written
    monkeypatch.setattr(C.shared, "written", lambda df, **o: seen.append(real(df, **o)) or seen[-1])
    monkeypatch.setattr(C.shared, "discard", lambda *_: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 701}" for j in range(900)), "en") for k in range(4)], "doc_id int, text string, lang string").coalesce(1)
        assert C.frequent(df, longest=3, floor=1).where("size = 3").count() == len({tuple((k * (j + i)) % 701 for i in range(3)) for k in range(4) for j in range(898)})
        tables = [t for t in seen if "shard" in t.columns]
        assert len(tables) == 3 and all(kind == "binary" or not kind.startswith("array") for t in tables for _, kind in t.dtypes)
        kept = next(t for t in seen if {"id", "name"} <= set(t.columns))
        sizes = C._joined_back(tables[0], kept.select("lang", "name", "id"), ["lang", "name"]).selectExpr("size(slots) AS n").where("n >= 0").collect()
        assert max(r.n for r in sizes) <= 100 and sum(r.n for r in sizes) == 701
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
