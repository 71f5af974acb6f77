"""Rows that repeat a doc_id (with equal and with other texts) and null doc_ids, against brute force on rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from stockloom.llm import decontam, linededup, neardup, quality, secrets, toxicity

WORDS = "stone river amber willow copper meadow harbor ember lantern gull".split()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = []
    lines = [prose(rng, 6) for _ in range(40)]
    for i in range(60):
        at = rng.randrange(35)
        body = lines[at : at + rng.randrange(3, 6)] + [prose(rng, 5) for _ in range(rng.randrange(4))]
        rng.shuffle(body[:1])
        out.append((rng.choice([i, i, 5, None]), "\n".join(body)))
    out += rng.sample(out, 15)  # equal rows
    base = prose(rng, 60).split()
    for i in range(12):
        v = list(base)
        v[rng.randrange(60)] = f"n{i}"
        out.append((rng.choice([5, 200 + i]), " ".join(v)))
    return out + [(5, None), (5, ""), (5, ""), (None, None), (None, "x y")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id long, text string, n_chars long, tag string").repartition(3)


def tag(text):
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_line_dedup_by_rows(table, rows):
    place = lambda i, t: (i is not None, i or 0, tag(t))
    texts = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: place(*x))
    seen, want = set(), {}
    for i, t in texts:
        lines = t.split("\n")
        full = [j for j, x in enumerate(lines) if split(x)]
        gone = set()
        for a in range(len(full) - 2):
            three = tuple(lines[j].strip(" \t\n\x0b\x0c\r") for j in full[a : a + 3])
            if three in seen:
                gone |= set(full[a : a + 3])
            seen.add(three)
        want[i, t] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    got = Counter((r.doc_id, r.text) for r in linededup.dedup(table).collect())
    assert got == Counter((i, want.get((i, t), t)) for i, t in rows)
    passed = linededup.dedup_passages(table).collect()
    assert len(passed) == len(rows) and Counter(r.doc_id for r in passed) == Counter(i for i, _ in rows)
    assert all(r.n_chars == len(r.text or "") for r in passed)


def test_one_text_never_loses_the_lines_of_another(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nz"), (2, "k\nl\nm\nn")]
    got = {(r.doc_id, r.text) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "a\nb\nc"), (2, "z"), (2, "k\nl\nm\nn")}


def test_near_duplicates_by_rows(table, rows):
    sets = []
    for _, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    alone = [i is None or not s for (i, _), s in zip(rows, sets, strict=True)]
    for x in range(len(rows)):
        for y in range(x):
            if not alone[x] and not alone[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                up[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if not alone[x]:
            least[find(x)] = min(least.get(find(x), i), i)
    want = [(i, len(sets[x]), i if alone[x] else least[find(x)]) for x, (i, _) in enumerate(rows)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(table).collect())
    assert got == Counter(want)
    kept = neardup.keep_first(table)
    assert kept.columns == table.columns
    by_text = {}
    for x, (i, t) in enumerate(rows):
        by_text.setdefault((i, t), find(x))
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    groups = Counter(by_text[k] for k in left.elements() if k[0] is not None and split(k[1]))
    assert set(groups) == set(least) and set(groups.values()) == {1}  # one row of every group
    assert all(left[k] == Counter(rows)[k] for k in rows if k[0] is None or not split(k[1]))


def test_other_operators_give_a_row_for_every_row(spark, table, rows):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    ids = Counter(i for i, _ in rows)
    for out in (quality.judge(table, labels), toxicity.score(table, toxicity.train(table, labels)), secrets.scan(table, secrets.train(table))):
        assert Counter(r.doc_id for r in out.collect()) == ids


def test_decontamination_drops_rows_not_ids(spark):
    item = "the quick copper lantern swings above a silent harbor while seven grey gulls circle twice around it"
    docs = spark.createDataFrame([(5, item, "a"), (5, "a clean text of other words", "b"), (None, "so: " + item, "c"), (None, "clean too", "d"), (6, None, "e")], "doc_id long, text string, hash string")
    left = decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.hash for r in left.collect()) == ["b", "d", "e"]
