"""Decontamination against brute force over all pairs, and the kinds of altered copies it is for."""

from __future__ import annotations

import random
import re

from stockloom.llm import decontam as D

WORDS = "the old stone river of willow copper in a meadow harbor an ember lantern gull house stands near buys from market with".split()
NUMBER = set(D.NUMBER_WORDS)
UNIT = set(D.UNITS)


def tokens(text, names):
    """(kind, value) of the collapsed tokens."""
    out, before, end = [], None, 0
    for m in re.finditer(r"[A-Za-z0-9\x80-\U0010FFFF]+(?:(?<=[0-9])[.,](?=[0-9])[A-Za-z0-9\x80-\U0010FFFF]+)*", text or ""):
        w, low = m[0], m[0].lower()
        number = w[0].isdigit() or low in NUMBER
        opens = before is None or re.search(r"[\n!.:?]", text[end : m.start()])
        kind = "num" if number else "unit" if before == "num" and low in UNIT else "name" if names and not opens and len(w) > 1 and w[0].isupper() and w[1].islower() else ""
        if kind and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + (low,))
        else:
            out.append((kind, (low,)))
        before, end = "num" if number else "", m.end()
    return out


def windows(ts, size):
    for i in range(len(ts) - size + 1):
        w = ts[i : i + size]
        yield tuple(k or v for k, v in w), i, [v if k else None for k, v in w]


def brute(docs, bench):
    out = {}
    for names in (True, False):
        items = {i: tokens(t, names) for i, t in bench}
        for d, text in docs:
            doc = tokens(text, names)
            for i, ts in items.items():
                size = min(len(ts), D.WINDOW)
                if size < D.SHORTEST:
                    continue
                at = {}
                for h, p, slots in windows(ts, size):
                    if sum(v is None for v in slots) * 8 >= size * 5:
                        at.setdefault(h, []).append((p, slots))
                shifts = {}
                for h, q, ds in windows(doc, size):
                    for p, slots in at.get(h, ()):
                        cover, same, pairs = shifts.setdefault(q - p, (set(), set(), set()))
                        cover |= set(range(p, p + size))
                        same |= set(range(p, p + size)) if slots == ds else set()
                        pairs |= {(a, b) for a, b in zip(slots, ds, strict=True) if a is not None}
                for cover, same, pairs in shifts.values():
                    reach = lambda c, n=len(ts): 2 * len(c) >= n or len(c) >= D.ENOUGH
                    if reach(cover) and (len(pairs) == len({a for a, _ in pairs}) or reach(same)):
                        got = (len(cover), len(ts), len({a for a, _ in pairs}), sum(a != b for a, b in pairs))
                        out[d, i] = max(out.get((d, i), got), got)
    slots = lambda ts: [next(j for j, x in enumerate(ts) if x == t) if t[0] else t[1] for t in ts]
    kinds = {i: ([k or v for k, v in tokens(t, True)], slots(tokens(t, True))) for i, t in bench}
    led = {i: min(j for j in kinds if kinds[j] == kinds[i]) for i in kinds}
    best = {}
    for (d, i), got in out.items():
        best[d, led[i]] = max(best.get((d, led[i]), got), got)
    return best


def item(rng, n):
    pick = lambda: rng.choice(["Alice", "Robert", "London", "12", "3,200", "seven", "5 kg"]) if rng.random() < 0.25 else rng.choice(WORDS)
    return " ".join(pick() for _ in range(n))


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string").repartition(3)


def test_against_all_pairs(spark):
    rng = random.Random(12)
    bench = [(i, item(rng, rng.choice([3, 5, 7, 12, 25, 40]))) for i in range(40)] + [(90, None), (91, "")]
    swap = {"Alice": "Mary", "Robert": "Tom", "London": "Oslo", "12": "77", "3,200": "19", "seven": "six"}
    docs = []
    for d in range(120):
        t = rng.choice(bench[:40])[1]
        how = rng.randrange(6)
        if how == 1:
            t = re.sub(r"[A-Za-z0-9,]+", lambda m: swap.get(m[0], m[0]), t)
        elif how == 2:
            t = t.lower()
        elif how == 3:
            t = " ".join(w for w in t.split() if rng.random() > 0.08)
        elif how == 4:
            t = re.sub(r"[A-Za-z0-9,]+", lambda m: swap.get(m[0], m[0]), t, count=3)
        docs.append((d, item(rng, rng.randrange(30)) + " " + (t if how < 5 else item(rng, 30)) + rng.choice([" ", ". ", "\n"]) + item(rng, rng.randrange(30))))
    docs += [(200, None), (201, ""), (202, "x " * 3000)]
    got = {(r.doc_id, r.item_id): (r.covered, r.tokens, r.n_slots, r.changed) for r in D.matches(table(spark, docs, "doc_id"), table(spark, bench, "item_id")).collect()}
    want = brute(docs, bench)
    assert len(want) > 60 and got == want


def test_altered_questions(spark):
    q = "One day Tom has 12 apples and buys many more of them from the old market in Rome while the harbor sleeps"
    bench = [(1, q)]
    docs = [
        (1, q.replace("Tom", "Mary Ann").replace("12", "twenty five").replace("Rome", "New York")), (2, q.lower()), (3, q.upper()), (4, q.replace("Tom", "Tim")),
        (5, "quite other words that have nothing to do with any of the questions in the list of items"), (6, "So it went. " + q + " And on.")]
    got = {r.doc_id for r in D.matches(table(spark, docs, "doc_id"), table(spark, bench, "item_id")).collect()}
    assert got == {1, 2, 3, 4, 6}
    twice = "while Alice sells the red house near the old mill she meets Bob and then Alice pays Bob for the copper lamp they found below"
    once = twice.replace("Alice", "Carol", 1)  # one slot disagrees, the rest stands unchanged
    assert D.matches(table(spark, [(1, once)], "doc_id"), table(spark, [(1, twice)], "item_id")).count() == 1


def test_items_of_one_template_give_one_row(spark):
    t = "so {} walks {} miles from the old harbor to the market near {} before the sun goes down again"
    bench = [(i, t.format(n, k, c)) for i, (n, k, c) in enumerate([("Tom", 3, "Rome"), ("Ann", 4, "Paris"), ("Eve", 9, "Eve")])]
    rows = {(r.item_id, r.n_items, r.changed) for r in D.matches(table(spark, [(7, t.format("Tom", 3, "Rome"))], "doc_id"), table(spark, bench, "item_id")).collect()}
    assert {(i, n) for i, n, _ in rows} == {(0, 2), (2, 1)}  # the third by its plain words, as the class of its own
    classes = {(r.item_id, r.leader, r.n_items) for r in D.item_classes(table(spark, bench, "item_id")).where("mode = 0").collect()}
    assert classes == {(0, 0, 2), (1, 0, 2), (2, 2, 1)}  # one whose two slots are equal is another question
