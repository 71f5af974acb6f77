"""News events against the written rule, story by story."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from stockloom.operators import stories as S

HOUR = 3600


class Article:
    def __init__(self, i, sec, keys, bag, grade, deal, turn, once):
        self.id, self.sec, self.keys, self.grade, self.deal, self.turn, self.once = i, sec, keys, grade, deal, turn, once
        norm = sum(x * x for x in bag.values()) ** 0.5 or 1.0
        self.words, self.w = list(bag), [x / norm for x in bag.values()]


def by_rule(articles):
    """Event of every article: the rule of the module, told plainly over whole lists."""
    told = []
    for a in articles:
        fits = [s for s in told if a.sec - s[-1].sec <= S.WINDOW and len(set(a.keys) & set(s[0].keys)) >= S.SHARED]
        fits[0].append(a) if fits else told.append([a])
    event = {}
    for j, s in enumerate(told):
        for i in range(j):
            if event[i] == i and S_same(told[i], s):
                event[j] = i
                break
        else:
            event[j] = j
    return {a.id: event[k] for k, s in enumerate(told) for a in s}


def S_same(x, y):
    face = lambda s: max(s, key=lambda a: (a.grade, -a.sec))
    fx, fy, apart = face(x), face(y), y[0].sec - x[0].sec

    def bag(s):
        total = {}
        for a in s:
            for word, w in zip(a.words, a.w, strict=True):
                total[word] = total.get(word, 0.0) + w
        norm = sum(v * v for v in total.values()) ** 0.5 or 1.0
        return {k: v / norm for k, v in total.items()}

    bx, by = bag(x), bag(y)
    like = sum(v * by.get(k, 0.0) for k, v in bx.items()) >= S.LIKE
    party = lambda s, f: (set(f.keys) | set(s[0].keys)) - set(S.NO_PARTY)
    deal = fx.deal and fy.deal and apart <= S.DEAL_WINDOW and party(x, fx) & party(y, fy)
    return fx.turn == fy.turn and ((apart <= S.WINDOW and (like or set(fx.once) & set(fy.once))) or deal)


def drawn(seed, n):
    r, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += r.choice([0, HOUR, 5 * HOUR, 20 * HOUR, 60 * HOUR])
        keys = r.sample(["acme", "orion", "zenith", "monday", "5", "offer"], r.randint(0, 4))
        bag = {w: r.randint(1, 3) for w in r.sample([f"w{k}" for k in range(40)], r.randint(0, 4))}
        out.append(Article(i, t, keys, bag, r.randint(0, 2), r.random() < 0.3, r.random() < 0.2, [0] if r.random() < 0.1 else []))
    return out


def test_fold_follows_the_rule():
    for seed in range(60):
        articles, run, story, event = drawn(seed, 120), S.Run(), {}, {}
        for a in articles:
            story[a.id], settled = run.push(a)
            event.update(settled)
        event.update(run.settle(True))
        assert {i: event[s] for i, s in story.items()} == by_rule(articles), seed


def test_state_stays_small():
    run, most = S.Run(), 0
    for i in range(20_000):  # a name with six articles a day for nine years
        run.push(Article(i, i * 4 * HOUR, [f"k{i // 9}", f"m{i // 9}"], {f"w{i % 97}": 1}, 1, False, False, []))
        most = max(most, len(run.open) + len(run.waiting) + len(run.events) + len(run.by_key) + len(run.by_word))
    assert most < 400


def test_long_run_in_spark(spark):
    start = datetime(2024, 1, 1)
    rows = [("A", i, start + timedelta(hours=12 * i), f"Acme and Orion{i // 6} sign Zenith{i // 6}", "", 1, "Acme Inc") for i in range(200)] + [("B", 999, start, None, None, 0, None)]
    got = S.clusters(spark.createDataFrame(rows, "ticker string, id int, ts timestamp, headline string, summary string, grade int, name string")).collect()
    assert len(got) == 201 and {r.run for r in got} == {0}
    assert S.clusters(spark.createDataFrame([], "ticker string, id int, ts timestamp, headline string, summary string, grade int")).count() == 0


def test_own_words_and_parties_are_no_keys(spark):
    df = spark.createDataFrame([("ACME", "Acme Holdings", "Acme buys Orion for $5b on Monday, ACME says")], "t string, n string, h string")
    own = S.own_words(S.F.col("t"), S.F.col("n"))
    assert df.select(S.keys(S.F.col("h"), own).alias("k")).first().k == ["orion", "$5b", "monday"]
    assert "monday" in S.NO_PARTY
