"""Sequence ratios in batches against the library's own, and the best block ratios of documents against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np

from stockloom.operators import sequences
from stockloom.operators import text as X
from stockloom.operators.sequences import best_ratios


def drawn(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh é"[: r.randint(1, 10)]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ratios():
    a, b = drawn(1, 30), drawn(2, 30)
    b += [x[:15] + "zz" + x[17:] for x in a[:8]]
    pairs = np.array([(i, j) for i in range(len(a)) for j in range(len(b))])
    want = np.array([SequenceMatcher(None, a[i], b[j]).ratio() for i, j in pairs])
    assert np.array_equal(best_ratios(a, b, pairs, prune=False), want)
    pruned = best_ratios(a, b, pairs)
    assert all(pruned[pairs[:, 0] == i].max() == want[pairs[:, 0] == i].max() for i in range(len(a)))
    assert len(best_ratios([], [], np.zeros((0, 2), int))) == 0


def test_block_ratios(spark):
    texts = ["\n\n".join(drawn(k, 90 if k == 3 else 7)) for k in range(6)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(k, k - 1) for k in range(1, 8)], "doc_id long, prior_doc_id long")
    blocks = {}
    for r in X.numbered_blocks(docs).collect():
        blocks.setdefault(r.doc_id, []).append((r.pos, r.key))
    want = {}
    for k in range(1, 8):
        before = [key for _, key in blocks.get(k - 1, [])]
        for pos, key in blocks.get(k, []):
            if key and key not in before:
                want[k, pos] = max((SequenceMatcher(None, key, p).ratio() for p in before), default=0.0)
    assert {(r.doc_id, r.pos): r.ratio for r in X.block_ratios(pairs, docs, part=8).collect()} == want


def test_keys_ignore_amounts(spark):
    got = spark.createDataFrame([("Sales of $1,200.5  fell in 2023.",), ("Sales of $7 fell in 2024",)], "t string").select(X.block_key(X.F.col("t")).alias("k")).collect()
    assert got[0].k == got[1].k == "sales of  fell in "


def test_ratios_of_long_and_foreign_texts():
    r = random.Random(3)
    a = ["".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 40, 300, 700)] + ["".join(chr(0x4E00 + r.randint(0, 400)) for _ in range(600)), "x" * 300, "ab" * 150]
    b = [t[:9] + "c" + t[5:] for t in a] + a[::-1]
    pairs = np.array([(i, j) for i in range(len(a)) for j in range(len(b))])
    assert np.array_equal(best_ratios(a, b, pairs, prune=False), np.array([SequenceMatcher(None, a[i], b[j], autojunk=False).ratio() for i, j in pairs]))


def test_rectangles_go_in_few_passes(monkeypatch):
    """Pairs of short texts are matched thousands at a time, not in fixed small lots."""
    calls, longest = [], sequences._longest
    monkeypatch.setattr(sequences, "_longest", lambda a, b, rect: calls.append(len(rect)) or longest(a, b, rect))
    a, b = [f"{i:03d}" for i in range(64)], [f"{i:04d}" for i in range(128)]
    best_ratios(a, b, np.array([(i, j) for i in range(64) for j in range(128)]), prune=False)
    assert calls[0] == 64 * 128


def test_whole_blocks_are_compared(spark):
    """Blocks alike in their first 160 letters and unlike after them, and the other way round."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    long = [" ".join(word() for _ in range(n)) for n in (90, 90, 40, 1200)]
    prior = [long[0][:170] + long[1], long[2], long[1][:100] + long[3]]
    now = [long[0], long[1][:50] + long[3], long[2], "1" * 170 + " ends in words"]
    docs = spark.createDataFrame([(1, "\n\n".join(prior)), (2, "\n\n".join(now))], "doc_id long, text string")
    pairs = spark.createDataFrame([(2, 1)], "doc_id long, prior_doc_id long")
    ends = " ends in words"
    want = {k: max(SequenceMatcher(None, t, p, autojunk=False).ratio() for p in prior) for k, t in ((0, now[0]), (1, now[1]), (3, ends))}
    assert {r.pos: r.ratio for r in X.block_ratios(pairs, docs).collect()} == want
    assert [r.pos for r in X.added_blocks(pairs, docs).orderBy("pos").collect()] == [k for k, v in want.items() if v < 0.5]


def test_seeds_find_what_cells_find(monkeypatch):
    """Long texts by places with the same few letters, in lots: the same ratios, and few cells looked at."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    a = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 5, 40, 90, 150)] + ["x" * 200, "\U0001f600é" * 60, ""]
    b = [t[:9] + "c" + t[5:] for t in a] + [t[::-1] for t in a] + [" ".join(r.choice(words) for _ in range(n)) for n in (10, 90, 150)]
    pairs = np.array([(i, j) for i in range(len(a)) for j in range(len(b))])
    want = np.array([SequenceMatcher(None, a[i], b[j], autojunk=False).ratio() for i, j in pairs])
    cells, longest = [], sequences._longest
    monkeypatch.setattr(sequences, "_longest", lambda a, b, rect: cells.append(((rect[:, 3] - rect[:, 2]) * (rect[:, 5] - rect[:, 4])).sum()) or longest(a, b, rect))
    monkeypatch.setattr(sequences, "SEEDS", 4000)
    assert np.array_equal(best_ratios(a, b, pairs, prune=False), want)
    assert sum(cells) < sum(len(a[i]) * len(b[j]) for i, j in pairs) / 2
    pruned = best_ratios(a, b, pairs)
    assert all(pruned[pairs[:, 0] == i].max() == want[pairs[:, 0] == i].max() for i in range(len(a)))
