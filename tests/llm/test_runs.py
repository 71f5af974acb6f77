"""Periodic runs against a scan of every period, the query against its contract told plainly, and edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from stockloom.llm import runs as R


def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q) and i > start:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_are_all_found():
    r = np.random.default_rng(5)
    for _ in range(120):
        texts = []
        for _ in range(int(r.integers(0, 7))):
            n = int(r.integers(0, 160))
            w = r.integers(0, int(r.integers(1, 5)), n)
            if n and r.random() < 0.6:
                a, p = int(r.integers(0, n)), 1 + int(r.integers(0, max(1, n // 5)))
                w = w[np.concatenate((np.arange(a), a + np.arange(n - a) % p))]
            texts.append(w)
        assert [list(map(tuple, x.tolist())) for x in R.find_runs(texts)] == [brute(t.tolist()) for t in texts]


def test_extensions():
    r = np.random.default_rng(6)
    for n in (1, 12, 13, 14, 200, 700):
        w = r.integers(0, 2, n)
        w[n // 2 :] = w[: n - n // 2]
        lce = R.Extensions(w)
        i, j = r.integers(0, n, 400), r.integers(0, n, 400)
        i, j = i[i != j], j[i != j]
        if len(i):
            want = [next((k for k in range(n - max(a, b)) if w[a + k] != w[b + k]), n - max(a, b)) for a, b in zip(i, j, strict=True)]
            assert lce(i, j).tolist() == want


def told(doc_id, text):
    """The contract of the query, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, tmp_path):
    r = random.Random(7)
    texts = [None, "", " \t\n", "one", "a " * 9, "x y " * 30 + "z", "a b c a b c " * 5]
    texts += [" ".join(r.choice("ab cde fg".split()) for _ in range(r.randint(0, 120))) for _ in range(200)]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", 1), (None, "q " * 20, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, R.op13_periodic_runs(spark, str(tmp_path)).collect())))
    want = sorted(str((i, *told(i, t))) for i, t, *_ in rows)
    assert got == want
    assert any(R.planted(i, 50) is not None for i in range(100))


def test_operator_without_planting(spark):
    df = spark.createDataFrame([(1, "go go go go go go stop"), (1, "go go go go go go stop"), (2, None)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_words, [tuple(c) for c in x.runs], x.collapsed) for x in R.periodic_runs(df).collect())
    assert got == [(1, 7, [(0, 6, 1)], "go stop"), (1, 7, [(0, 6, 1)], "go stop"), (2, 0, [], "")]
    assert R.periodic_runs(df.limit(0)).count() == 0


def test_a_long_text_of_one_word():
    assert R.find_runs([np.zeros(60_000, np.int64)])[0].tolist() == [[0, 60_000, 1]]
