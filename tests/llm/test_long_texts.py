"""Texts far longer than a block: the same results as in one go, and memory that follows the words, not the bytes."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stockloom.llm import decontam, kernel, linededup, neardup, quality, secrets, tokencount, toxicity

WORDS = "the stone river amber of willow copper in meadow harbor an ember lantern gull Émile 42 x1".split()


def text(rng, n, line=12):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.3 else ""))
        out.append("\n" if i % line == line - 1 else " ")
    return "".join(out)


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(7)
    return text(rng, 20_000) + ' token = "abcdef0123456789" ' + "q" * 9000 + "\n" + text(rng, 20_000)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(kernel, "BLOCK", 4096)


def whole(f):
    """What f gives with one block for everything."""
    keep = kernel.BLOCK
    kernel.BLOCK = 1 << 30
    try:
        return f()
    finally:
        kernel.BLOCK = keep


def one(text_):
    return next(kernel.pieces(pa.array([text_], pa.string())))


def same(a, b):
    if isinstance(a, (tuple, list)):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return np.array_equal(a, b)


@pytest.mark.parametrize("work", [
    lambda t: neardup.shingle_sets(one(t)), lambda t: quality.statistics(pa.array([t])), lambda t: toxicity.features(one(t)), lambda t: decontam.templates(one(t)),
    lambda t: linededup._runs(one(t)), lambda t: secrets.base_spans(one(t), secrets.keyword_starts(t.encode()))])
def test_blocks_change_nothing(small_blocks, long_text, work):
    assert same(work(long_text), whole(lambda: work(long_text)))


def test_secret_stretches(small_blocks, long_text):
    rng = np.random.default_rng(1)
    field = secrets.Field(rng.normal(size=(secrets._N_FEATURES, 3)).astype(np.float32) * 0.3 + np.array([1.5, 0, 0], np.float32), np.zeros((3, 3), np.float32))
    got, want = secrets.scan_piece(one(long_text), field), whole(lambda: secrets.scan_piece(one(long_text), field))
    assert [s for s in got if s[2] < 3] == [s for s in want if s[2] < 3] != []
    assert len(set(want) - set(got)) <= 0.01 * len(want)  # tokens beside a cut see no neighbour beyond it
    assert len(one(long_text).stretches(secrets._newline)) > 20 and "".join(p.text(0).decode() for _, p in one(long_text).stretches(secrets._newline)) == long_text


def test_token_counts_of_long_texts(small_blocks, long_text):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    cases = [long_text, "a" * 5000, "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000)), "ab" * 3001, "é" * 4000, "-" * 5001, "x" + " " * 5000 + "y", text(rng, 3000).replace(" ", "  ")]
    for t in cases:
        assert tokencount.count_piece(one(t), path)[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_long_word_is_quick():
    P = pytest.importorskip("public_tokenizers")
    import time

    word = "".join(random.Random(4).choice("etaoinshrdlu") for _ in range(200_000))
    machine = tokencount.merger(P.path("byte_bpe_50k.json"))
    machine.counts(np.frombuffer(word[:3000].encode(), np.uint8), np.array([0]), np.array([3000]))
    data, t = np.frombuffer(word.encode(), np.uint8), time.time()
    machine.counts(data, np.array([0]), np.array([len(word)]))
    assert time.time() - t < 5


@pytest.mark.parametrize("work", [lambda p: quality.statistics(p), lambda p: neardup.shingle_sets(next(kernel.pieces(p))), lambda p: secrets.scan_piece(next(kernel.pieces(p)), None)])
def test_memory_of_a_long_text(work):
    part = text(random.Random(2), 40_000)
    column = pa.array([part * (16_000_000 // len(part))], pa.string())
    work(pa.array([part[:5000]]))
    tracemalloc.start()
    work(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 22 * 16_000_000


def test_words_match_everywhere(small_blocks, long_text):
    starts, ends, _ = one(long_text).words()
    assert [long_text.encode()[a:b].decode() for a, b in zip(starts[:500], ends[:500], strict=True)] == re.findall(r"\S+", long_text)[:500]
