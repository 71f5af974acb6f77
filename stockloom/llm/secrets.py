"""Secret scan: base patterns, and a linear-chain conditional random field that adds further spans.

Tokens are runs of letters, digits and ``+/_-``. The field tags each as outside, begin or inside a secret from its own
shape, its neighbours (a naming keyword before it, the separators around it, the shape of the next token) and features of the
whole file. It learns from evidence of its own, not from the base patterns: into windows of at most ``sample_rows`` documents
of either kind (naming a secret or not; a documented bound) random values are planted behind names that the base patterns do not know
or behind none, beside things that look alike and are none (numbers, dates, paths, identifiers), and base spans found there are hidden by
another name and shape half of the time. The windows are cut in executors; only they reach the driver. Tags are decoded by
Viterbi. Where the outside score leads by more than transitions can ever give back, outside is certain, so only the runs between
such tokens need the recursion; all runs of a piece step together. Precision and recall of what the field adds are in the tests.

Edge cases: a null or empty text has no spans; a repeated doc_id gives a row each time; without any
training document the field adds nothing; a text of more than 2 MB is tagged in stretches cut at newlines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import kernel, shared

#: Names that announce a secret, and the base patterns' least lengths.
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
#: Documents of either kind that training takes windows from, and windows of one document.
SAMPLE_ROWS, WINDOWS_EACH = 300, 10


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _UPPER, _LOWER = _table(b"0123456789"), _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_HEX = _table(b"0123456789abcdef")
_TOKEN = _DIGIT | _UPPER | _LOWER | _table(b"+/_-") | _table(bytes(range(128, 256)))
_VOWEL, _JOINT = _table(b"aeiouyAEIOUY"), _table(b"/_-")
_HIGH = _table(bytes(range(128, 256)))
_SYMBOL = _table(b"{}[]()<>=:;\"'`$%&|#*\\@")
_LEAD = ~_table(bytes(range(128, 192)))


def runs(piece: kernel.Piece, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked bytes that stay in one text."""
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = piece.offsets[(piece.offsets > 0) & (piece.offsets < len(inside))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def keyword_starts(blob: bytes) -> np.ndarray:
    low, found = blob.lower(), []
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            found.append(at)
            at = low.find(word, at + 1)
    return np.array(sorted(found), np.int64)


def base_spans(piece: kernel.Piece, keywords: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start byte, kind, end byte) of the base patterns, sorted; bytes count from the text's start."""
    out = []
    for row in np.unique(piece.owner(keywords)).tolist() if len(keywords) else []:
        for m in ASSIGN.finditer(piece.text(row)):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((row, m.start(), 0, m.end()))
    blob = piece.data.tobytes()
    if b"AKIA" in blob:
        for row in range(piece.n):
            for m in ACCESS.finditer(blob, int(piece.offsets[row]), int(piece.offsets[row + 1])):
                if m.end() - m.start() >= LEAST["access"]:
                    out.append((row, m.start() - int(piece.offsets[row]), 1, m.end() - int(piece.offsets[row])))
    starts, ends = runs(piece, _HEX[piece.data])
    long = ends - starts >= LEAST["hex"]
    owner = piece.owner(starts[long])
    for row, a, b in zip(owner.tolist(), (starts[long] - piece.offsets[owner]).tolist(), (ends[long] - piece.offsets[owner]).tolist(), strict=True):
        out.append((row, a, 2, b))
    return sorted(out)


# ---------------------------------------------------------------- the field

#: Feature groups and their number of codes; each group gives every token one code.
GROUPS = {"length": 7, "shape": 32, "turns": 5, "mix": 6, "vowels": 6, "parts": 4, "keyword": 4, "before": 8, "after": 4, "next": 8, "file": 16}
_OFFSETS = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist(), strict=True))
_N_FEATURES = sum(GROUPS.values())


def file_code(piece: kernel.Piece, keywords: np.ndarray) -> np.ndarray:
    """One code for each text: whether it names a secret, its shares of digits and of symbols."""
    size = np.maximum(np.diff(piece.offsets), 1)
    has_word = np.zeros(piece.n, np.int64)
    if len(keywords):
        has_word[piece.owner(keywords)] = 1
    return has_word + 2 * (kernel.byte_count(piece, _DIGIT) / size > 0.02) + 4 * np.digitize(kernel.byte_count(piece, _SYMBOL) / size, (0.02, 0.06, 0.15))


def features(piece: kernel.Piece, keywords: np.ndarray, file: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, owner, and codes (token x group, already offset into the weight table)."""
    data = piece.data
    starts, ends = runs(piece, _TOKEN[data])
    owner = piece.owner(starts)
    n = len(starts)
    codes = np.zeros((n, len(GROUPS)), np.int32)
    if not n:
        return starts, ends, owner, codes

    def tally(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    digit = _DIGIT[data]
    d, u, lo, hx, hi = tally(digit), tally(_UPPER[data]), tally(_LOWER[data]), tally(_HEX[data]), tally(_HIGH[data])
    length = ends - starts
    flips = np.zeros(len(data), bool)
    flips[1:] = digit[1:] != digit[:-1]
    turns = np.maximum(tally(flips) - flips[starts], 0)
    kind = np.zeros(len(data), np.uint8)
    kind[digit], kind[_UPPER[data]], kind[_LOWER[data]] = 1, 2, 3
    changes = np.zeros(len(data), bool)
    changes[1:] = kind[1:] != kind[:-1]
    mix = np.maximum(tally(changes) - changes[starts], 0) / length
    vowels = tally(_VOWEL[data]) / np.maximum(u + lo, 1)
    first_only = (u == 1) & _UPPER[data[starts]]
    shape = (d > 0) * 1 + ((u > 0) & ~first_only) * 2 + (lo > 0) * 4 + (hx == length) * 8 + (hi > 0) * 16
    named = np.zeros(n + 2, bool)
    if len(keywords):
        at = np.searchsorted(starts, keywords, side="right") - 1
        named[at[at >= 0]] = True
    named = named[:n]
    previous = np.zeros((2, n), bool)
    same1, same2 = np.zeros(n, bool), np.zeros(n, bool)
    same1[1:], same2[2:] = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    previous[0, 1:], previous[1, 2:] = named[:-1], named[:-2]
    before1 = data[np.maximum(starts - 1, 0)]
    quote_before = np.isin(before1, (34, 39))
    assigned = np.zeros(len(data) + 1, np.int32)
    np.cumsum(np.isin(data, (58, 61)), out=assigned[1:])
    gap_from = np.where(same1, np.concatenate(([0], ends[:-1])), starts)
    linked = assigned[starts] > assigned[gap_from]
    close = starts - gap_from <= 4
    after1 = data[np.minimum(ends, len(data) - 1)]
    odd = (d > 0) & (lo + u > 0)
    following = np.zeros(n, np.int64)
    following[:-1] = np.where(owner[1:] == owner[:-1], 1 + odd[1:] * 2 + (length[1:] >= 16) * 4, 0)
    file = file_code(piece, keywords) if file is None else file
    columns = {
        "length": np.digitize(length, (4, 8, 12, 16, 20, 32)),
        "shape": shape,
        "turns": np.digitize(turns, (1, 2, 4, 8)),
        "mix": np.digitize(mix, (0.01, 0.12, 0.25, 0.4, 0.55)),
        "vowels": np.where(u + lo >= 4, 1 + np.digitize(vowels, (0.1, 0.22, 0.34, 0.5)), 0),
        "parts": np.minimum(tally(_JOINT[data]), 3),
        "keyword": (previous[0] & same1) * 1 + (previous[1] & same2) * 2,
        "before": quote_before * 1 + linked * 2 + close * 4,
        "after": np.isin(after1, (34, 39)) * 1 + np.isin(after1, (61, 58)) * 2,
        "next": following,
        "file": file[owner],
    }
    for k, (name, c) in enumerate(columns.items()):
        codes[:, k] = c + _OFFSETS[name]
    return starts, ends, owner, codes


class Field:
    """Weights: unary (feature x state) and transitions (state x state); states are 0 outside, 1 begin, 2 inside."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray) -> None:
        self.unary, self.pair = unary, pair
        gains = [pair[a, s] + pair[s, b] - pair[a, 0] - pair[0, b] for s in (1, 2) for a in range(3) for b in range(3)]
        self.swing = float(max(gains))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), 3), np.float32)
        for k in range(codes.shape[1]):
            out += self.unary[codes[:, k]]
        return out

    def decode(self, scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Best tags; every text is framed by outside. Exact: a token is skipped only where outside is certain."""
        tags = np.zeros(len(scores), np.uint8)
        open_ = scores[:, 0] - scores[:, 1:].max(axis=1) <= self.swing
        if not open_.any():
            return tags
        joined = np.zeros(len(open_), bool)
        joined[1:] = open_[1:] & open_[:-1] & (owner[1:] == owner[:-1])
        first = np.flatnonzero(open_ & ~joined)
        where = np.flatnonzero(open_)
        length = np.diff(np.append(np.searchsorted(where, first), len(where)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        best = self.pair[0] + scores[first]
        back = []
        for j in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -j, side="left"))
            paths = best[:n, :, None] + self.pair[None]
            back.append(paths.argmax(axis=1).astype(np.uint8))
            best[:n] = paths.max(axis=1) + scores[first[:n] + j]
        tag = (best + self.pair[:, 0]).argmax(axis=1).astype(np.uint8)
        for j in range(int(length[0]) - 1, -1, -1):
            n = int(np.searchsorted(-length, -j, side="left"))
            if j < int(length[0]) - 1:
                m = int(np.searchsorted(-length, -(j + 1), side="left"))
                tag[:m] = back[j][np.arange(m), tag[:m]]
            tags[first[:n] + j] = tag[:n]
        return tags


def fit(sequences: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = 100, rate: float = 0.12, l2: float = 2e-3) -> Field:
    """Maximum conditional likelihood by Adam; sequences (S, L, groups), tags (S, L), mask (S, L) of real tokens.
    Log-space forward and backward sums run over all sequences at once."""
    unary, pair = np.zeros((_N_FEATURES, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(unary), np.zeros_like(pair)]
    s, length, groups = sequences.shape
    real = mask[..., None].astype(float)
    gold = np.eye(3)[tags] * real
    flat = [sequences[:, :, k].ravel() for k in range(groups)]
    empirical_pair = np.zeros((3, 3))
    frame = np.concatenate((np.zeros((s, 1), int), np.where(mask, tags, 0)), axis=1)
    both = np.concatenate((np.ones((s, 1), bool), mask), axis=1)
    for j in range(length):
        np.add.at(empirical_pair, (frame[both[:, j + 1], j], frame[both[:, j + 1], j + 1]), 1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for t in range(1, steps + 1):
        e = unary[sequences].sum(axis=2)
        a, b = np.zeros((length, s, 3)), np.zeros((length, s, 3))
        a[0] = pair[0] + e[:, 0]
        for j in range(1, length):
            a[j] = np.where(mask[:, j, None], lse(a[j - 1][:, :, None] + pair, 1) + e[:, j], a[j - 1])
        for j in range(length - 2, -1, -1):
            b[j] = np.where(mask[:, j + 1, None], lse(pair + (e[:, j + 1] + b[j + 1])[:, None, :], 2), b[j + 1])
        z = lse(a[-1], 1)
        p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2) * real
        g_unary = np.zeros_like(unary)
        off = (gold - p).reshape(-1, 3)
        for k in range(groups):
            for state in range(3):
                g_unary[:, state] += np.bincount(flat[k], off[:, state], minlength=_N_FEATURES)
        expected = np.zeros((3, 3))
        expected[0] += (np.exp(a[0] + b[0] - z[:, None])).sum(axis=0)
        for j in range(1, length):
            joint = np.exp(a[j - 1][:, :, None] + pair + (e[:, j] + b[j])[:, None, :] - z[:, None, None])
            expected += (joint * mask[:, j, None, None]).sum(axis=0)
        for k, (w, g) in enumerate(((unary, g_unary / s - l2 * unary), (pair, (empirical_pair - expected) / s - l2 * pair))):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
            w += rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 2] / (1 - 0.99**t)) + 1e-8)
        np.clip(pair, -6, 6, out=pair)
    return Field(unary.astype(np.float32), pair.astype(np.float32))


#: Names that the base patterns do not know, and values that stand behind such names without being secret.
NAMES = [b"credential", b"credentials", b"auth", b"authorization", b"bearer", b"access key", b"private_key", b"signing-key", b"passphrase", b"pwd", b"client_key", b"session"]
PLAIN_VALUES = [b"none", b"required", b"basic", b"rotated weekly", b"see below", b"default", b"unset", b"optional"]
_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _random(rng: np.random.Generator, alphabet: bytes, least: int, most: int) -> bytes:
    while True:
        out = bytes(rng.choice(np.frombuffer(alphabet, np.uint8), int(rng.integers(least, most + 1))))
        if any(48 <= c <= 57 for c in out):
            return out


def _value(rng: np.random.Generator) -> bytes:
    """A random secret of a shape that base patterns may or may not know."""
    way = int(rng.integers(6))
    if way == 0:
        return _random(rng, b"0123456789ABCDEF", 24, 64)
    if way == 1:
        return _random(rng, b"0123456789abcdef", 16, 23)
    if way == 2:
        return _random(rng, _ALNUM + b"+/", 24, 44)
    if way == 3:
        return bytes(rng.choice([b"sk-", b"ghp_", b"xox-", b"key-", b"pk_"])) + _random(rng, _ALNUM, 16, 36)
    if way == 4:
        return b".".join(_random(rng, _ALNUM + b"_-", 18, 40) for _ in range(3))
    return _random(rng, _ALNUM, 16, 40)


def _harmless(rng: np.random.Generator) -> bytes:
    """Something that looks like a secret and is none."""
    figures = lambda n: _random(rng, b"0123456789", n, n)
    word = lambda: _random(rng, b"aeioubcdlmnrst0", 4, 9).replace(b"0", b"")
    ways = [
        lambda: b"(" + figures(3) + b") " + figures(3) + b"-" + figures(4), lambda: figures(16), lambda: b"-".join(figures(int(rng.integers(1, 6))) for _ in range(int(rng.integers(2, 6)))), lambda: b".".join(figures(int(rng.integers(1, 4))) for _ in range(4)),
        lambda: b"20" + figures(2) + b"-0" + figures(1) + b"-1" + figures(1) + b"T12:" + figures(2), lambda: b"INV-20" + figures(2) + b"-" + figures(5), lambda: b"v" + figures(1) + b"." + figures(2) + b"-rc" + figures(1),
        lambda: b"/".join((word(), b"20" + figures(2), word() + b"-" + figures(2), word())), lambda: word() + b"_" + word() + b"_" + figures(1), lambda: word() + word().title() + word().title() + figures(1),
        lambda: bytes(rng.choice(NAMES)) + bytes(rng.choice([b" = ", b": ", b"="])) + bytes(rng.choice(PLAIN_VALUES)), lambda: b"#" + _random(rng, b"0123456789abcdef", 6, 6), lambda: word() + word() + word() + word(),
        lambda: word().upper() + figures(2), lambda: figures(int(rng.integers(5, 13))), lambda: b"+" + figures(2) + b"-" + figures(3) + b"-" + figures(7)]
    return ways[int(rng.integers(len(ways)))]()


def planted(text: bytes, rng: np.random.Generator, each: int) -> tuple[bytes, list[tuple[int, int]], list[int]]:
    """The text with ``each`` secrets and as many look-alikes put in at spaces and half of its base spans hidden; byte
    spans of all secret values in it, and where look-alikes stand."""
    piece = next(kernel.pieces(pa.array([text.decode()], pa.string())))
    edits: list[tuple[int, int, bytes, bytes, bool]] = []  # from, to, lead, value, secret
    at = 0
    for _, a, kind, b in base_spans(piece, keyword_starts(text)):
        if a < at:
            continue
        at = b
        lead = text[a : ASSIGN.match(text, a).start(2)] if kind == 0 else b""
        if rng.random() < 0.5:
            edits.append((a, b, lead, text[a + len(lead) : b], True))
        else:
            edits.append((a, b, bytes(rng.choice(NAMES)) + b" = \"" if lead else b"", _value(rng), True))
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    taken = np.zeros(len(text) + 1, bool)
    for a, b, *_ in edits:
        taken[a : b + 1] = True
    spaces = spaces[~taken[spaces]]
    spots = rng.choice(spaces, min(2 * each, len(spaces)), replace=False)
    spots[:1] = len(text)  # one at the end
    for i, spot in enumerate(rng.permutation(spots).tolist()):
        if i % 2:
            edits.append((spot, spot, b" ", _harmless(rng), False))
            continue
        quote = bytes(rng.choice([b"", b"\"", b"'"]))
        name = b"" if rng.random() < 0.25 else bytes(rng.choice(NAMES)) + bytes(rng.choice([b" = ", b": ", b"=", b" is ", b" "]))
        edits.append((spot, spot, b" " + name + quote, _value(rng) + quote, True))
    out, secrets, others, at = b"", [], [], 0
    for a, b, lead, value, secret in sorted(edits):
        out += text[at:a] + lead
        if secret:
            secrets.append((len(out), len(out) + len(value.rstrip(b"\"'"))))
        else:
            others.append(len(out))
        out += value
        at = b
    return out + text[at:], secrets, others


def training_windows(text: bytes, each: int = WINDOWS_EACH, reach: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, tags) of at most ``each`` windows of a text: around secrets, look-alikes and other tokens. What is planted is drawn
    from a generator seeded by the text, so a rerun learns the same."""
    rng = np.random.default_rng(zlib.crc32(text))
    whole, secrets, others = planted(text, rng, max(1, min(each // 3, text.count(b" ") // 12)))
    p = next(kernel.pieces(pa.array([whole.decode()], pa.string())))
    starts, ends, _, codes = features(p, keyword_starts(whole))
    gold = np.zeros(len(starts), np.int64)
    centres = [int(np.searchsorted(starts, at)) for at in others[: each // 3]]
    for a, b in secrets:
        inside = np.flatnonzero((starts >= a) & (ends <= b))
        gold[inside] = 2
        gold[inside[:1]] = 1
        centres += inside[:1].tolist()
    odd = np.flatnonzero((codes[:, list(GROUPS).index("shape")] - _OFFSETS["shape"]) & 1)
    rest = np.concatenate((odd[:: max(1, len(odd) // 2)][:2], np.arange(0, len(starts), max(1, len(starts) // 2))[:2])) if len(starts) else odd
    out = []
    for c in list(dict.fromkeys([*rest.tolist(), *rng.permutation(centres).astype(int).tolist()]))[:each]:
        rows = np.arange(max(0, c - reach), min(len(starts), c + reach))
        if len(rows):
            out.append((codes[rows], gold[rows]))
    return out


def train(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, reach: int = 8) -> Field | None:
    """Fit on windows of at most ``sample_rows`` documents that name a secret and as many that do not, those with the smallest
    hash. One pass marks the documents, one cuts the windows of the chosen ones."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named = np.zeros(b.num_rows, bool)
            for p in kernel.pieces(b.column("text")):
                found = keyword_starts(p.data.tobytes())
                named[p.first + p.owner(found)] = True
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(named)], ["doc_id", "named"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, key, codes, tags = [], [], [], []
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, (c, t) in enumerate(training_windows(x.encode())):
                    ids.append(i)
                    key.append(k)
                    codes.append(c.astype(np.int16).tobytes())
                    tags.append(t.astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key, pa.int32()), pa.array(codes, pa.binary()), pa.array(tags, pa.binary())], ["doc_id", "k", "codes", "tags"])

    rows = shared.texts(documents).where("doc_id is not null and text <> ''")
    marked = shared.written(rows.mapInArrow(mark, "doc_id long, named boolean"))
    ids = [marked.where(F.col("named") == flag).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for flag in (True, False)]
    chosen = shared.written(ids[0].union(ids[1]).distinct())  # bounded by the two limits
    cut = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(windows, "doc_id long, k int, codes binary, tags binary")
    got = cut.groupBy("doc_id", "k").agg(F.min(F.struct("codes", "tags")).alias("w")).orderBy("doc_id", "k").select("w.*").collect()  # 2 x sample_rows x WINDOWS_EACH rows at most
    shared.discard(marked, chosen)
    width = 2 * reach
    sequences, tags, mask = np.zeros((len(got), width, len(GROUPS)), np.int32), np.zeros((len(got), width), np.int64), np.zeros((len(got), width), bool)
    for i, r in enumerate(got):
        c = np.frombuffer(r["codes"], np.int16).reshape(-1, len(GROUPS))
        sequences[i, : len(c)], tags[i, : len(c)], mask[i, : len(c)] = c, np.frombuffer(r["tags"], np.int8), True
    return fit(sequences, tags, mask) if len(sequences) and tags.any() else None


# ---------------------------------------------------------------- scanning


def _newline(data: np.ndarray) -> np.ndarray:
    """No secret and no base pattern runs over a newline."""
    return data == 10


def scan_piece(piece: kernel.Piece, field: Field | None) -> list[tuple[int, int, int, int]]:
    """(row, start, kind, end) in code points, sorted by row, start, kind. A long text is worked through in stretches cut at
    newlines, with the file features of the whole."""
    parts = piece.stretches(_newline)
    if len(parts) == 1:
        return _scan(piece, field, None)
    named = any(len(keyword_starts(p.data.tobytes())) for _, p in parts)
    file = file_code(piece, np.zeros(int(named), np.int64))
    out, points = [], 0
    for _, p in parts:
        out += [(row, points + a, kind, points + b) for row, a, kind, b in _scan(p, field, file)]
        points += int(kernel.byte_count(p, _LEAD)[0])
    return out


def _scan(piece: kernel.Piece, field: Field | None, file: np.ndarray | None) -> list[tuple[int, int, int, int]]:
    keywords = keyword_starts(piece.data.tobytes())
    spans = base_spans(piece, keywords)
    if field is not None and len(piece.data):
        starts, ends, owner, codes = features(piece, keywords, file)
        tags = field.decode(field.scores(codes), owner)
        go_on = np.zeros(len(tags), bool)
        go_on[1:] = (tags[1:] == 2) & (tags[:-1] > 0) & (owner[1:] == owner[:-1])
        first = np.flatnonzero((tags > 0) & ~go_on)
        last = np.flatnonzero((tags > 0) & ~np.append(go_on[1:], False))
        covered = np.zeros(len(piece.data) + 1, np.int32)
        for row, a, _, b in spans:
            covered[piece.offsets[row] + a] += 1
            covered[piece.offsets[row] + b] -= 1
        known = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
        free = known[ends[last]] == known[starts[first]]  # no byte of a base span inside
        at = piece.offsets[owner[first[free]]]
        spans += zip(owner[first[free]].tolist(), (starts[first[free]] - at).tolist(), [3] * int(free.sum()), (ends[last[free]] - at).tolist(), strict=True)
    if not spans:
        return spans
    leads = np.concatenate(([0], np.cumsum(_LEAD[piece.data], dtype=np.int64)))
    point = lambda row, at: int(leads[piece.offsets[row] + at] - leads[piece.offsets[row]])
    return sorted((row, point(row, a), kind, point(row, b)) for row, a, kind, b in spans)


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(documents: DataFrame, field: Field | None) -> DataFrame:
    """One row per document with its spans (kind, start, end), sorted by start, then by kind as listed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for p in kernel.pieces(b.column("text")):
                for row, a, k, e in scan_piece(p, field):
                    found[p.first + row].append({"kind": KINDS[k], "start": a, "end": e})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(documents, train(documents))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("crf"))


ORACLE_SQL = None
