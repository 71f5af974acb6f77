"""Quality rules: document statistics, base rules, and boosted trees held as flat numpy node arrays.

The statistics of a text are computed from its bytes in Arrow batches. A gradient-boosted ensemble,
fitted on at most ``sample_rows`` labelled documents (a documented bound; the sample is the rows with
the smallest hash of doc_id), gives the final verdict. Chosen features carry monotonic constraints:
more symbols, shouting or repetition can never raise a document's score.

Edge cases: a null or empty text has zero words and fails the base rules; a doc_id that occurs twice
is judged twice; other columns are ignored by ``judge`` and passed through by ``filter_documents``;
a doc_id with several labels counts as the worst of them;
without labelled rows the ensemble is empty and only the base rules decide. A very long text is worked on whole: 16 bytes of
memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import kernel

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False  # every byte but UTF-8 continuations: one per code point

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name -> sign of the constraint on the score (-1: may only lower it, 0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": -1, "loud_per_word": -1, "stops_per_word": 0, "unique_share": 0}

SAMPLE_ROWS = 20_000
MIN_SCORE = 0.35


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics (int64 by name) and the feature matrix of a column of texts."""
    out = {k: np.zeros(len(column), np.int64) for k in STATS}
    feats = np.zeros((len(column), len(FEATURES)), np.float64)
    for p in kernel.pieces(column):
        rows = slice(p.first, p.first + p.n)
        starts, ends, owner = p.words()
        hash_of = p.hasher()
        hashes = hash_of(starts, ends)
        n = kernel.count_by(owner, p.n)
        out["n_words"][rows] = n
        out["word_chars"][rows] = kernel.byte_count(p, _LEAD & ~kernel.IS_SPACE)  # every other code point stands in a word
        out["n_symbols"][rows] = kernel.byte_count(p, _SYMBOL)
        out["n_dup_lines"][rows] = _repeated_lines(p, starts, hash_of)
        out["n_repeat_words"][rows] = _repeated_words(p, hashes, owner)
        w = np.maximum(n, 1)
        alpha = np.maximum(kernel.byte_count(p, _ALPHA), 1)
        lines = 1 + kernel.byte_count(p, np.arange(256) == 10)
        distinct = np.zeros(p.n, np.int64)
        if len(hashes):
            keyed = np.unique(kernel.mix(hashes + owner.astype(np.uint64) * kernel.WINDOW_KEYS[60]), return_index=True)[1]
            distinct = kernel.count_by(owner[keyed], p.n)
        feats[rows] = np.stack([np.log1p(n), out["word_chars"][rows] / w, out["n_symbols"][rows] / w, out["n_dup_lines"][rows] / lines, out["n_repeat_words"][rows] / w, kernel.byte_count(p, _UPPER) / alpha, kernel.byte_count(p, _DIGIT) / alpha, kernel.byte_count(p, _LOUD) / w, kernel.byte_count(p, _STOP) / w, distinct / w], axis=1)
    return out, feats


def _repeated_lines(p: kernel.Piece, word_starts: np.ndarray, hash_of) -> np.ndarray:
    """Lines that hold a word and equal an earlier line of the same text."""
    if not len(p.data):
        return np.zeros(p.n, np.int64)
    breaks = np.flatnonzero(p.data == 10)
    full = p.offsets[:-1][p.offsets[:-1] < p.offsets[1:]]
    starts = np.unique(np.concatenate((full, breaks + 1)))
    starts = starts[starts < len(p.data)]
    ends = np.minimum(np.concatenate((starts[1:], [len(p.data)])), len(p.data))
    ends = ends - (p.data[ends - 1] == 10)
    starts, ends = starts[starts < ends], ends[starts < ends]
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    if not len(starts):
        return np.zeros(p.n, np.int64)
    owner = p.owner(starts)
    keys = kernel.mix(hash_of(starts, ends) + owner.astype(np.uint64) * kernel.WINDOW_KEYS[61])
    first = np.unique(keys, return_index=True)[1]
    again = np.ones(len(keys), bool)
    again[first] = False
    return kernel.count_by(owner[again], p.n)


def _repeated_words(p: kernel.Piece, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words inside three-word windows that occur at least twice in their text."""
    window, first = kernel.windows(hashes, owner, 3)
    if not len(window):
        return np.zeros(p.n, np.int64)
    keys = kernel.mix(window + owner[first].astype(np.uint64) * kernel.WINDOW_KEYS[62])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(ranked), bool)
    same[1:] |= ranked[1:] == ranked[:-1]
    same[:-1] |= ranked[1:] == ranked[:-1]
    covered = np.zeros(len(hashes), bool)
    at = first[order[same]]
    for j in range(3):
        covered[at + j] = True
    return kernel.count_by(owner[covered], p.n)


# ---------------------------------------------------------------- boosted trees


class Trees:
    """An ensemble as flat arrays: at node i, go to left[i] if x[feature[i]] <= cut[i] else right[i]; a leaf points to itself."""

    def __init__(self, roots, feature, cut, left, right, value, base: float, depth: int) -> None:
        self.roots, self.feature, self.cut, self.left, self.right, self.value, self.base, self.depth = roots, feature, cut, left, right, value, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of good quality, all rows and trees stepping down together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs=tuple(FEATURES.values()), trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: int = 5) -> Trees:
    """Second-order boosting on binned features. A split on a constrained feature is allowed only if its
    children's values keep the sign, and the midpoint bounds all leaves below on either side."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 1 - 1e-3
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(y) else []
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(y) else None
    roots, feature, cut, left, right, value = [], [], [], [], [], []
    f = np.full(len(y), base)

    def leaf(v: float) -> int:
        i = len(feature)
        for lst, item in ((feature, 0), (cut, np.inf), (left, i), (right, i), (value, v)):
            lst.append(item)
        return i

    def grow(rows, g, h, level, low, high) -> int:
        v = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        node = leaf(rate * v)
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                bad = (nl < least) | (len(rows) - nl < least)
                if signs[j] < 0:
                    bad |= vl < vr
                elif signs[j] > 0:
                    bad |= vl > vr
                gain[bad] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            goes = binned[rows, j] <= k
            mid = (vl + vr) / 2
            lows, highs = [low, low], [high, high]
            if signs[j] < 0:
                lows[0], highs[1] = mid, mid
            elif signs[j] > 0:
                highs[0], lows[1] = mid, mid
            a = grow(rows[goes], g, h, level + 1, lows[0], highs[0])
            b = grow(rows[~goes], g, h, level + 1, lows[1], highs[1])
            feature[node], cut[node], left[node], right[node] = j, float(cuts[j][k]), a, b
        return node

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            roots.append(grow(np.arange(len(y)), q - y, np.maximum(q * (1 - q), 1e-6), 0, -4.0, 4.0))
            model = Trees(*(np.array(a) for a in (roots[-1:], feature, cut, left, right, value)), 0.0, depth)
            z = model.score(x)
            f += np.log(z / (1 - z))
    return Trees(np.array(roots, np.int64), *(np.array(a) for a in (feature, cut, left, right, value)), base, depth)


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample_rows`` labelled documents, those with the smallest hash of doc_id."""
    chosen = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample_rows bounds the broadcast

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text"))[1]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "quality": b.column("quality"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))})

    quality = dict(labels.dtypes)["quality"]
    got = picked.mapInArrow(features, f"doc_id long, quality {quality}, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return x, got["quality"].to_numpy(np.float64)


def judge(documents: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, min_score: float = MIN_SCORE, keep: bool = False) -> DataFrame:
    """One row per document: the base statistics, base_failed, score and kept. ``keep``: the documents' own columns instead, kept rows only."""
    x, y = training_rows(documents, labels, sample_rows)
    order = np.lexsort([*x.T, y]) if len(y) else []
    model = fit_trees(x[order], y[order])
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"

    def verdict(column: pa.Array) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        base, feats = statistics(column)
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        score = model.score(feats)
        return base, failed, score, ~failed & (score >= min_score)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, failed, score, kept = verdict(b.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **base, "base_failed": failed, "kept": kept, "score": score})

    at = documents.columns.index("text")

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdict(b.column(at))[3]))

    if keep:
        return documents.mapInArrow(kept_rows, documents.schema)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)


def filter_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judge(documents, labels, keep=True, **options)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(documents, labels).select("doc_id", *STATS, "base_failed", "kept", "score")


#: The base columns only; the verdict of the trees has no SQL form.
ORACLE_SQL = None
