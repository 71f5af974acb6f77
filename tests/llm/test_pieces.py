"""SentencePiece chunks against the library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from stockloom.llm import kernel, pieces

ODD = [" ", "  ", "   ", "a", "b", "the", " the", "\n", "\t", "▁", "é", "😀", "\0", "<s>", "</s>", "<0x41>", "1", "23", ".", ",", "　", "ﬁ", "中", "文", "​", "x" * 30]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def texts(n, longest=25, seed=3):
    r = random.Random(seed)
    return [None, "", " ", "  ", "▁", " ▁ "] + ["".join(r.choice(ODD) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_encode_and_decode(spark, model, library):
    rows = list(enumerate(texts(3000))) + [(1, "a b"), (1, "a b"), (None, "null id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(df, model), model).collect()
    want = sorted(str((i, library.encode(t or ""), library.decode(library.encode(t or "")))) for i, t in rows)
    assert sorted(str((r.doc_id, list(r.ids), r.text)) for r in out) == want
    assert pieces.encode(df.limit(0), model).count() == 0


def test_decode_of_any_ids(spark, model, library):
    r = random.Random(4)
    lists = [[r.randrange(32000 if r.random() < 0.6 else 300) for _ in range(r.randint(0, 6))] for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id long, ids array<int>")
    got = {x.doc_id: x.text for x in pieces.decode(df, model).collect()}
    assert got == {-1: ""} | {i: library.decode(x) for i, x in enumerate(lists)}


def test_long_text_in_stretches(model, library, monkeypatch):
    monkeypatch.setattr(kernel, "BLOCK", 500)
    table = pieces.ChunkTable(model)
    for seed in range(5):
        text = " ".join(texts(400, 8, seed)[1:]).replace("▁", " ")
        piece = next(iter(kernel.pieces(pa.array([text]))))
        assert len(piece.stretches(pieces._chunk_begins)) > 3
        ids, upto = pieces._encoded(piece, table)
        assert ids.tolist() == library.encode(text) and upto.tolist() == [0, len(ids)]


def test_a_full_table_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNKS", 20)
    table = pieces.ChunkTable(model)
    for batch in range(5):
        column = pa.array([t or "" for t in texts(50, seed=batch)])
        column = pa.compute.replace_substring(column, "▁", " ")
        for piece in kernel.pieces(column):
            ids, upto = table.encode(piece)
            assert [ids[a:z].tolist() for a, z in zip(upto, upto[1:], strict=False)] == [library.encode(t) for t in column.to_pylist()]
    assert len(table.known) < 300


def test_query(spark, tmp_path, library):
    rows = list(enumerate(texts(200)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, pieces.op12_sentencepiece(spark, str(tmp_path)).collect())) == want


def test_ids_of_empty_piece(model):
    ids, upto = pieces.ChunkTable(model).encode(kernel.Piece(np.zeros(0, np.uint8), np.zeros(3, np.int64), 0))
    assert len(ids) == 0 and upto.tolist() == [0, 0, 0]
