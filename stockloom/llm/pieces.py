"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of a model continues over a whitespace marker, a text falls into chunks, each a run of markers and the word behind it, that
are segmented apart from one another. Each task keeps a table of the chunks it has met: a batch's chunks are numbered by an Arrow
dictionary, only those missing from the table are segmented by the library, and the ids are joined back to their positions by number.
The table is bounded (``CHUNKS`` entries of at most ``LONGEST`` bytes) and emptied when full, which costs time and changes nothing. Ids are
not joined through a shuffle, since that would move every word of the corpus.

Decoding reads the bytes of the pieces from a table by id; sequences that do not begin with a marker or are no whole UTF-8 (which
encoding never gives) go to the library itself. Long texts are cut at chunks and worked a stretch at a time.

Edge cases: null and empty texts have no ids and decode to an empty text; a marker that stands in a text itself counts as a space, as
for the library; rows that repeat a doc_id each give a row; an empty table gives an empty result; other columns are ignored.
A model with pieces that cross a marker, other normalisation, or merged spaces is refused.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import kernel, shared

MARKER = "▁"
CHUNKS, LONGEST = 1 << 19, 256
#: Ids decoded at once.
IDS = 1 << 20


class ChunkTable:
    """Ids of distinct chunks, kept from batch to batch of a task."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError(f"{path}: a piece continues over a whitespace marker")
        alone = self.library.piece_to_id(MARKER)
        if self.library.encode("a b  c ", out_type=str)[0][:1] != MARKER or self.library.decode(self.library.encode(" A  ½ ")) != " A  ½ ":
            raise ValueError(f"{path}: the model changes texts before it segments them")
        self.alone = np.array([alone], np.int32).tobytes()
        self.known: dict[str, bytes] = {}
        texts = [self._bytes(i, p) for i, p in enumerate(pieces)]
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.begins = self.ends - np.array([len(t) for t in texts])
        self.marked = np.array([p.startswith(MARKER) for p in pieces])

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.library.is_control(i):
            return b""
        return self.library.decode([self.alone_id, i]).encode() if self.library.is_unknown(i) else piece.replace(MARKER, " ").encode()

    @property
    def alone_id(self) -> int:
        return int(np.frombuffer(self.alone, np.int32)[0])

    def ids_of(self, keys: list[str]) -> list[bytes]:
        """Ids (32-bit, as bytes) of each distinct key: a chunk without its first marker."""
        missing = [k for k in keys if k not in self.known and k]
        fresh = {k: np.array(v, np.int32).tobytes() for k, v in zip(missing, self.library.encode(missing, num_threads=1) if missing else [], strict=True)}
        if "" in keys:
            fresh[""] = self.alone
        out = [fresh[k] if k in fresh else self.known[k] for k in keys]
        if len(self.known) + len(fresh) > CHUNKS:
            self.known.clear()
        self.known.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST)
        return out

    def encode(self, piece: kernel.Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, and where each text's ids begin."""
        data, n = piece.data, len(piece.data)
        space = data == 32
        first = np.zeros(n, bool)
        first[piece.offsets[:-1][piece.offsets[:-1] < n]] = True
        begins = np.flatnonzero(first | (space & ~np.concatenate((space[:1], space[:-1]))) if n else first)
        ends = np.append(begins[1:], n)
        skipped = ~first[begins]  # the space before a word is its marker; before the first word of a text the library puts one
        inside = np.ones(n, bool)
        inside[begins[skipped]] = False
        offsets = np.concatenate(([0], np.cumsum(ends - begins - skipped)))
        keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        number = keys.indices.to_numpy(zero_copy_only=False)
        ids = self.ids_of([k.decode("utf-8", "replace") for k in keys.dictionary.to_pylist()])
        length = np.array([len(x) >> 2 for x in ids], np.int64)
        start = np.cumsum(length) - length
        flat, length, start = np.frombuffer(b"".join(ids), np.int32), length[number], start[number]
        upto = np.concatenate(([0], np.cumsum(length)))
        return flat[np.repeat(start - upto[:-1], length) + np.arange(upto[-1])], upto[np.searchsorted(begins, piece.offsets)]

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        try:
            if self.marked[ids[0]]:
                return b"".join(self._text(ids[a : a + IDS]) for a in range(0, len(ids), IDS))[1:].decode()
        except UnicodeDecodeError:
            pass
        return self.library.decode(ids.tolist())

    def _text(self, ids: np.ndarray) -> bytes:
        length = self.ends[ids] - self.begins[ids]
        upto = np.cumsum(length)
        return self.blob[np.repeat(self.begins[ids] - (upto - length), length) + np.arange(upto[-1])].tobytes()


@functools.cache
def table(path: str) -> ChunkTable:
    return ChunkTable(path)


def _chunk_begins(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data), bool)
    out[1:] = (data[1:] == 32) & (data[:-1] != 32)
    return out


def _encoded(piece: kernel.Piece, chunks: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    parts = piece.stretches(_chunk_begins)
    if len(parts) == 1:
        return chunks.encode(piece)
    ids = []
    for at, part in parts:  # a later stretch begins with the space that marks its first word; as a text of its own it would get another
        part = kernel.Piece(part.data[1:], np.array([0, len(part.data) - 1]), 0) if at else part
        ids.append(chunks.encode(part)[0] if len(part.data) else np.frombuffer(chunks.alone, np.int32))
    flat = np.concatenate(ids)
    return flat, np.array([0, len(flat)])


def encode(documents: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, ids (array of int), as the library gives them for the whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = table(model)
        for b in batches:
            doc_ids = b.column("doc_id")
            for piece in kernel.pieces(pc.replace_substring(b.column("text"), MARKER, " ")):
                ids, upto = _encoded(piece, chunks)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(piece.first, piece.n), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return shared.texts(documents).mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Rows of ``encoded`` (doc_id, ids; null ids count as none) with the text that the library's decode gives: doc_id, ids, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = table(model)
        for b in batches:
            for a in range(0, b.num_rows, kernel.SLICE_ROWS):
                part = b.slice(a, kernel.SLICE_ROWS)
                lists = part.column("ids")
                flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths, dtype=np.int64)
                texts = [chunks.decode(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(rows, "doc_id long, ids array<int>, text string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(shared.read(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


ORACLE_SQL = None
