"""SentencePiece encoding and decoding: Viterbi over an Aho-Corasick automaton.

The automaton holds all pieces of the vocabulary. One pass over the text
yields, at every position, the pieces that end there (its output links), and each relaxes
the best score of that position; the best path is then read backwards.
Characters without a piece fall back to their bytes, so decoding gives the text back.

Pieces hold the word mark only at their start, so the best path of a text is made of the best
paths of its words, which are remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words remembered by each Python worker, twice over: when so many are new, those
#: not used since the last time are forgotten.
MEMO = 150_000
#: Bytes of identifiers after which a batch is sent on.
FLUSH = 1 << 24


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores by id (None: control, unknown or byte piece), and the ids of the bytes."""

    pieces: tuple[tuple[str, float] | None, ...]
    byte_ids: tuple[int, ...]


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte fallback (the
    installed public one by default). Read on the driver; a few MB."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = lambda i: not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))
    pieces = tuple((sp.id_to_piece(i), float(sp.get_score(i))) if normal(i) else None for i in range(sp.get_piece_size()))
    if any(p and MARK in p[0].lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds the word mark after another character")
    return Vocabulary(pieces, tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)))


class Tokenizer:
    """Encoder and decoder of one Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(vocabulary.pieces):
            if p:
                self.automaton.add_word(p[0], (len(p[0]), i, p[1]))
        self.automaton.make_automaton()
        self.byte_ids = vocabulary.byte_ids
        self.alone = {p[0] for p in vocabulary.pieces if p and len(p[0]) == 1}
        # no path crosses a newline that no piece holds
        self.cuts_lines = not any(p and "\n" in p[0] for p in vocabulary.pieces)
        self.newline = array("i", [self.byte_ids[10]]).tobytes()
        self.unknown = min(p[1] for p in vocabulary.pieces if p) - 10.0
        self.text_of = [p[0].replace(MARK, " ").encode() if p else b"" for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.text_of[i] = bytes([b])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def best_path(self, marks: int, word: str) -> list[int]:
        """Ids of ``marks`` word marks followed by ``word`` (whose own marks,
        if any, are text and take their bytes). Of equal scores the longer last piece wins."""
        text = MARK * marks + word
        if MARK not in word and self.alone.issuperset(text):
            return self.plain_path(text)
        literal = MARK in word
        n = len(text)
        score = [0.0] + [0.0] * n
        back: list[tuple[int, int] | None] = [None] * (n + 1)  # piece length and id; id -1: bytes
        done, alone = 0, False  # positions up to done are final, but for bytes at done + 1

        def close(to: int) -> None:
            nonlocal done, alone
            while done < to:  # no piece is this one character: its bytes are a way too
                end = done + 1
                if not alone:
                    s = score[done] + self.unknown
                    if back[end] is None or s > score[end]:
                        score[end], back[end] = s, (1, -1)
                done, alone = end, False

        for last, (length, i, s) in self.automaton.iter(text):
            close(last)
            start = last + 1 - length
            if literal and text.find(MARK, max(start, marks), last + 1) >= 0:
                continue
            s += score[start]
            if back[last + 1] is None or s > score[last + 1]:
                score[last + 1], back[last + 1] = s, (length, i)
            alone = alone or length == 1
        close(n)
        ids: list[int] = []
        while n:
            length, i = back[n]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.byte_ids[b] for b in reversed((text[n - 1]).encode())]
            n -= length
        return ids[::-1]

    def plain_path(self, text: str) -> list[int]:
        """The best path where each character is a piece too: bytes are never needed."""
        n = len(text)
        score = [0.0] + [-math.inf] * n
        back: list = [None] * (n + 1)
        for last, piece in self.automaton.iter(text):
            s = score[last + 1 - piece[0]] + piece[2]
            if s > score[last + 1]:
                score[last + 1], back[last + 1] = s, piece
        ids: list[int] = []
        while n:
            ids.append(back[n][1])
            n -= back[n][0]
        return ids[::-1]

    def packed(self, marks: int, word: str) -> bytes:
        key = word if marks == 1 else f"{marks} {word}"  # words hold no space
        got = self.memo.get(key)
        if got is None and self.cuts_lines and "\n" in word:
            parts = word.split("\n")
            return self.newline.join([self.packed(marks, parts[0])] + [self.packed(0, x) if x else b"" for x in parts[1:]])
        if got is None:
            got = self.older.get(key)
            if got is None:
                got = array("i", self.best_path(marks, word)).tobytes()
            if len(word) < 64:
                if len(self.memo) >= MEMO:
                    self.older = self.memo.copy()
                    self.memo.clear()  # the same dict: encode holds on to it
                self.memo[key] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32. A word mark is put before the text; the empty text has no ids."""
        if not text:
            return b""
        out, marks = [], 0
        memo = self.memo.get
        for word in text.split(" "):
            marks += 1
            if word:
                out.append((marks == 1 and memo(word)) or self.packed(marks, word))
                marks = 0
        if marks:
            out.append(self.packed(marks, ""))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text's UTF-8 bytes; unknown and control ids give nothing."""
        text = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return text[1:]  # the first mark


_worker: dict[int, Tokenizer] = {}


def tokenizer(shared) -> Tokenizer:
    """One automaton for each Python worker and vocabulary."""
    if shared.id not in _worker:
        _worker.clear()
        _worker[shared.id] = Tokenizer(shared.value)
    return _worker[shared.id]


class Shared:
    """A broadcast vocabulary with a name to remember its automaton by."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def share(df: DataFrame, vocabulary: Vocabulary) -> Shared:
    return Shared(df.sparkSession.sparkContext.broadcast(vocabulary), vocabulary_digest(vocabulary))


def vocabulary_digest(vocabulary: Vocabulary) -> str:
    """A name that two vocabularies share only if all their pieces, scores and byte ids are equal."""
    return hashlib.sha256(repr(vocabulary).encode("utf-8", "surrogatepass")).hexdigest()


def encode_texts(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", check: bool = True, place_col: str | None = None
) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)`` of each row's whole text, and the long ``place_col`` where given.

    ``round_trip`` says whether decoding the ids gave the text's very bytes
    (null without ``check``). Null texts have null ids, count and check; empty ones have no ids. Repeated
    rows and null ids stay. A very long text is encoded whole, in its row; of equal scores the longer last piece wins.
    An empty table gives an empty result; other columns are ignored.
    """
    shared = share(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(shared)
        for batch in batches:
            texts, size, start, rows = batch["text"], 0, 0, []
            for at, text in enumerate(texts):
                data = text.as_buffer().to_pybytes() if text.is_valid else None
                ids = None if data is None else made.encode(data.decode())
                rows.append((ids, None if data is None or not check else made.decode(ids) == data))
                size += len(ids or b"")
                if size >= FLUSH or at + 1 == len(texts):
                    yield out(batch.slice(start, len(rows)), rows)
                    start, size, rows = at + 1, 0, []

    def out(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        sizes = np.array([len(r[0] or b"") // 4 for r in rows], np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([r[0] is None for r in rows] + [False]))
        values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(r[0] or b"" for r in rows))])
        return pa.record_batch(
            {
                "id": batch["id"],
                "n_tokens": pa.array([None if r[0] is None else len(r[0]) // 4 for r in rows], pa.int64()),
                "ids": pa.ListArray.from_arrays(offsets, values),
                "round_trip": pa.array([r[1] for r in rows], pa.bool_()),
            }
            | ({"place": batch["place"]} if place_col else {})
        )

    place = [F.col(place_col).cast("long").alias("place")] if place_col else []
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *place)
    made = texts.mapInArrow(run, "id long, n_tokens long, ids array<int>, round_trip boolean" + (", place long" if place_col else ""))
    return made.withColumnsRenamed({"id": id_col} | ({"place": place_col} if place_col else {}))


def decode_ids(table: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)``: the inverse of :func:`encode_texts`; null ids give a null text."""
    shared = share(table, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(shared)
        for batch in batches:
            texts = [None if x is None else made.decode(np.array(x, np.int32).tobytes()).decode(errors="replace") for x in batch["ids"].to_pylist()]
            yield pa.record_batch({"id": batch["id"], "text": pa.array(texts, pa.string())})

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
