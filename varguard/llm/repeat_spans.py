"""Substring dedup on a De Bruijn graph of word k-mers.

Each window of k words is an edge from its first k - 1 words to its last. An edge
carries the smallest document in which it starts. Edges that start in a
smaller document too are repeated, and a document's consecutive repeated edges with one source
compact into a path: a span of words and the document it comes from. The paths' words are then
compared, word by word, with the source document's own words.

The graph is joined in blocks, so that edges never become rows of their own: documents are
dealt into blocks by hash. Each block sends its distinct edges to the ranges of the hash space
(an edge once, however many of the block's documents hold it), each range answers with the smallest
document of the edges that are older elsewhere, and blocks meet their answers again. A passage that
stands in a third of all documents thus costs one entry for each block.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seed64, written

#: Bytes of text of a block, and edges of a hash range.
BLOCK_BYTES, RANGE_EDGES = 4 << 20, 1 << 20
#: Source documents whose ids are broadcast (8 MB); more are joined by shuffle.
BROADCAST_IDS = 1 << 20
NO_ID = np.iinfo(np.int64).max


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of several documents, one after the other, and the hash of the window at each."""

    def __init__(self, texts: list[bytes], k: int, bad: np.ndarray):
        self.lists = [t.split() for t in texts]  # bytes: ASCII white space only
        self.counts = np.array([len(w) for w in self.lists], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        code: dict[bytes, int] = {}
        for words in self.lists:
            for w in words:
                code.setdefault(w, len(code))
        of_word = np.array([xxhash.xxh64_intdigest(w) for w in code], np.uint64)
        total = int(self.counts.sum())
        self.codes = np.fromiter((code[w] for words in self.lists for w in words), np.int64, total)
        #: the first word of each window, its document's place and its hash
        valid = np.maximum(self.counts - k + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), valid)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(valid) - valid, valid) + self.starts[self.doc]
        self.hash = self.windows(of_word, k, "edge")
        again = np.isin(self.hash, bad)
        if again.any():  # hashes known to stand for several windows
            self.hash[again] = self.windows(of_word, k, "again")[again]

    def windows(self, of_word: np.ndarray, k: int, name: str) -> np.ndarray:
        base = np.uint64(seed64(name) | 1)
        h = np.zeros(len(self.at), np.uint64)
        word = mixed(of_word + np.uint64(seed64(name, "word")))
        for j in range(k):
            h = h * base + word[self.codes[self.at + j]]
        return mixed(h)


class Block:
    """A block's documents by ascending id (null ids last) and its distinct edges:
    ``edge`` ascending, ``own`` the smallest id that has it."""

    def __init__(self, table: pa.Table, k: int, bad: np.ndarray):
        rows = [(NO_ID if i is None else i, b"" if t is None else t) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)]
        rows.sort()
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.words = Words([r[1] for r in rows], k, bad)
        self.edge, first, self.of_window = np.unique(self.words.hash, return_index=True, return_inverse=True)
        self.own = self.ids[self.words.doc[first]]

    def ranges(self, bits: int) -> np.ndarray:
        """Bounds of the edges of each hash range."""
        top = (self.edge >> np.uint64(64 - bits)).astype(np.int64)
        return np.searchsorted(top, np.arange((1 << bits) + 1))

    def sent(self, lo: int, hi: int) -> np.ndarray:
        """The edges of a range in the order in which they are sent: by id."""
        return lo + np.argsort(self.own[lo:hi], kind="stable")


def pack(edges: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """Edges without the bytes that their range implies, and the steps between
    the ascending ids, byte by byte: nearly all are zero, so shuffles compress them away."""
    ids = np.diff(ids, prepend=0)
    low = edges.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8]
    return np.int64(len(edges)).tobytes() + low.tobytes() + ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    width = 8 - bits // 8
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(data, np.uint8, n * width, 8).reshape(n, width)
    high = np.uint64(part >> (bits % 8)) << np.uint64(8 * width) if bits >= 8 else np.uint64(0)
    ids = np.frombuffer(data, np.uint8, n * 8, 8 + n * width).reshape(8, n).T
    return low.view("<u8").ravel() | high, np.cumsum(np.ascontiguousarray(ids).view("<i8").ravel())


def ask(k: int, bits: int, bad: np.ndarray):
    """A block's edges for each hash range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, k, bad)
        at = block.ranges(bits)
        parts = np.flatnonzero(np.diff(at))
        sent = [block.sent(at[p], at[p + 1]) for p in parts]
        data = [pack(block.edge[i], block.own[i], bits) for i in sent]
        return pa.table({"part": pa.array(parts, pa.int32()), "block": pa.array([key[0].as_py()] * len(parts), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def answer(bits: int):
    """For each block, which of its edges start in a smaller document of
    another block (a bit each, in the order in which they came), in which, and in whose block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        came = [unpack(d, key[0].as_py(), bits) for d in table["data"].to_pylist()]
        edges, ids = (np.concatenate(x) for x in zip(*came, strict=True))
        blocks = np.repeat(np.array(table["block"].to_pylist(), np.int32), [len(e) for e, _ in came])
        order = np.lexsort((blocks, ids, edges))
        new = np.concatenate([[True], edges[order][1:] != edges[order][:-1]])
        best = np.empty(len(ids), np.int64)
        best[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        least, holder = ids[best], blocks[best]
        older = least < ids
        data, at = [], 0
        for e, _ in came:
            flag = older[at : at + len(e)]
            found = least[at : at + len(e)][flag].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
            data.append(np.packbits(flag).tobytes() + found + holder[at : at + len(e)][flag].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())
            at += len(e)
        return pa.table({"block": table["block"], "part": pa.array([key[0].as_py()] * len(came), pa.int32()), "answer": pa.array(data, pa.binary())})

    return run


RESULT = "row_kind string, doc_id long, n_words long, n_removed long, kept_sha256 string, source_id long, source_block int, path binary"


def compact(k: int, bits: int, bad: np.ndarray):
    """A block's documents (kind 'doc') and its distinct paths with the
    document they come from (kind 'path')."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return empty()
        block = Block(docs, k, bad)
        words, at = block.words, block.ranges(bits)
        source, holder = block.own.copy(), np.full(len(block.own), key[0].as_py(), np.int32)
        for part, data in zip(answers["part"].to_pylist(), answers["answer"].to_pylist(), strict=True):
            lo, n = at[part], at[part + 1] - at[part]
            flag = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8)), count=n).astype(bool)
            found = np.frombuffer(data, np.uint8, offset=-(-n // 8)).reshape(12, -1)  # 8 bytes of the id, 4 of its block
            edges = block.sent(lo, lo + n)[flag]
            source[edges] = np.ascontiguousarray(found[:8].T).view("<i8").ravel()
            holder[edges] = np.ascontiguousarray(found[8:].T).view("<i4").ravel()
        comes, where = source[block.of_window], holder[block.of_window]
        mine = block.ids[words.doc]
        repeated = (comes < mine) & (mine != NO_ID)
        # every word of a repeated window goes
        cover = np.zeros(len(words.codes) + k + 1, np.int64)
        np.add.at(cover, words.at[repeated], 1)
        np.add.at(cover, words.at[repeated] + k, -1)
        keep = np.cumsum(cover)[: len(words.codes)] == 0
        # consecutive repeated windows of a document with one source are one path
        at_window = np.flatnonzero(repeated)
        paths: set[tuple[int, int, bytes]] = set()
        if len(at_window):
            same = (np.diff(words.doc[at_window]) == 0) & (np.diff(comes[at_window]) == 0) & (np.diff(where[at_window]) == 0)
            breaks = ~same | (np.diff(words.at[at_window]) != 1)
            first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
            last = np.concatenate([first[1:], [len(at_window)]]) - 1
            for a, b in zip(at_window[first].tolist(), at_window[last].tolist(), strict=True):
                doc = words.doc[a]
                lo, hi = words.at[a] - words.starts[doc], words.at[b] - words.starts[doc] + k
                paths.add((int(comes[a]), int(where[a]), b" ".join(words.lists[doc][lo:hi])))
        out = []
        for i, (id_, found) in enumerate(zip(block.ids.tolist(), words.lists, strict=True)):
            left = keep[words.starts[i] : words.starts[i] + len(found)]
            kept = hashlib.sha256(b" ".join(compress(found, left.tolist()))).hexdigest()
            out.append(("doc", None if id_ == NO_ID else id_, len(found), len(found) - int(left.sum()), kept, None, None, None))
        out += [("path", None, None, None, None, *p) for p in sorted(paths)]
        return as_table(out)

    return run


NAMES = ["row_kind", "doc_id", "n_words", "n_removed", "kept_sha256", "source_id", "source_block", "path"]
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]


def as_table(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(NAMES, TYPES, strict=True))})


def empty() -> pa.Table:
    return as_table([])


def verify(k: int, bad: np.ndarray):
    """The hashes of paths' windows that the source document doesn't hold word
    by word: two different windows with one hash."""

    def run(key: tuple, docs: pa.Table, paths: pa.Table) -> pa.Table:
        wrong: set[int] = set()
        texts: dict[int, list[bytes]] = {}
        for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            texts.setdefault(i, []).append(t or b"")
        asked: dict[int, list[bytes]] = {}
        for s, p in zip(paths["source_id"].to_pylist(), paths["path"].to_pylist(), strict=True):
            asked.setdefault(s, []).append(p)
        for s, found in asked.items():
            own = texts.get(s, [])
            w = Words(own + found, k, bad)
            theirs = w.doc >= len(own)
            # each hash's windows must be one window
            order = np.argsort(w.hash, kind="stable")
            h, at = w.hash[order], w.at[order]
            same = h[1:] == h[:-1]
            differ = np.zeros(max(0, len(h) - 1), bool)
            for j in range(k):
                differ |= w.codes[at[1:] + j] != w.codes[at[:-1] + j]
            wrong.update(h[1:][same & differ].tolist())
            wrong.update(np.setdiff1d(w.hash[theirs], w.hash[~theirs]).tolist())
        return pa.table({"edge": pa.array(np.array(sorted(wrong), np.uint64).view(np.int64))})

    return run


def remove_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for each row of ``docs``.

    A word goes if a window of ``k`` words that covers it also starts, word
    for word, in a document with a smaller id; all windows are judged on the input.
    Null and empty texts have no words. Rows with a null id have no
    order: nothing of them goes, and they are nobody's source. Rows that repeat an id are no smaller
    than each other, so copies under one id both stay; they are dealt to blocks by id and text. A very long text is one row
    of one block, whole. An empty table gives an empty result; other columns are ignored.

    Hashes are 64 bits. Every path is verified, and windows that only share a
    hash get another one in a further round, until none is wrong (none are expected
    below some billion windows).
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(16, -(-size // BLOCK_BYTES))
    bits = max(8, int(np.ceil(np.log2(max(1, size / 6 / RANGE_EDGES)))))
    # by id and text: rows that share an id, or have none, spread over all blocks
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = source.withColumn("block", block)
    bad = np.array([], np.uint64)
    while True:
        asked = dealt.groupBy("block").applyInArrow(ask(k, bits, bad), "part int, block int, data binary")
        answers = asked.groupBy("part").applyInArrow(answer(bits), "block int, part int, answer binary")
        rows = written(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(compact(k, bits, bad), RESULT), "repeats")
        paths = rows.where("row_kind = 'path'").select(F.col("source_block").alias("block"), "source_id", "path").distinct()
        wanted = paths.select("block", F.col("source_id").alias("doc_id")).distinct()
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        sources = dealt.join(wanted, ["block", "doc_id"], "left_semi").select("doc_id", "text", "block")
        wrong = sources.groupBy("block").cogroup(paths.groupBy("block")).applyInArrow(verify(k, bad), "edge long")
        found = [r["edge"] for r in wrong.distinct().collect()]
        if not found:
            break
        bad = np.union1d(bad, np.array(found, np.int64).view(np.uint64))
    return rows.where("row_kind = 'doc'").select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256")
