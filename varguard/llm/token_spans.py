"""Token counts by offset-mapped attribution.

A document is encoded whole and once. Its tokens' spans are then joined with the spans
of its sections by merging the two ascending lists, and a token that crosses
a boundary is allocated by a stated rule. So the sections' counts add up to the document's,
which counts of separately encoded sections do not.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Who gets a token that crosses a boundary: the section with its first or
#: last byte, or the one with most of its bytes (the first of equals).
RULES = ("first", "last", "most")
_encoders: dict[str, tuple] = {}


def encoder(path: str | None):
    """tiktoken's encoder and the byte length of each token; one for each Python worker."""
    import public_tokenizers
    import tiktoken

    name = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if name not in _encoders:
        with open(name, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[name]


def token_ends(text: str, path: str | None) -> np.ndarray:
    """End of each token in bytes of the text; a byte-level token starts where the last one ends."""
    encoding, lengths = encoder(path)
    return np.cumsum(lengths[np.array(encoding.encode_ordinary(text), np.int64)])


def lines(data: bytes) -> np.ndarray:
    """Ends of the lines of a text in bytes; a line keeps its newline."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) or not data else np.append(ends, len(data))


def sentences(data: bytes) -> np.ndarray:
    """Ends of the sentences of a text in bytes: after a newline, or after the
    blank that follows a full stop, exclamation or question mark. The blank belongs to the sentence
    before it, while most tokens hold the blank before their word: such tokens cross."""
    byte = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((byte == 10) | ((byte == 32) & np.isin(np.concatenate([[0], byte[:-1]]), [33, 46, 63]))) + 1
    return ends if len(ends) and ends[-1] == len(data) or not data else np.append(ends, len(data))


def allocate(tokens: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, by their ends in bytes (both cover the text from 0)."""
    starts = np.concatenate([[0], tokens[:-1]])
    first = np.searchsorted(sections, starts, "right")
    last = np.searchsorted(sections, tokens, "left")
    if rule == "first":
        return first
    if rule == "last":
        return last
    two = last == first + 1
    edge = sections[np.minimum(first, len(sections) - 1)]
    owner = np.where(two & (tokens - edge > edge - starts), last, first)
    for i in np.flatnonzero(last > first + 1):
        edges = np.concatenate([[starts[i]], sections[first[i] : last[i]], [tokens[i]]])
        owner[i] = first[i] + np.diff(edges).argmax()
    return owner


def attribute_tokens(
    docs: DataFrame,
    rule: str = "most",
    split: Callable[[bytes], np.ndarray] = lines,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, section, start, stop, n_tokens, n_crossing)``, a row for each
    section of each row of ``docs``: its number from 0, its span in
    characters, the tokens allocated to it, and how many tokens it shares with another.

    ``split`` gives the ends of a text's sections in bytes (lines by default),
    ``vocabulary`` is the path of a byte-level rank file. Null and empty texts have no sections and give one row
    with section and span null and no tokens, so that every row is accounted for. Repeated rows
    and null ids stay. A very long text is encoded whole, in its row; a token that two sections share equally goes by rule
    ``most`` to the first of them. An empty table gives an empty result; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = "id long, section int, start long, stop long, n_tokens long, n_crossing long"

    def rows(i: int | None, data: bytes) -> dict:
        if not data:
            return {"id": [i], "section": [None], "start": [None], "stop": [None], "n_tokens": [0], "n_crossing": [0]}
        ends, tokens = split(data), token_ends(data.decode(), vocabulary)
        n = len(ends)
        starts = np.concatenate([[0], tokens[:-1]])
        first, last = np.searchsorted(ends, starts, "right"), np.searchsorted(ends, tokens, "left")
        across = first != last
        shared = np.zeros(n + 1, np.int64)  # a crossing token counts in first..last
        np.add.at(shared, first[across], 1)
        np.add.at(shared, last[across] + 1, -1)
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        bounds = chars[np.concatenate([[0], ends])]
        return {
            "id": [i] * n,
            "section": np.arange(n, dtype=np.int32),
            "start": bounds[:-1],
            "stop": bounds[1:],
            "n_tokens": np.bincount(allocate(tokens, ends, rule), minlength=n),
            "n_crossing": np.cumsum(shared)[:n],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"id": pa.int64(), "section": pa.int32()}
        for batch in batches:
            made = [rows(i, t.as_buffer().to_pybytes() if t.is_valid else b"") for i, t in zip(batch["id"].to_pylist(), batch["text"], strict=True)]
            columns = {c: pa.concat_arrays([pa.array(m[c], types.get(c, pa.int64())) for m in made]) for c in made[0]} if made else {}
            if columns:
                yield pa.record_batch(columns)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def field_ends(*fields: str | None) -> tuple[str, np.ndarray]:
    """Several fields as one text (joined by newlines that belong to the field
    before them) and the fields' ends in bytes: what ``split`` returns for a record."""
    parts = [(f or "") + ("\n" if i + 1 < len(fields) else "") for i, f in enumerate(fields)]
    return "".join(parts), np.cumsum([len(p.encode()) for p in parts])
