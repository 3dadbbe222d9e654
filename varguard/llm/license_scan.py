"""License scans by a positional rare-token index, in DataFrame functions only.

The words of all mandatory phrases get their document frequency over the whole
corpus. Each template is posted under the highest-IDF words of its phrase, with
their positions in the template. A file that holds the phrase holds these words, and
they are the rarest of it in that file too, so which words a file has to look up
is settled once for all files. A file's words that are in the index are looked up once each, in a hash table
of buckets: a posting's place in the file, less its position, is where the template may start. Starts on which two
postings of a template agree are candidates (its other words are looked at no
earlier), and the mandatory phrase must then stand at its place word by word; no phrase is lost, whichever words are
rare in the corpus. All of it happens within the file's row: no join and no shuffle. The work for a file follows from its
hits and their postings, not from the number of templates, and the index is as large
as the template list, whatever the corpus.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: What stands between words, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text and the phrase within it that must stand word by word."""

    label: str
    text: str
    mandatory: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase(self) -> list[str]:
        return self.mandatory.split()

    @property
    def phrase_at(self) -> int:
        w, p = self.words, self.phrase
        return next(i for i in range(len(w)) if w[i : i + len(p)] == p)


# The phrases and labels of the contract.
BASE_PHRASES = [
    Template("mit", "mit license", "mit license"),
    Template("apache", "apache license", "apache license"),
    Template("gpl", "general public license", "general public license"),
]

# Openings of well-known licences and of their usual notices.
TEMPLATES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it", "this program is free software"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
]

#: Rare words of a mandatory phrase in the index; candidates need two of them.
RARE = 3

#: A candidate is one number: the template above, its start (plus an offset, as a start may lie before the text) below.
START_BITS, START_OFFSET = 33, 1 << 32

BUCKETS = "array<array<struct<word:string,postings:array<struct<template:bigint,at:int>>>>>"


def templates_of(table: DataFrame, most: int = 100_000) -> list[Template]:
    """The templates in the rows ``(label, text, mandatory)`` of ``table``: words as in a file, repeated rows once,
    rows without label or phrase left out. A null text stands for the phrase. ValueError where a phrase doesn't stand
    in its text, or at more than ``most`` rows (the index is part of the plan)."""
    words = lambda c: F.array_join(words_of(F.col(c)), " ")
    cleaned = table.select("label", words("mandatory").alias("mandatory"), F.coalesce(words("text"), F.lit("")).alias("text"))
    rows = cleaned.where("label IS NOT NULL AND mandatory <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} licence templates")
    out = sorted((r["label"], r["text"] or r["mandatory"], r["mandatory"]) for r in rows)
    if lost := [label for label, text, phrase in out if f" {phrase} " not in f" {text} "]:
        raise ValueError(f"mandatory phrase not in the text of {lost[:5]}")
    return [Template(*r) for r in out]


def words_of(text: Column) -> Column:
    """The text's words in order. A text of ASCII only is lower-cased by ``lower``, which does the same to it for less."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(low, BETWEEN), "")


def document_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many rows of ``docs`` each word of the vocabulary stands; only
    that many rows reach the driver."""
    # a hash set kept by the plan, where array_intersect would build one for each row
    present = F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(*vocabulary)))
    rows = docs.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def fixed(value: Sequence, ddl: str) -> Column:
    """A nested value as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def rare_positions(template: Template, df: dict[str, int]) -> list[int]:
    """The template positions of its mandatory phrase's highest-IDF words (the first place of each within
    the phrase); ties: the alphabetically first word."""
    first = {w: i for i, w in reversed(list(enumerate(template.phrase, template.phrase_at)))}
    return [first[w] for w in sorted(first, key=lambda w: (df[w], w))[:RARE]]


def posted(templates: Sequence[Template], df: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Index word -> (template, position). A phrase of one distinct word is posted twice, so that it agrees with itself."""
    index: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        at = rare_positions(t, df)
        for i in at if len(at) > 1 else at * 2:
            index.setdefault(t.words[i], []).append((n, i))
    return index


def hash_table(index: dict[str, list[tuple[int, int]]]) -> tuple[Column, int]:
    """The index dealt to buckets by CRC-32 of the word, about one word each, and the number of buckets."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(index)))]
    for word, postings in sorted(index.items()):
        entry = {"word": word, "postings": [{"template": n, "at": i} for n, i in postings]}
        buckets[zlib.crc32(word.encode()) % len(buckets)].append(entry)
    return fixed(buckets, BUCKETS), len(buckets)


def starts(hits: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """Every posting of every hit as template and start in one number, ascending."""
    table, n = hash_table(index)

    def of_hit(hit: Column) -> Column:
        bucket = F.get(table, (F.crc32(hit["word"].cast("binary")) % F.lit(n)).cast("int"))
        postings = F.filter(bucket, lambda e: e["word"] == hit["word"])[0]["postings"]
        return F.transform(postings, lambda p: F.shiftleft(p["template"], START_BITS) + (hit["pos"] - p["at"] + F.lit(START_OFFSET)))

    return F.sort_array(F.flatten(F.transform(hits, of_hit)))


def agreed(starts: Column) -> Column:
    """The numbers that stand more than once in the ascending ``starts``, each once."""
    return F.array_distinct(F.filter(starts, lambda s, i: s == F.get(starts, i + 1)))


def verified(words: Column, candidates: Column, templates: Sequence[Template]) -> Column:
    """``(template, start, part)`` of the candidates whose mandatory phrase stands word by word; ``part`` of the template's
    words stand at their places (0 where the template would start before the text)."""
    texts = fixed([t.words for t in templates], "array<array<string>>")
    phrases = fixed([t.phrase for t in templates], "array<array<string>>")
    phrase_at = fixed([t.phrase_at for t in templates], "array<int>")

    def stands(c: Column) -> Column:
        phrase, first = F.get(phrases, c["template"]), c["start"] + F.get(phrase_at, c["template"])
        return (first >= 0) & (F.slice(words, F.greatest(first, F.lit(0)) + 1, F.size(phrase)) == phrase)

    def with_part(c: Column) -> Column:
        text = F.get(texts, c["template"])
        same = F.zip_with(F.slice(words, F.greatest(c["start"], F.lit(0)) + 1, F.size(text)), text, lambda a, b: a == b)
        part = F.when(c["start"] >= 0, F.size(F.filter(same, lambda x: x)) / F.size(text)).otherwise(F.lit(0.0))
        return F.struct(c["template"].alias("template"), c["start"].alias("start"), part.alias("part"))

    split = F.transform(
        candidates,
        lambda s: F.struct(
            F.shiftright(s, START_BITS).cast("int").alias("template"),
            (s.bitwiseAND(F.lit((1 << START_BITS) - 1)) - F.lit(START_OFFSET)).cast("int").alias("start"),
        ),
    )
    return F.transform(F.filter(split, stands), with_part)


def scan_licenses(
    docs: DataFrame, phrases: Sequence[Template] = BASE_PHRASES, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base`` counts the places of all ``phrases``, ``first_word`` and
    ``last_word`` are the smallest and largest of them (null: none).
    ``labels`` adds those of the templates found. ``score`` is the largest part of a found
    template's words that stand at their places, at least 0.5 where a phrase stands, else 0.

    Every row gives a row, repeated ones too; null and empty texts have no
    words, empty labels and score 0. A very long text is one row like any other, its hits are
    numbers, sorted once. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    both = [*phrases, *templates]
    index = posted(both, document_frequency(docs, sorted({w for t in both for w in t.phrase}), text_col))
    labels = fixed([t.label for t in both], "array<string>")
    words = F.col("_words")
    # a word's own place, or null; the test of membership is a hash set's
    hit = lambda w, i: F.when(w.isin(*index), F.struct(i.alias("pos"), w.alias("word")))
    scan = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words"))
    scan = scan.withColumn("_starts", starts(F.filter(F.transform(words, hit), lambda h: h.isNotNull()), index))
    scan = scan.select("_id", F.size("_words").cast("long").alias("_n"), verified(words, agreed(F.col("_starts")), both).alias("_found"))
    at_base = F.transform(F.filter("_found", lambda f: f["template"] < len(phrases)), lambda f: f["start"])
    scan = scan.select("_id", "_n", "_found", at_base.alias("_base"))
    named = lambda found: F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda f: F.get(labels, f["template"])))), ",")
    best = F.coalesce(F.array_max(F.transform(F.filter("_found", lambda f: f["template"] >= len(phrases)), lambda f: f["part"])), F.lit(0.0))
    return scan.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"),
        F.array_max("_base").cast("long").alias("last_word"),
        named(F.filter("_found", lambda f: f["template"] < len(phrases))).alias("base_labels"),
        named(F.col("_found")).alias("labels"),
        F.round(F.when(F.size("_base") > 0, F.greatest(best, F.lit(0.5))).otherwise(best), 6).alias("score"),
    )
