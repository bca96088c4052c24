"""License scan by a positional rare-token index over license templates.

Every template word has a posting list of (template, position).  In a file, the
licence words of highest inverse document frequency are looked up first; a
posting and the word's place in the file give a relative position, and the
relative positions that several rare words share are where a template may
start.  A candidate is verified by its mandatory key phrases, which must stand
consecutively near where the template puts them.  Two words of each key phrase
are always among those looked up, so a text that has the phrases is never missed.  Document frequencies of the
licence words are counted over all documents.

Base labels are phrases whose words stand consecutively anywhere.  Defined
results: null or empty text has no words and no labels; repeated rows each get
a row; ties in rarity go by the word's bytes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import alnum_words, batches, id_and_bytes, raw_values, table

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short standing texts of public licences: label, text, and the phrases that must be there.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("apache license version 2 0",),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms",),
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license cc by 4 0",
        ("creative commons attribution",),
    ),
    "cc0": (
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all "
        "of his or her rights to the work worldwide under copyright law",
        ("dedicated the work to the public domain",),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("gnu general public license",),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        ("lesser general public license",),
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge",),
    ),
    "mit-name": ("released under the mit license", ("under the mit license",)),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    "reserved": ("copyright all rights reserved", ("all rights reserved",)),
}
LABELS = {"mit-name": "mit"}
#: Highest-IDF words of each possible template that are looked up in a file, at all their places there.
RARE = 6
#: Words by which a text may differ from a template between two of its words.
SLACK = 3


class TemplateIndex:
    """Postings and key phrases of the templates, with the weight of every licence word."""

    def __init__(self, documents: int, frequency: dict[str, int], templates: dict = TEMPLATES):
        self.words = {name: text.encode().split() for name, (text, _) in templates.items()}
        self.keys = {
            name: [(p.encode().split(), _find(self.words[name], p.encode().split())[0]) for p in phrases] for name, (_, phrases) in templates.items()
        }
        self.postings: dict[bytes, list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            for at, w in enumerate(words):
                self.postings.setdefault(w, []).append((name, at))
        self.weight = {w: log((documents + 1) / (frequency.get(w.decode(), 0) + 1)) for w in self.postings}
        self.total = {name: sum(self.weight[w] for w in words) for name, words in self.words.items()}
        self.key_words = {name: {w for k, _ in found for w in k} for name, found in self.keys.items()}
        rarity = lambda w: (-self.weight[w], w)
        self.ranked = {name: sorted(set(words), key=rarity) for name, words in self.words.items()}
        self.anchors = {name: {w for k, _ in found for w in sorted(set(k), key=rarity)[:2]} for name, found in self.keys.items()}


def _find(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Places where the phrase's words stand consecutively."""
    out, at, first, n = [], -1, phrase[0], len(phrase)
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


def scan(words: list[bytes], index: TemplateIndex, rare: int = RARE, slack: int = SLACK) -> dict[str, float]:
    """Verified templates of one file and the share of each one's weight that stands in place."""
    here = index.postings.keys() & set(words)
    possible = [name for name, need in index.key_words.items() if need <= here]
    if not possible:
        return {}
    chosen = {w for name in possible for w in [*[w for w in index.ranked[name] if w in here][:rare], *index.anchors[name]]}
    tally: Counter = Counter()
    for at, w in enumerate(words):
        if w in chosen:
            for name, place in index.postings[w]:
                tally[name, at - place] += 1
    out: dict[str, float] = {}
    for (name, start), met in tally.items():
        need = index.keys[name]
        if met < min(2, len(index.words[name])):
            continue
        if not all(_stands(words, phrase, start + place, slack) for phrase, place in need):
            continue
        text = index.words[name]
        share = sum(index.weight[w] for k, w in enumerate(text) if 0 <= start + k < len(words) and words[start + k] == w)
        out[name] = max(out.get(name, 0.0), share / index.total[name] if index.total[name] else 0.0)
    return out


def _stands(words: list[bytes], phrase: list[bytes], at: int, slack: int) -> bool:
    return any(words[k : k + len(phrase)] == phrase for k in range(max(0, at - slack), at + slack + 1))


def word_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each licence word stands, over all documents.

    What reaches the driver is a number for each word of the templates.
    """
    vocabulary = {w for text, _ in TEMPLATES.values() for w in text.encode().split()}
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(parts):
        seen: Counter = Counter()
        for b in parts:
            seen[""] += b.num_rows
            for raw in raw_values(b.column(1)):
                seen.update(vocabulary.intersection(alnum_words(raw)))
        yield batches({"word": [w.decode() if w else "" for w in seen], "n": list(seen.values())}, schema)

    counted = id_and_bytes(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counted.collect()}
    return found.pop("", 0), found


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: its words, base phrase places, labels, and the best template share as score."""
    documents, frequency = word_frequencies(docs)
    shared = docs.sparkSession.sparkContext.broadcast((documents, frequency))  # one number per template word
    looked = [(p.encode().split(), label) for p, label in phrases.items()]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(parts):
        index = TemplateIndex(*shared.value)
        for b in parts:
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc, raw in zip(b.column(0).to_pylist(), raw_values(b.column(1))):
                words = alnum_words(raw)
                at = {label: _find(words, phrase) for phrase, label in looked}
                places = [p for found in at.values() for p in found]
                base = {label for label, found in at.items() if found}
                met = scan(words, index)
                labels = base | {LABELS.get(name, name) for name in met}
                values = (
                    doc, len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, max([*met.values(), 0.0])),
                )
                for name, v in zip(rows, values):
                    rows[name].append(v)
            yield batches(rows, schema)

    return id_and_bytes(docs).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return license_scan(table(spark, sf_dir, "documents"))
