"""Licence scans by a positional index of rare words.

Templates are passages of licences with a key phrase each, and short names, which are key phrases as a
whole. The index posts every template word with its places in the templates. Of a file's licence words
only those of highest inverse document frequency (over all files) are looked up: for each template that
the file's words could cover, the FEW rarest it shares with the file. The template's places in the file
are where at least half of these agree, each within SLACK words, so whatever is looked up is intersected
by relative position. Each such place is then verified: the share of the template's words that stand
within SLACK of their places must be `least_cover` or more, and the key phrase must stand there word for
word within SLACK, or, where the share is CLOSE or more, with all its words near their places but for
at most one, which is no number (so a changed notice is found, and version 2 is never version 3). Words may
be changed, missing or put in. The score is the largest share. Short names and base phrases are found
wherever their words stand consecutively, by their rarest word and the others in turn.

Defined cases: a NULL or empty text has no word, no label and score 0. NULL ids and repeated rows
get a result row each. Extra columns aren't read; a result column that would bear the id's name gets an
underscore before it. An empty table gives no row. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import with_id

FEW = 6
SLACK = 4
LEAST_COVER = 0.6
CLOSE = 0.9


@dataclass(frozen=True)
class Template:
    """A licence's label, its words, the key phrase's words and place within them, and whether it is a base phrase."""

    label: str
    words: tuple[bytes, ...]
    phrase: tuple[bytes, ...]
    lead: int
    base: bool = False


def template(label: str, text: str, phrase: str | None = None, base: bool = False) -> Template:
    words, key = tuple(text.encode().split()), tuple((phrase or text).encode().split())
    lead = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
    if lead is None:
        raise ValueError(f"the key phrase isn't in the template: {phrase}")
    return Template(label, words, key, lead, base)


#: The base phrases and their labels.
BASE = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
)

#: Passages of public licences and of the usual notices for them, in lower case and without marks.
PASSAGES = (
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "deal in the software without restriction"),
    template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    template("gpl-3", "gnu general public license version 3"),
    template("gpl-2", "gnu general public license version 2"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
    template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    template("cc0", "creative commons zero"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-nd", "cc by nd"),
    template("epl", "eclipse public license"),
    template("boost", "boost software license"),
)

#: Short names of licences as notices and identifiers spell them.
NAMES = {
    "mit": ("mit license", "spdx license identifier mit"),
    "apache-2": ("apache license 2 0", "apache license v2", "apache 2 0"),
    "gpl-3": ("gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gpl 3 0", "gplv3"),
    "gpl-2": ("gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gpl 2 0", "gplv2"),
    "lgpl": ("lgpl 2 1", "lgpl 3 0", "lgplv2", "lgplv3"),
    "agpl": ("agpl 3 0", "agplv3"),
    "mpl-2": ("mozilla public license 2 0", "mozilla public license version 2 0", "mpl 2 0"),
    "bsd": ("bsd 2 clause", "bsd 3 clause", "bsd license"),
    "isc": ("isc license", "spdx license identifier isc"),
    "unlicense": ("spdx license identifier unlicense",),
    "zlib": ("zlib license", "spdx license identifier zlib"),
    "cc0": ("cc0 1 0",),
    "epl": ("epl 2 0",),
    "boost": ("bsl 1 0",),
}

TEMPLATES = BASE + PASSAGES + tuple(template(label, name) for label, names in NAMES.items() for name in names)

_LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Words of a text in lower case: runs of digits, a-z and everything beyond ASCII."""
    return text.translate(_LOWER_WORDS).split()


def frequencies(vocabulary: frozenset[bytes]):
    """Arrow function: texts to (word, df) of one task, and the number of texts under the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        for b in batches:
            df[b""] += b.num_rows
            for text in b.column(0).cast(pa.binary()).to_pylist():
                df.update(vocabulary.intersection(split_words(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["word", "df"])

    return run


def inverse_frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[bytes, float]:
    """Inverse document frequency of every template word over all texts; only these words reach the driver."""
    vocabulary = frozenset(w for t in templates for w in t.words + t.phrase)
    rows = docs.select(F.col(text)).mapInArrow(frequencies(vocabulary), "word binary, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = {bytes(w): n for w, n in rows.collect()}
    n = df.pop(b"", 0)
    return {w: log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}


def _near(at: np.ndarray, places: np.ndarray, slack: int) -> np.ndarray:
    """For each place, whether one of the ascending positions is within the slack of it."""
    return np.searchsorted(at, places - slack) < np.searchsorted(at, places + slack, "right")


class Index:
    """Every template word's places in the templates, asked by falling inverse document frequency."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float], few: int = FEW, slack: int = SLACK, least_cover: float = LEAST_COVER, close: float = CLOSE):
        self.templates, self.few, self.slack, self.least_cover, self.close = templates, few, slack, least_cover, close
        #: place of each word in the order of falling inverse frequency
        self.rarity = {w: k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.passages = [len(t.words) > len(t.phrase) for t in templates]
        self.postings: dict[bytes, dict[int, np.ndarray]] = {}
        for k, t in enumerate(templates):
            for w in set(t.words):
                self.postings.setdefault(w, {})[k] = np.array([q for q, x in enumerate(t.words) if x == w])
        self.vocabulary = frozenset(self.postings)
        #: a key phrase's words with their places in it, rarest first
        self.phrases = [sorted(((w, q) for q, w in enumerate(t.phrase)), key=lambda x: (self.rarity[x[0]], x[1])) for t in templates]
        #: short names by the rarest of their words: without it in a file there is nothing to look up
        self.anchors: dict[bytes, list[int]] = {}
        for k, words in enumerate(self.phrases):
            if not self.passages[k]:
                self.anchors.setdefault(words[0][0], []).append(k)
        #: how many words of which passages a word covers at most
        self.weights = {w: [(k, len(at)) for k, at in by.items() if self.passages[k]] for w, by in self.postings.items()}

    def looked_up(self, held: frozenset[bytes]) -> dict[int, list[bytes]]:
        """The passages that a file with these licence words could cover, each with the rarest of its words that the file holds."""
        most: Counter[int] = Counter()
        for w in held:
            for k, n in self.weights[w]:
                most[k] += n
        rare: dict[int, list[bytes]] = {k: [] for k, n in most.items() if n >= self.least_cover * len(self.templates[k].words)}
        for w in sorted(held, key=self.rarity.__getitem__) if rare else ():
            for k in self.postings[w].keys() & rare.keys():
                if len(rare[k]) < self.few:
                    rare[k].append(w)
        return rare

    def notices(self, words: list[bytes]) -> tuple[dict[int, list[int]], dict[int, float]]:
        """Short names by number with the places where they start, and all templates found with the share of the best notice."""
        held = self.vocabulary.intersection(words)
        rare = self.looked_up(held)
        short = [k for w in held & self.anchors.keys() for k in self.anchors[w] if held.issuperset(self.templates[k].phrase)]
        if not rare and not short:
            return {}, {}
        needed = frozenset(w for k in (*rare, *short) for w in self.templates[k].words)
        lists: dict[bytes, list[int]] = {}
        for p, w in enumerate(words):
            if w in needed:
                lists.setdefault(w, []).append(p)
        posts = {w: np.array(at) for w, at in lists.items()}
        found = {k: at.tolist() for k in sorted(short) if len(at := self._phrase_places(k, posts))}
        shares = {k: c for k, words_k in rare.items() if (c := self._best_share(k, words_k, posts))}
        return found, dict.fromkeys(found, 1.0) | shares

    def _phrase_places(self, k: int, posts: dict[bytes, np.ndarray]) -> np.ndarray:
        """Where a template's key phrase starts in the file, ascending."""
        (first, at), *others = self.phrases[k]
        left = posts.get(first, np.zeros(0, int)) - at
        for w, q in others:
            if not len(left):
                break
            left = np.intersect1d(left, posts.get(w, np.zeros(0, int)) - q, assume_unique=True)
        return left

    def _best_share(self, k: int, rare: list[bytes], posts: dict[bytes, np.ndarray]) -> float:
        """The largest share of a passage's words near their places, over the starts where the rare words agree and the key phrase is verified; else 0."""
        t, slack = self.templates[k], self.slack
        starts = [np.unique(np.subtract.outer(posts[w], self.postings[w][k])) for w in rare]
        tried = np.unique(np.add.outer(np.unique(np.concatenate(starts)), np.arange(-slack, slack + 1)))
        tried = tried[2 * sum(_near(s, tried, slack).astype(int) for s in starts) >= len(rare)]
        none = np.zeros(0, int)
        near = [_near(posts.get(w, none), tried + q, slack) for q, w in enumerate(t.words)]
        share = sum(n.astype(int) for n in near) / len(t.words)
        of_key = range(t.lead, t.lead + len(t.phrase))
        numbers = [near[q] for q in of_key if t.words[q].isdigit()]
        loose = (share >= self.close) & (sum(near[q].astype(int) for q in of_key) >= len(t.phrase) - 1) & np.logical_and.reduce([np.ones(len(tried), bool), *numbers])
        verified = loose | _near(self._phrase_places(k, posts), tried + t.lead, slack)
        return float(share[verified & (share >= self.least_cover)].max(initial=0.0))


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanning(templates: tuple[Template, ...], idf: dict[bytes, float]):
    """Arrow function: (id, text) rows to the licence columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf)
        for b in batches:
            rows = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = split_words(text or b"")
                found, shares = index.notices(words)
                base = sorted(s for k, starts in found.items() if templates[k].base for s in starts)
                labels = lambda ks: ",".join(sorted({templates[k].label for k in ks}))
                rows.append((len(words), len(base), base[0] if base else None, base[-1] if base else None, labels(k for k in found if templates[k].base), labels(shares), max(shares.values(), default=0.0)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=[b.schema.names[0], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """id and the licence columns of every row."""
    idf = inverse_frequencies(docs, text, templates)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    return with_id(rows.mapInArrow(scanning(templates, idf), f"_id {dict(docs.dtypes)[id_col]}, {COLUMNS}"), id_col)
