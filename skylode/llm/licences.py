"""License scans with a positional index of templates by their rare words.

A template is the words of a notice, with the key phrases that must stand in a file in brackets. Words weigh by how
rare they are in the scanned documents: idf = ln(1 + documents / (1 + documents with the word)), counted over all
documents. The index maps a word to (template, offset), for the ``RARE`` rarest key words of every template. A file's own
words are looked up from the rarest on. A posting of a template's rarest word turns each of its places into a supposed
start (position minus offset); the places of the template's other rare words, less their offsets, are intersected with
these; a start stays if every key phrase stands whole at its place. So a file costs what its own words' postings hold,
whatever the number of templates. A notice may miss words outside its key phrases: its score is the idf share of the
template's words that are in place.

Words are runs of digits, lower-cased Latin letters and all non-ASCII characters; every other character parts words.

Cases: a null or empty text has no words, places or labels and score 0; rows stay as they are, repeated or not; a text
of any length is one row; of an empty table nothing comes back; a column in ``keep`` that has the name of an added one is
an error, other columns may have any name. Scale: one pass counts documents for the few hundred words of the templates
(a partial aggregate of at most that many rows a task), one pass scans; no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrase and label of the base, in the contract's order.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Well-known notices (key phrases in brackets) and their labels.
TEMPLATES = (
    ("[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    (
        "[permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files] the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions [the above copyright notice and this permission notice shall be included in all copies] or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "mit-full",
    ),
    ("licensed under the [apache license version 2 0]", "apache-2.0"),
    (
        "[licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license] you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0-notice",
    ),
    ("[gnu general public license] version 3", "gpl-family"),
    ("[general public license version 3]", "gpl-3.0"),
    ("[general public license version 2]", "gpl-2.0"),
    (
        "this program is free software you can redistribute it and or modify it [under the terms of the gnu general public license as published by the free software foundation] either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose see the gnu general public license for more details",
        "gpl-notice",
    ),
    ("[gnu lesser general public license]", "lgpl"),
    ("this library is free software you can redistribute it and or modify it [under the terms of the gnu lesser general public license as published by the free software foundation] either version 2 1 of the license or at your option any later version", "lgpl-notice"),
    ("[gnu affero general public license]", "agpl"),
    ("licensed under [cc by nc 4 0]", "cc-by-nc-4.0"),
    ("licensed under [cc by sa 4 0]", "cc-by-sa-4.0"),
    ("licensed under [cc by 4 0]", "cc-by-4.0"),
    ("this work is licensed under a [creative commons attribution 4 0 international license]", "cc-by-4.0-notice"),
    ("this work is licensed under a [creative commons attribution sharealike 4 0 international license]", "cc-by-sa-4.0-notice"),
    ("the person who associated a work with this deed has [dedicated the work to the public domain by waiving all of his or her rights] to the work worldwide under copyright law", "cc0"),
    ("[mozilla public license] version 2 0", "mpl"),
    ("this source code form is [subject to the terms of the mozilla public license v 2 0] if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl-2.0-notice"),
    ("[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met", "bsd"),
    (
        "[redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met] redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
        "bsd-full",
    ),
    ("[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and [unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("this software is provided as is without any express or implied warranty [in no event will the authors be held liable for any damages arising from the use of this software]", "zlib"),
    ("[boost software license version 1 0] august 17th 2003", "bsl-1.0"),
    ("[eclipse public license v 2 0]", "epl-2.0"),
)
RARE = 3
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")


class Templates:
    """The templates: their words, their key phrases (spans of words), their labels and whether they are of the base."""

    def __init__(self, base=BASE, more=TEMPLATES):
        self.items: list[tuple[list[bytes], list[tuple[int, int]], str, bool]] = []
        for phrase, label in base:
            words = phrase.encode().split()
            self.items.append((words, [(0, len(words))], label, True))
        for text, label in more:
            words, keys = [], []
            for i, part in enumerate(re.split(r"[\[\]]", text)):
                own = part.encode().split()
                if i % 2:
                    keys.append((len(words), len(words) + len(own)))
                words += own
            if not keys or any(a == b for a, b in keys):
                raise ValueError(f"a template needs key phrases that are not empty: {text!r}")
            self.items.append((words, keys, label, False))
        self.words = sorted({w for words, *_ in self.items for w in words})


class Index:
    """Postings of the templates' rare key words, once words have weights."""

    def __init__(self, templates: Templates, idf: dict[bytes, float]):
        self.items, self.idf = templates.items, idf
        self.rare: list[list[int]] = []  # of each template, the offsets of its rarest key words, rarest first
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # by a template's rarest word
        self.known: set[bytes] = set()
        self.total = [sum(idf[w] for w in words) or 1.0 for words, *_ in self.items]
        for t, (words, keys, _, _) in enumerate(self.items):
            spots, seen = sorted((j for a, b in keys for j in range(a, b)), key=lambda j: (-idf[words[j]], words[j], j)), set()
            spots = [j for j in spots if not (words[j] in seen or seen.add(words[j]))][:RARE]
            self.rare.append(spots)
            self.postings[words[spots[0]]].append((t, spots[0]))
            self.known.update(words[j] for j in spots)

    def candidates(self, words: list[bytes]) -> list[tuple[int, set[int]]]:
        """(template, supposed starts of its first word) that the rare words of a file leave."""
        own = self.known.intersection(words)
        if not own:
            return []
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in own:
                at[w].append(i)
        out = []
        for w in sorted(own & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for t, offset in self.postings[w]:
                starts = {p - offset for p in at[w]}
                for j in self.rare[t][1:]:
                    starts &= {p - j for p in at.get(self.items[t][0][j], ())}
                    if not starts:
                        break
                if starts:
                    out.append((t, starts))
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, float]], float]:
        """(template, start of its first key phrase, score) of every place, by template and start, and the best score."""
        found: list[tuple[int, int, float]] = []
        for t, starts in self.candidates(words):
            own, keys, _, _ = self.items[t]
            for s in starts:
                if all(s + a >= 0 and words[s + a : s + b] == own[a:b] for a, b in keys):
                    got = sum(self.idf[w] for j, w in enumerate(own) if 0 <= s + j < len(words) and words[s + j] == w)
                    found.append((t, s + keys[0][0], min(1.0, got / self.total[t])))
        return sorted(found), max((x[2] for x in found), default=0.0)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def rarity(documents: DataFrame, templates: Templates) -> dict[bytes, float]:
    """idf of the index's words over all documents; a bounded table, so it may go to the driver and to all tasks."""
    known = set(templates.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, dict.fromkeys(known, 0)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                for w in known.intersection(words_of(text.as_py())):
                    df[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *df]), pa.array([n, *df.values()], pa.int64())], names=["word", "df"])

    rows = documents.select("text").mapInArrow(count, "word binary, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {bytes(r["word"]): r["df"] for r in rows}
    n = df.pop(b"", 0)
    return {w: math.log(1 + n / (1 + df.get(w, 0))) + 1e-9 for w in known}


def scan(documents: DataFrame, keep: Iterable[str] = ("doc_id",), templates: Templates | None = None) -> DataFrame:
    """Adds to the columns in keep: n_words, n_base, first_word, last_word, base_labels, labels, score and places.

    places: array of (label, start word, score), every key phrase found. The columns of the base count places of the
    base phrases alone; score is the best of all places, 0 without one.
    """
    keep, templates = list(keep), templates or Templates()
    if set(keep) & set(ADDED):
        raise ValueError(f"columns that scan() adds: {sorted(set(keep) & set(ADDED))}")
    shared = documents.sparkSession.sparkContext.broadcast(Index(templates, rarity(documents, templates)))
    items = templates.items
    place = pa.struct([("label", pa.string()), ("word", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column(len(keep)):
                words = words_of(text.as_py())
                found, best = index.scan(words)
                base = [s for t, s, _ in found if items[t][3]]
                told = (
                    len(words), len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({items[t][2] for t, _, _ in found if items[t][3]})),
                    ",".join(sorted({items[t][2] for t, _, _ in found})), best,
                    [{"label": items[t][2], "word": s, "score": x} for t, s, x in found],
                )
                for c, v in zip(cols, told, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)]] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*keep, *ADDED])

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:bigint,score:double>>"])
    return documents.select(*[f"`{c}`" for c in keep], F.col("text").alias(unused(keep, "text_"))).mapInArrow(run, schema)
