"""Licence notices by a positional index of rare words; DataFrame functions only.

Templates are short statements and whole notices.  A word's rarity is its inverse document frequency over the templates;
each template is indexed by its rarest words with their offsets (postings).  In each document the places of indexed words
are looked up, and each posting turns a place into a start (place less offset).  Where enough different rare words of a
template name starts within its tolerance, the template is a candidate there; its mandatory key phrases must then stand
in the words of the candidate.  A statement has no tolerance and is its own key phrase.  A notice may be reworded: some
words may be missing or added, as long as most rare words keep their relative positions and the key phrases stand whole.

All of it happens within the row: nothing is shuffled.  Starts are sorted, so each is compared with the few that can lie
within the tolerance after it, and work grows with the number of places.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrase and label of the base list.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further statements and their labels.
PHRASES = BASE_PHRASES | {
    "mit license": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "bsd 3 clause": "bsd",
    "bsd 2 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1",
    "eclipse public license": "epl",
    "the unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
}
#: Whole notices with their labels and their mandatory key phrases.
NOTICES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted", "sublicense and or sell copies"),
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license", "except in compliance with the license"),
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        ("gnu lesser general public license", "free software foundation"),
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        ("gnu affero general public license", "free software foundation"),
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license", "source code form"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee", "is hereby granted"),
    ),
    (
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        ("permission is hereby granted", "prepare derivative works of the software"),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software", "public domain"),
    ),
)
#: How many rare words index a statement and a notice, how many of a notice's must agree, and within how many words.
STATEMENT_RARE, NOTICE_RARE, NOTICE_NEED, TOLERANCE = 2, 10, 6, 8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Template(NamedTuple):
    name: str
    label: str
    words: tuple[str, ...]
    keys: tuple[str, ...]
    n_rare: int
    need: int
    tolerance: int


def split(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c in _UPPER else c for c in text)))


def templates(phrases: dict[str, str] = PHRASES, notices=NOTICES) -> list[Template]:
    """Statements first, in their order, then notices."""
    made = [Template(p, label, tuple(p.split()), (p,), STATEMENT_RARE, STATEMENT_RARE, 0) for p, label in phrases.items()]
    return made + [Template(f"{label} notice", label, split(text), keys, NOTICE_RARE, NOTICE_NEED, TOLERANCE) for label, text, keys in notices]


def idf(of: list[Template]) -> dict[str, float]:
    """Inverse document frequency of each word over the templates."""
    df = Counter(w for t in of for w in set(t.words))
    return {w: math.log((1 + len(of)) / n) for w, n in df.items()}


class Posting(NamedTuple):
    word: str
    template: int
    rare: int
    offset: int
    weight: float


def postings(of: list[Template]) -> list[Posting]:
    """The rarest words of each template, each at its first place; the template's number is its place in the list."""
    weight, out = idf(of), []
    for number, t in enumerate(of):
        first = {w: i for i, w in reversed(list(enumerate(t.words)))}
        for rare, word in enumerate(sorted(first, key=lambda w: (-weight[w], first[w]))[: t.n_rare]):
            out.append(Posting(word, number, rare, first[word], weight[word]))
    return out


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and other than ASCII characters, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def _votes(words: Column, of: list[Template]) -> Column:
    """Sorted array<struct<template, start, rare>>: one element for each place of an indexed word and each of its postings."""
    by_word: dict[str, list[Posting]] = {}
    for p in postings(of):
        by_word.setdefault(p.word, []).append(p)
    entry = lambda p: F.struct(F.lit(p.template).alias("template"), F.lit(p.offset).alias("offset"), F.lit(p.rare).alias("rare"), F.lit(-of[p.template].tolerance).alias("least"))
    listed = F.create_map(*[x for word, found in sorted(by_word.items()) for x in (F.lit(word), F.array(*map(entry, found)))])
    at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(*by_word))
    turned = lambda x: F.transform(F.filter(F.element_at(listed, x["word"]), lambda p: x["at"] - p["offset"] >= p["least"]), lambda p: F.struct(p["template"].alias("template"), (x["at"] - p["offset"]).alias("start"), p["rare"].alias("rare")))
    return F.array_sort(F.flatten(F.transform(at, turned)))


def _candidates(votes: Column, of: list[Template]) -> Column:
    """array<struct<template, start, mass>> of the starts from which on enough different rare words agree, with the rarity of those that do."""
    need, tolerance = F.array(*(F.lit(t.need) for t in of)), F.array(*(F.lit(t.tolerance) for t in of))
    # So many votes of a template lie within its tolerance at most: one for each rare word and start.
    most = F.array(*(F.lit(t.n_rare * (t.tolerance + 1)) for t in of))
    widest = max(t.n_rare for t in of)
    weight = {(p.template, p.rare): p.weight for p in postings(of)}
    weights = F.array(*(F.lit(weight.get((t, r), 0.0)) for t in range(len(of)) for r in range(widest)))
    same = lambda x, v: (x["template"] == v["template"]) & (x["start"] <= v["start"] + F.get(tolerance, v["template"]))
    # In sorted order the votes that may agree stand side by side: that many places on there must be one that does.
    placed = F.filter(F.transform(votes, lambda v, i: F.struct(v["template"].alias("template"), v["start"].alias("start"), v["rare"].alias("rare"), i.alias("i"))), lambda v: F.coalesce(same(F.get(votes, v["i"] + F.get(need, v["template"]) - 1), v), F.lit(False)))
    agreed = F.transform(placed, lambda v: F.struct(v["template"].alias("template"), v["start"].alias("start"), F.array_distinct(F.transform(F.filter(F.slice(votes, v["i"] + 1, F.get(most, v["template"])), lambda x: same(x, v)), lambda x: x["rare"])).alias("rares")))
    agreed = F.filter(agreed, lambda v: F.size(v["rares"]) >= F.get(need, v["template"]))
    mass = lambda v: F.aggregate(v["rares"], F.lit(0.0), lambda sum_, r: sum_ + F.get(weights, v["template"] * widest + r))
    return F.transform(agreed, lambda v: F.struct(v["template"].alias("template"), v["start"].alias("start"), mass(v).alias("mass")))


def _verified(words: Column, candidates: Column, of: list[Template]) -> Column:
    """The candidates in whose words all key phrases of the template stand."""
    size = F.array(*(F.lit(len(t.words) + t.tolerance) for t in of))
    keys = F.array(*(F.array(*(F.lit(f" {k} ") for k in t.keys)) for t in of))
    span = lambda c: F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(c["start"], F.lit(0)) + 1, F.get(size, c["template"])), " "), F.lit(" "))
    return F.filter(candidates, lambda c: F.forall(F.get(keys, c["template"]), lambda k: F.contains(span(c), k)))


def _first_of_near(held: Column, of: list[Template]) -> Column:
    """Of starts of a template within its tolerance the first.  ``held`` is a column, as each element looks at the one before it."""
    tolerance = F.array(*(F.lit(t.tolerance) for t in of))
    before = lambda i: F.get(held, i - 1)
    return F.filter(held, lambda c, i: (i == 0) | (before(i)["template"] != c["template"]) | (before(i)["start"] + F.get(tolerance, c["template"]) < c["start"]))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, places, score), one row for each row of ``docs``.

    places: array of (label, template, start, mass), starts in words from 0 (a notice that has lost its first words may
    begin below 0); all places count, none is capped.  mass: the rarity of the rare words that agreed there.  score: 1 less
    e to the power of the greatest mass with a minus, so it grows with what was found; 0 without a place.  Null and empty
    texts have no words.  Repeated rows count each for itself; an empty table gives no rows.
    """
    of = templates() if of is None else of
    rare = sorted({p.word for p in postings(of)})
    cut = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    voted = cut.select("*", F.when(F.arrays_overlap("words", F.array(*map(F.lit, rare))), _votes(F.col("words"), of)).alias("votes"))
    found = voted.select("doc_id", "words", _candidates(F.col("votes"), of).alias("candidates"))
    held = found.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.when(F.size("candidates") > 0, _verified(F.col("words"), F.col("candidates"), of)).alias("held"))
    hits = held.select("doc_id", "n_words", _first_of_near(F.col("held"), of).alias("hits"))
    names, labels = F.array(*(F.lit(t.name) for t in of)), F.array(*(F.lit(t.label) for t in of))
    none = F.array().cast("array<struct<label: string, template: string, start: bigint, mass: double>>")
    places = F.transform("hits", lambda h: F.struct(F.get(labels, h["template"]).alias("label"), F.get(names, h["template"]).alias("template"), h["start"].cast("bigint").alias("start"), h["mass"].alias("mass")))
    return hits.select("doc_id", "n_words", F.coalesce(places, none).alias("places")).select(
        "doc_id", "n_words", "places", F.coalesce(F.round(1 - F.exp(-F.array_max(F.transform("places", lambda p: p["mass"]))), 6), F.lit(0.0)).alias("score")
    )


def digest(found: DataFrame, base: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """The columns of the contract from the result of ``licenses``."""
    mine = F.filter("places", lambda p: p["template"].isin(*base))
    starts = F.transform(mine, lambda p: p["start"])
    said = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(mine).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        said(mine).alias("base_labels"), said(F.col("places")).alias("labels"), "score",
    )
