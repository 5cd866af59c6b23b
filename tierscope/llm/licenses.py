"""License scan: an exact containment join of text blocks with license notices.

A template is the word set of a license notice, or of one paragraph of it. A block
is a stretch of words of a text, whatever its line breaks, of at most
``ceil(length / THRESHOLD)`` words for a template of ``length`` words. A block
matches when it holds at least ``THRESHOLD`` of the template's distinct words, all
words that the template ``needs`` and none that it ``lacks``.

Words are ordered by how many lines of the whole corpus hold them, rarest first. A
match needs ``c = ceil(THRESHOLD * size)`` common words, so it shares one of the
template's ``size - c + 1`` rarest words (prefix filter), has ``c`` words itself
(length filter), and what can still follow the matches so far must reach ``c``
(positional filter). What passes is compared exactly. Matching blocks of one
template that overlap are one notice, told by the best of them.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import arrow_schema, column, replaced, words

THRESHOLD = 0.8


class Template(NamedTuple):
    label: str
    text: str
    needs: tuple[str, ...] = ()  # words without which it is another license's notice
    lacks: tuple[str, ...] = ()  # words which make it another license's notice


# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def _gnu(label: str, program: str, name: str, needs: tuple, lacks: tuple) -> list[Template]:
    """The paragraphs of a GNU license's notice, which differ by its name."""
    return [Template(label, text, needs, lacks) for text in (
        f"This work is licensed under the {name}",
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the {name}",
        f"This {program} is free software; you can redistribute it and/or modify it under the terms of the {name} as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        f"This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.")]


def _creative_commons(code: str) -> list[Template]:
    """The notices of a Creative Commons license, by its code (as ``by-nc-sa``)."""
    names = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    own = code.split("-")
    other = [c for c in names if c not in own]
    name = "-".join(names[c] for c in own)
    long = dict(needs=tuple(names[c].lower() for c in own), lacks=tuple(names[c].lower() for c in other))
    return [
        Template(f"cc-{code}", f"Licensed under CC {code.upper()} 4.0", ("cc", *own), tuple(other)),
        Template(f"cc-{code}", f"This work is licensed under a Creative Commons {name} 4.0 International License", **long),
        Template(f"cc-{code}", f"This work is licensed under the Creative Commons {name} 4.0 International License. To view "
                 f"a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to "
                 "Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", **long)]


# License notices and their labels.
TEMPLATES = [
    *_gnu("gpl", "program", "GNU General Public License", ("general",), ("lesser", "library", "affero")),
    *_gnu("lgpl", "library", "GNU Lesser General Public License", ("lesser",), ("affero",)),
    *_gnu("lgpl", "library", "GNU Library General Public License", ("library", "general"), ("lesser", "affero")),
    *_gnu("agpl", "program", "GNU Affero General Public License", ("affero",), ("lesser",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
             "in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0", ("apache",)),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License "
             "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
             "See the License for the specific language governing permissions and limitations under the License."),
    Template("mit", "Released under the MIT License", ("mit",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             ("granted", "charge"), ("boost", "organization")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
             "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
             "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
             "following conditions: The above copyright notice and this permission notice shall be included in all copies "
             "or substantial portions of the Software."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met: 1. Redistributions of source code must retain the above "
             "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form "
             "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
             "documentation and/or other materials provided with the distribution."),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
             "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla",)),
    *[t for code in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for t in _creative_commons(code)],
    Template("cc0", "To the extent possible under law, the author has waived all copyright CC0", ("waived",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
             "rights to this work.", ("waived",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
             "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
             "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
             "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
             "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
             ("organization",)),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", ("boost",)),
    Template("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
             "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse",)),
]


def lines(raw: bytes) -> list[list[bytes]]:
    """The words of each line that has any."""
    return [w for line in raw.split(b"\n") if (w := words(line))]


def template_sets(templates=TEMPLATES) -> list[frozenset]:
    return [frozenset(words(t.text.encode())) for t in templates]


def least(size: int, threshold: float) -> int:
    """How many of ``size`` distinct words a match holds at least."""
    return max(1, math.ceil(threshold * size - 1e-9))


def width(template: Template, threshold: float = THRESHOLD) -> int:
    """How many words a block has at most."""
    return math.ceil(len(words(template.text.encode())) / threshold - 1e-9)


def block_frequency(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many lines of the whole corpus each template word stands. One row
    per template word reaches the driver, however large the corpus is."""
    vocabulary = frozenset().union(*template_sets(templates))

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for raw in column(batch, "raw"):
                if raw and not vocabulary.isdisjoint(words(raw)):
                    for own in lines(raw):
                        total.update(vocabulary.intersection(own))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
            names=["word", "n"])

    found = (docs.select(F.col("text").cast("binary").alias("raw"))
             .mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


class Index:
    """Templates in the global word order. Words are given by their numbers."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.templates = [t for t in templates if words(t.text.encode())]
        sets = template_sets(self.templates)
        named = [[w.encode() for w in (*t.needs, *t.lacks)] for t in self.templates]
        every = sorted(frozenset().union(*sets, *named))
        self.number = {w: i for i, w in enumerate(every)}
        self.need = np.array([least(len(own), threshold) for own in sets], np.int64)
        self.width = [width(t, threshold) for t in self.templates]
        self.order = [[self.number[w] for w in sorted(own, key=lambda w: (frequency.get(w, 0), w))] for own in sets]
        shape = len(sets), len(every)
        self.member, self.prefix, self.lacks = (np.zeros(shape, bool) for _ in range(3))
        self.needs = [{self.number[w.encode()] for w in t.needs} for t in self.templates]
        for t, order in enumerate(self.order):
            self.member[t, order] = True
            self.prefix[t, order[:len(order) - self.need[t] + 1]] = True
            self.lacks[t, [self.number[w.encode()] for w in self.templates[t].lacks]] = True
        self.counted = self.member.astype(np.float32)

    def _common(self, t: int, own: set) -> int:
        """Words of template ``t`` in ``own``, 0 as soon as they can't be enough."""
        common, order, need = 0, self.order[t], self.need[t]
        for i, w in enumerate(order):
            common += w in own
            if common + len(order) - i - 1 < need:
                return 0
        return common

    def find(self, at: np.ndarray, codes: np.ndarray) -> list[dict]:
        """Notices in a text. ``at``: places of words that have a number, and those numbers."""
        here = np.zeros(len(self.number), bool)
        here[codes] = True
        # the text as a whole passes the prefix and length filters
        likely = (self.counted @ here.astype(np.float32) >= self.need) & (self.prefix & here).any(1)
        return [x for t in np.flatnonzero(likely).tolist() if self.needs[t] <= set(np.flatnonzero(here).tolist())
                for x in self._notices(t, at, codes)]

    def _notices(self, t: int, at: np.ndarray, codes: np.ndarray) -> list[dict]:
        mine = self.member[t][codes]
        place, code = at[mine], codes[mine]
        begin = np.arange(len(place))
        # a block ends after its greatest length, or before a word that it lacks
        lacked = at[self.lacks[t][codes]]
        part = np.searchsorted(lacked, place)
        end = np.minimum(np.searchsorted(place, place + self.width[t]), np.searchsorted(part, part, "right"))
        rare = np.concatenate([[0], np.cumsum(self.prefix[t][code])])
        out: list[dict] = []
        reach = -1
        for i in np.flatnonzero((end - begin >= self.need[t]) & (rare[end] > rare[begin])).tolist():
            block = code[i:end[i]].tolist()
            own = set(block)
            common = self._common(t, own)
            if not common or not self.needs[t] <= own:
                continue
            seen: set = set()  # the block ends where its last new word stands
            for k, c in enumerate(block):
                seen.add(c)
                if len(seen) == common:
                    break
            first, last = int(place[i]), int(place[i + k])
            found = {"first": first, "n": last - first + 1, "label": self.templates[t].label,
                     "containment": common / len(self.order[t])}
            if first > reach:
                out.append(found)
            elif (found["containment"], -found["n"]) > (out[-1]["containment"], -out[-1]["n"]):
                out[-1] = found
            reach = max(reach, last)
        return out


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES,
         phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` plus ``n_words bigint``, ``places array<struct<first,label>>`` (where
    a phrase's words stand consecutively, words from 0), ``blocks
    array<struct<first,n,label,containment>>`` (the notices, for each template that
    finds one) and ``score double`` (the largest containment, 0 without a notice).

    One row per input row; a null text is empty; columns of ``docs`` with these
    names are replaced. Repeated words and rows change nothing for others except
    the word order, which never changes what is found. A word that a template needs
    has to be one of its own.
    """
    index = Index(templates, block_frequency(docs, templates), threshold)
    looked = [(words(p.encode()), label) for p, label in phrases.items()]
    df = replaced(docs, {
        "n_words": F.lit(0).cast("bigint"),
        "places": F.array().cast("array<struct<first:bigint,label:string>>"),
        "blocks": F.array().cast("array<struct<first:bigint,n:bigint,label:string,containment:double>>"),
        "score": F.lit(0.0)})
    schema, arrow, names = df.schema, arrow_schema(df.schema), df.columns
    number = dict(index.number)
    known = len(number)  # later numbers are of words in phrases alone
    for p, _ in looked:
        for w in p:
            number.setdefault(w, len(number))
    coded = [([number[w] for w in p], label) for p, label in looked]

    def one(raw: bytes):
        own = words(raw)
        codes = np.fromiter((number.get(w, -1) for w in own), np.int64, len(own))
        places = []
        if codes.max(initial=-1) < 0:
            return len(own), [], []
        for p, label in coded:
            start = np.flatnonzero(codes == p[0])
            start = start[start + len(p) <= len(own)]
            for k, c in enumerate(p[1:], 1):
                start = start[codes[start + k] == c]
            places += [{"first": int(i), "label": label} for i in start]
        at = np.flatnonzero((codes >= 0) & (codes < known))
        return len(own), sorted(places, key=lambda x: (x["first"], x["label"])), index.find(at, codes[at])

    def run(batches):
        for batch in batches:
            cols = dict(zip(names, batch.columns))
            n, places, found = [], [], []
            for text in column(batch, "text"):
                a, b, c = one((text or "").encode("utf-8", "surrogateescape"))
                n.append(a)
                places.append(b)
                found.append(c)
            cols |= {"n_words": n, "places": places, "blocks": found,
                     "score": [max((x["containment"] for x in f), default=0.0) for f in found]}
            yield pa.RecordBatch.from_arrays(
                [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type)
                 for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
