"""License scans: text compared to license templates by the Dice coefficient of word bigrams.

Words are lower case runs of ASCII letters and digits. Compared are the sentences and
paragraphs of a document, the whole of it, and windows: wherever a bigram that holds an
anchor word of a template occurs, the run of as many words as the template has that puts
the bigram in its place, and a run of some more words, for notices with words added. So a
notice is found in the middle of prose, wrapped anywhere.

A span matches a template when twice their common bigrams over the sum of their sizes
reaches the threshold, and the span holds every number of the template, so that a notice
of another version is no match. Sizes alone rule out most templates: a span can only
reach the threshold with those of a size near its own. Documents are looked at only if
they hold an anchor word; anchors are chosen so that every matching span must hold one.

Matches that overlap are one notice. They are taken in the order of their common bigrams,
most first, then of coefficient, name and place; one that overlaps one taken before is
left out. That takes the product of a document's matches and notices, at most.

All is done by built-in functions, one document at a time, without a shuffle. A null text
has no spans; a notice that occurs several times counts each time. Repeated rows are
scanned each; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SPACES, whole_text

THRESHOLD = 0.8

# Public notices by which texts name their license, with SPDX names.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
        "License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


# Words of ordinary prose, which tell a notice least; they become anchors last.
COMMON_WORDS = frozenset(
    "a an and any as at be by can do for free from if in is it not of on one or same that the these this to under up "
    "use was were with you".split()
)


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def least_size(bigrams: int, threshold: float) -> int:
    """The fewest bigrams a span can have and still match a template of so many."""
    return math.ceil(threshold / (2 - threshold) * bigrams - 1e-9)


def most_size(bigrams: int, threshold: float) -> int:
    return math.floor((2 - threshold) / threshold * bigrams + 1e-9)


def anchors(text: str, threshold: float) -> set[str]:
    """Words of which every matching span holds one: uncommon ones first, then the longest.

    A match has at least ``least_size`` of the template's bigrams. If fewer than that
    are free of anchors, it has one with an anchor.
    """
    free = template_bigrams(text)
    may_be_free = least_size(len(free), threshold) - 1
    chosen: set[str] = set()
    for word in sorted(set(template_words(text)), key=lambda w: (w in COMMON_WORDS, -len(w), w)):
        if len(free) <= may_be_free:
            break
        remaining = [b for b in free if word not in b.split(" ")]
        if len(remaining) < len(free):
            chosen.add(word)
            free = remaining
    return chosen


def template_numbers(text: str) -> list[str]:
    return sorted({w for w in template_words(text) if w.isdigit()})


def anchor_places(text: str, threshold: float) -> list[tuple[str, int]]:
    """Bigrams of a template that hold an anchor, with each place where they stand."""
    words, chosen = template_words(text), anchors(text, threshold)
    return [(f"{a} {b}", i) for i, (a, b) in enumerate(zip(words, words[1:])) if a in chosen or b in chosen]


def window_lengths(words: int) -> tuple[int, int]:
    """Words of the windows for a template: its own number, and room for one word more in eight."""
    return words, words + words // 8 + 1


def every_template(templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(name, text) for name, texts in sorted(templates.items()) for text in texts]


# Marks between words: the end of a sentence or line, and of a paragraph.
_LINE, _PARAGRAPH = "\x01", "\x02"
_RANGE = "struct<start:int,end:int,template:int>"
_HIT = "struct<less:int,lower:double,license:string,start:int,end:int>"


def _marked(text: Column) -> Column:
    """Words of a text and the marks between them."""
    text = F.translate(text, _LINE + _PARAGRAPH, "  ")
    text = F.regexp_replace(text, "\n(?:[\\x20\\x09\\x0B-\\x0D]*\n)+", f" {_PARAGRAPH} ")
    text = F.regexp_replace(F.regexp_replace(text, f"([.!?])[{SPACES}]+", f"$1 {_LINE} "), "\n", f" {_LINE} ")
    return F.array_remove(F.split(F.lower(text), f"[^a-z0-9{_LINE}{_PARAGRAPH}]+"), "")


def _ranges(cuts: Column, words: Column) -> Column:
    """What lies between neighbouring cuts, for any template."""
    starts = F.concat(F.array(F.lit(0)), cuts)
    ends = F.concat(cuts, F.array(F.size(words)))
    return F.zip_with(
        starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.lit(-1).alias("template"))
    )


def _bigrams(words: Column) -> Column:
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b))


def _notices(hits: Column) -> Column:
    """The best hit of those that overlap, then the next best of the rest, and so on."""

    def step(kept: Column, hit: Column) -> Column:
        overlaps = F.exists(kept, lambda k: (k["start"] < hit["end"]) & (hit["start"] < k["end"]))
        return F.when(overlaps, kept).otherwise(F.concat(kept, F.array(hit)))

    return F.aggregate(F.array_sort(hits), F.array().cast(f"array<{_HIT}>"), step)


def license_spans(
    docs: DataFrame,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Each notice: identifier, ``span`` (normalised), its first word's number from 0, ``license`` and ``dice``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    every = every_template(templates)
    anchor_words = sorted(set().union(*[anchors(t, threshold) for _, t in every]))
    places: dict[str, list[dict]] = {}
    described = []
    for at, (name, text) in enumerate(every):
        bigrams, length = template_bigrams(text), len(template_words(text))
        low, high = least_size(len(bigrams), threshold), most_size(len(bigrams), threshold)
        described.append(
            {"at": at, "name": name, "bigrams": bigrams, "low": low, "high": high, "numbers": template_numbers(text)}
        )
        for bigram, place in anchor_places(text, threshold):
            for wide in window_lengths(length):
                places.setdefault(bigram, []).append({"at": at, "place": place, "length": wide})
    # Both are constants of the plan: the templates' words, not the documents'.
    by_bigram = F.from_json(F.lit(json.dumps(places)), "map<string,array<struct<at:int,place:int,length:int>>>")
    patterns = F.from_json(
        F.lit(json.dumps(described)),
        "array<struct<at:int,name:string,bigrams:array<string>,low:int,high:int,numbers:array<string>>>",
    )
    words, size = F.col("words"), F.size("words")

    def cuts(marks: Column) -> Column:
        # The k-th mark has k marks before it, which are no words.
        return F.transform(marks, lambda m, k: F.struct(m["mark"], (m["place"] - k).alias("place")))

    def windows(bigram: Column) -> Column:
        return F.transform(
            by_bigram[bigram["bigram"]],
            lambda e: F.struct(
                F.greatest(bigram["place"] - e["place"], F.lit(0)).alias("start"),
                F.least(bigram["place"] - e["place"] + e["length"], size).alias("end"),
                e["at"].alias("template"),
            ),
        )

    def compared(span: Column) -> Column:
        candidates = F.filter(
            patterns,
            lambda t: ((span["template"] == -1) | (span["template"] == t["at"]))
            & F.size(span["bigrams"]).between(t["low"], t["high"])
            & (F.size(F.array_except(t["numbers"], span["words"])) == 0),
        )

        def hit(t: Column) -> Column:
            common = F.size(F.array_intersect(span["bigrams"], t["bigrams"]))
            return F.struct(common.alias("common"), (F.size(span["bigrams"]) + F.size(t["bigrams"])).alias("sizes"), t["name"])

        return F.transform(
            F.filter(F.transform(candidates, hit), lambda h: h["common"] * 2.0 / h["sizes"] >= threshold),
            lambda h: F.struct(
                (-h["common"]).alias("less"),
                (h["common"] * -2.0 / h["sizes"]).alias("lower"),
                h["name"].alias("license"),
                span["start"],
                span["end"],
            ),
        )

    return (
        docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
        .where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*map(F.lit, anchor_words))))
        .select("id", _marked(F.col("text")).alias("marked"))
        .select(
            "id",
            F.filter("marked", lambda w: ~w.isin(_LINE, _PARAGRAPH)).alias("words"),
            cuts(
                F.filter(
                    F.transform("marked", lambda w, i: F.struct(w.alias("mark"), i.alias("place"))),
                    lambda m: m["mark"].isin(_LINE, _PARAGRAPH),
                )
            ).alias("marks"),
        )
        .select(
            "id",
            "words",
            F.filter(
                F.transform(_bigrams(words), lambda b, i: F.struct(b.alias("bigram"), i.alias("place"))),
                lambda b: b["bigram"].isin(sorted(places)),
            ).alias("found"),
            F.array_distinct(
                F.concat(
                    _ranges(F.transform("marks", lambda m: m["place"]), words),
                    _ranges(
                        F.transform(F.filter("marks", lambda m: m["mark"] == _PARAGRAPH), lambda m: m["place"]), words
                    ),
                    _ranges(F.array().cast("array<int>"), words),
                )
            ).alias("ranges"),
        )
        .select(
            "id",
            "words",
            F.filter(
                F.concat("ranges", F.array_distinct(F.flatten(F.transform("found", windows)))),
                lambda r: r["end"] - r["start"] > 1,
            ).alias("ranges"),
        )
        .select(
            "id",
            "words",
            F.transform(
                "ranges",
                lambda r: F.struct(
                    r["start"], r["end"], r["template"], F.slice(words, r["start"] + 1, r["end"] - r["start"]).alias("words")
                ),
            ).alias("spans"),
        )
        .select(
            "id",
            "words",
            F.transform(
                F.filter("spans", lambda s: F.arrays_overlap(s["words"], F.array(*map(F.lit, anchor_words)))),
                lambda s: F.struct(
                    s["start"],
                    s["end"],
                    s["template"],
                    s["words"],
                    F.array_distinct(F.filter(_bigrams(s["words"]), lambda b: b.isNotNull())).alias("bigrams"),
                ),
            ).alias("spans"),
        )
        .select("id", "words", _notices(F.flatten(F.transform("spans", compared))).alias("notices"))
        .select(
            "id",
            F.explode(
                F.transform(
                    "notices",
                    lambda h: F.struct(
                        h["start"],
                        F.array_join(F.slice(words, h["start"] + 1, h["end"] - h["start"]), " ").alias("span"),
                        h["license"],
                        (-h["lower"]).alias("dice"),
                    ),
                )
            ).alias("notice"),
        )
        .select(F.col("id").alias(id_column), "notice.span", "notice.start", "notice.license", "notice.dice")
    )


def licenses(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Licenses of each identifier that has any: spans that name it and the best likeness."""
    return spans.groupBy(id_column, "license").agg(
        F.count(F.lit(1)).alias("n_spans"), F.round(F.max("dice"), 6).alias("best_dice")
    )
