"""Licence scans by a positional index of rare tokens, within DataFrame functions.

A template is a licence's words.  Its anchors are its highest-idf words (by document frequency over
all files) with their positions; the index holds the rarest of them, as many as no match can lack: a
match needs a share of the anchors' idf weight, so it has one of those that weigh more than the rest
allowed to miss.  A file looks up the indexed words it contains; each names templates and, by relative
position, where in the file the template would start.  A start stands if the anchors that stand at
their relative positions reach the share and every mandatory key phrase stands where it must.

The index is a literal, bounded by the template list and not by the data; every file is judged
within its own row, so nothing but the frequency counts is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.native_words import words

#: Anchors of a template.
ANCHORS = 24
#: Rounding allowed for in sums of shares.
EPS = 1e-9


@dataclass(frozen=True)
class Template:
    """``keys``: phrases of ``text`` that must stand at their places; ``share``: idf weight needed."""

    label: str
    text: str
    keys: tuple[str, ...]
    share: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", self.text.lower())

    def key_places(self) -> list[tuple[int, list[str]]]:
        """(place of its first word, words) of each key."""
        own, out = self.words, []
        for k in self.keys:
            k = Template("", k, ()).words
            out.append((next(j for j in range(len(own)) if own[j : j + len(k)] == k), k))
        return out


def phrase(label: str, text: str, base: bool = False) -> Template:
    return Template(label, text, (text,), base=base)


BASE = [
    phrase("gpl", "gnu general public license", True),
    phrase("apache", "apache license", True),
    phrase("cc-by", "cc by", True),
    phrase("mit", "mit license", True),
]
ADDED = [
    phrase("apache-2.0", "apache license version 2 0"),
    phrase("gpl-3.0", "gnu general public license version 3"),
    phrase("gpl-2.0", "gnu general public license version 2"),
    phrase("lgpl", "gnu lesser general public license"),
    phrase("agpl", "gnu affero general public license"),
    phrase("cc-by-sa", "cc by sa"),
    phrase("cc-by-nc", "cc by nc"),
    phrase("cc-by-nd", "cc by nd"),
    phrase("cc0", "cc0 1 0 universal"),
    phrase("mpl", "mozilla public license"),
    phrase("bsd", "bsd license"),
    phrase("isc", "isc license"),
]
#: The wording of licences and of the notices that refer to them.
TEXTS = [
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("hereby granted free of charge",), 0.5,
    ),
    Template(
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee is hereby granted",), 0.5,
    ),
    Template(
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        ("source and binary forms",), 0.5,
    ),
    Template(
        "apache-notice",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("in compliance with the license",), 0.5,
    ),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("free software",), 0.5,
    ),
    Template(
        "mpl-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("source code form is subject to the terms",), 0.5,
    ),
    Template(
        "cc-notice",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, "
        "visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
        ("licensed under the creative commons",), 0.5,
    ),
    Template(
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("released into the public domain",), 0.5,
    ),
    Template(
        "zlib-text",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        ("to alter it and redistribute it freely",), 0.5,
    ),
    Template(
        "warranty",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        ("provided as is",), 0.5,
    ),
]
ALL = BASE + ADDED + TEXTS


def frequencies(files: DataFrame, templates: list[Template], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and how many of all files contain each template word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    have = files.select(F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocabulary))).alias("have"))
    rows = have.select(F.explode(F.concat(F.col("have"), F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # one row a template word
    found = {r["w"]: r["count"] for r in rows}
    return found.pop("", 0), found


def anchors(t: Template, n: int, seen: dict[str, int]) -> list[tuple[int, str, float]]:
    """(position, word, share of the weight) of a template's highest-idf words, rarest first; of words equally
    rare the earlier."""
    own = t.words
    idf = [math.log((n + 1) / (seen.get(w, 0) + 1)) + 1e-3 for w in own]
    best = sorted(range(len(own)), key=lambda j: (-idf[j], j))[:ANCHORS]
    weight = sum(idf[j] for j in best)
    return [(j, own[j], idf[j] / weight) for j in best]


def necessary(found: list[tuple[int, str, float]], share: float) -> list[tuple[int, str, float]]:
    """The rarest anchors, up to one that a match with that share can't lack all of."""
    total, out = 0.0, []
    for a in found:
        if total > 1 - share + EPS:
            break
        out.append(a)
        total += a[2]
    return out


def scan(files: DataFrame, templates: list[Template], n: int, seen: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, words, places (array of label, base, start, weight) of each file.

    Null or empty text has no places.  Other columns are not carried, whatever their names; repeated
    rows repeat.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    known: list[Column] = []
    for i, t in enumerate(templates):
        found = anchors(t, n, seen)
        for j, w, _ in necessary(found, t.share):
            postings.setdefault(w, []).append((i, j))
        table = F.array(*(F.struct(F.lit(j).alias("at"), F.lit(w).alias("w"), F.lit(share).alias("share")) for j, w, share in found))
        keys = [F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, k)).alias("words")) for at, k in t.key_places()]
        known.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.share).alias("need"), table.alias("anchors"), F.array(*keys).alias("keys")))
    table = F.array(*known)
    entries = [x for w, ps in postings.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(i).alias("t"), F.lit(j).alias("at")) for i, j in ps)))]
    index = F.create_map(*entries)

    tokenised = files.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    own = F.col("words")
    hits = F.filter(F.transform(own, lambda w, i: F.when(w.isin(list(postings)), i)), lambda i: i.isNotNull())
    starts = F.flatten(F.transform("_hits", lambda i: F.transform(index[F.get(own, i)], lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("start")))))

    def place(c: Column) -> Column:
        t = F.get(table, c["t"])
        weight = F.aggregate(t["anchors"], F.lit(0.0), lambda total, a: total + F.when(F.get(own, c["start"] + a["at"]) == a["w"], a["share"]).otherwise(0.0))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), c["start"].alias("start"), F.least(weight, F.lit(1.0)).alias("weight"))

    def stands(c: Column) -> Column:
        t = F.get(table, c["t"])
        return (c["start"] >= 0) & F.forall(t["keys"], lambda k: F.slice(own, c["start"] + k["at"] + 1, F.size(k["words"])) == k["words"]) & (place(c)["weight"] >= t["need"] - EPS)

    found = F.transform(F.filter(F.array_distinct("_starts"), stands), place)
    return tokenised.withColumn("_hits", hits).withColumn("_starts", starts).select(F.col("key").alias(key), "words", found.alias("places"))


def summary(scanned: DataFrame) -> DataFrame:
    """``scanned`` with counts and labels instead of words and places; score: the largest share of a
    template's idf weight that stands, 0 without a place."""
    base = F.filter("places", lambda p: p["base"])
    label = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    start = F.transform(base, lambda p: p["start"])
    return scanned.select(
        "*", F.size("words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
        label(base).alias("base_labels"), label(F.col("places")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["weight"])), F.lit(0.0)), 6).alias("score"),
    ).drop("words", "places")
