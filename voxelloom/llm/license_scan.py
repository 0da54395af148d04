"""License scans: Dice coefficient over word bigrams of passages and licence templates.

DataFrame functions only. A text's passages are its lines, sentences and paragraphs, with
the lines of a paragraph joined and comment marks gone. A passage is normalised (lower case, only letters and digits, single spaces) and turned into its set
of word bigrams. Dice = 2 |A and B| / (|A| + |B|) can reach a threshold t only if
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so a template is compared only with passages of such
sizes, and a passage only if it shares a bigram with some template. Everything happens inside a row:
nothing is shuffled but the few matches.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Letters of a word that few other texts hold.
LONG = 6
#: Words of a template's first sentence from which it stands for the template.
LEAST_OPENING = 8

# Fixed texts of licences and of notices that name one.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# Words that tell the members of a family apart, which a bigram or two can't: those that a passage must hold, and those that it must not.
TELLING = (
    ("AGPL-3.0", ("affero", "3"), ("lesser",)),
    ("GPL-2.0", ("2",), ("lesser", "library", "affero", "3")),
    ("GPL-3.0", ("3",), ("lesser", "library", "affero", "2")),
    ("LGPL-2.1", ("lesser", "2", "1"), ("affero", "3")),
    ("LGPL-3.0", ("lesser", "3"), ("affero", "2")),
)
#: The third clause, anywhere in the text, tells these two apart where a passage reads the same in both.
CLAUSE = r"neither\s+the\s+names?"
WITHOUT_CLAUSE, WITH_CLAUSE = "BSD-2-Clause", "BSD-3-Clause"

SENTENCE = r"([.!?]) "
PARAGRAPH = r"\n[ \t]*(?:\n[ \t]*)+"
# Comment marks at the beginning of a line.
MARKS = r"\n[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)(?=[ \t\n]|$)"
NOT_WORD = r"[^\p{L}\p{N}]+"


def normalised(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigram_set(text: str) -> list[str]:
    words = normalised(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The sizes of sets that can reach the threshold against a set of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def anchors(sets: list[list[str]], threshold: float) -> tuple[list[str], list[str]]:
    """Words and bigrams of which a text holds at least one if a passage of it reaches the threshold.

    Such a passage shares at least `least` bigrams with the template and so misses at most
    n - least: of any n - least + 1 bigrams it has one, and with it that bigram's words. Long words
    are added, those of most bigrams first, until every template has so many bigrams with one of
    them; a template of short words adds bigrams as they are.
    """
    need = {}
    for i, bigrams in enumerate(sets):
        n = len(bigrams)
        need[i] = n - math.ceil(threshold * (size_bounds(n, threshold)[0] + n) / 2 - 1e-9) + 1
    free = {(i, b) for i, s in enumerate(sets) for b in s}
    words: list[str] = []
    while True:
        gain: dict[str, int] = {}
        for i, b in free:
            if need[i] > 0:
                for w in {w for w in b.split(" ") if len(w) >= LONG}:
                    gain[w] = gain.get(w, 0) + 1
        if not gain:
            break
        best = max(sorted(gain), key=lambda w: (min(len(w), 7), gain[w]))
        words.append(best)
        met = {(i, b) for i, b in free if best in b.split(" ")}
        free -= met
        for i, _ in met:
            need[i] -= 1
    pairs = {b for i, v in need.items() if v > 0 for b in sorted(b for j, b in free if j == i)[:v]}
    return sorted(words), sorted(pairs)


def _flat(text):
    """Paragraphs' lines joined; paragraphs end with \\x01."""
    bare = F.regexp_replace(F.regexp_replace(text, "\r", ""), MARKS, "\n")
    return F.regexp_replace(F.regexp_replace(bare, PARAGRAPH, "\x01"), r"\s+", " ")


def passages_of(rows: DataFrame, text: str) -> DataFrame:
    """rows with a column of passages beside text: its lines, sentences and paragraphs.

    Line breaks inside a paragraph, and comment marks before its lines, are nothing but a space.
    """
    cut = rows.withColumn("__flat", _flat(text))
    parts = [F.split(text, "\n"), F.split("__flat", "\x01"), F.split(F.regexp_replace("__flat", SENTENCE, "$1\x01"), "\x01")]
    return cut.withColumn("passages", F.array_distinct(F.concat(*parts))).drop("__flat")


def with_openings(templates) -> list[tuple[str, str]]:
    """templates and the first sentence of each that has several: it tells the licence wherever it stands."""
    out = list(templates)
    for name, t in templates:
        first = re.split(r"(?<=[.!?]) |\n\n", t)[0]
        if first != t and len(normalised(first)) >= LEAST_OPENING and (name, first) not in out:
            out.append((name, first))
    return out


def _texts(values) -> Column:
    return F.split(F.lit("|".join(values)), r"\|")  # folded to a constant array


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licences in the whole text of every row of docs(doc_id, text, ...).

    Returns doc_id, license, dice (the best passage's) and n_passages (different passages that
    match), a row for each document and licence that match; a passage counts for the licence whose
    template it resembles most, for several if they tie. Null, empty and one-word texts match
    nothing; rows of one id count together, null ids too; repeated rows add nothing; ties of
    templates of one licence give one row; an empty table gives an empty result.
    """
    sets = [(name, bigram_set(t)) for name, t in with_openings(templates)]
    bounds = [size_bounds(len(b), threshold) for _, b in sets]
    least, most = min(lo for lo, _ in bounds), max(hi for _, hi in bounds)
    every = sorted({b for _, s in sets for b in s})
    words, pairs = anchors([b for _, b in sets], threshold)
    def held(text: Column) -> Column:
        found = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        return found | text.rlike("|".join(p.replace(" ", NOT_WORD) for p in pairs)) if pairs else found

    # Inside a lambda the lower-case text is made once; a filter on a column of it would be pushed
    # below the projection and make it anew for each word.
    low = F.lower(F.coalesce("text", F.lit("")))
    docs = docs.where(F.exists(F.array(low), held)).select("doc_id", low.alias("low"))
    docs = docs.withColumn("clause", F.col("low").rlike(CLAUSE))
    passages = passages_of(docs, "low").select("doc_id", "clause", F.explode(F.filter("passages", held)).alias("low"))
    words = F.split(F.trim(F.regexp_replace("low", NOT_WORD, " ")), " ")
    passages = passages.select("doc_id", "clause", words.alias("words")).where(F.size("words") > least)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    sized = passages.select("doc_id", "clause", "words", F.array_distinct(pairs).alias("bigrams")).where(F.size("bigrams").between(least, most))
    near = sized.where(F.arrays_overlap("bigrams", _texts(every)))
    telling = {name: (must, never) for name, must, never in TELLING}

    def told(name: str) -> Column:
        must, never = telling.get(name, ((), ()))
        out = F.col("clause") if name == WITH_CLAUSE else ~F.col("clause") if name == WITHOUT_CLAUSE else F.lit(True)
        if name in (WITH_CLAUSE, WITHOUT_CLAUSE):  # a passage that says it by its number needs no clause
            number = "3" if name == WITH_CLAUSE else "2"
            out = out | F.array_contains("words", number) | ~F.array_contains("words", "redistribution")
        for w in must:
            out = out & F.array_contains("words", w)
        for w in never:
            out = out & ~F.array_contains("words", w)
        return out

    scores = []
    for (name, bigrams), (lo, hi) in zip(sets, bounds, strict=True):
        shared = F.size(F.array_intersect("bigrams", _texts(bigrams)))
        dice = F.when(F.size("bigrams").between(lo, hi) & told(name), F.lit(2.0) * shared / (F.size("bigrams") + F.lit(len(bigrams))))
        scores.append(F.struct(F.lit(name).alias("license"), dice.alias("dice")))
    # A passage belongs to the templates that it resembles most.
    near = near.select("doc_id", F.array_join("bigrams", "|").alias("passage"), F.array(*scores).alias("scores"))
    best = F.array_max(F.transform("scores", lambda s: s["dice"]))
    found = near.withColumn("best", best).where(F.col("best") >= threshold).select("doc_id", "passage", "best", F.explode("scores").alias("s")).where(F.col("s.dice") == F.col("best"))
    return found.groupBy("doc_id", F.col("s.license").alias("license")).agg(F.max("s.dice").alias("dice"), F.countDistinct("passage").alias("n_passages"))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """Every passage against every template in DuckDB: no bounds, no anchors, and bigrams of its own."""
    rows = ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, t in with_openings(templates))
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    telling = ", ".join(f"('{name}', {listed(must)}, {listed(never)})" for name, must, never in TELLING)
    split = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = "list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])))"
    marks = r"\n[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)([ \t\n]|$)"
    return f"""
WITH t AS (SELECT license, {pairs} AS tb FROM (SELECT license, {split("body")} AS words FROM (VALUES {rows}) v(license, body))),
f AS (SELECT * FROM (VALUES {telling}) v(license, must, never)),
x AS (SELECT doc_id, coalesce(text, '') AS x, regexp_matches(lower(coalesce(text, '')), 'neither[ \\t\\n\\x0b\\f\\r]+the[ \\t\\n\\x0b\\f\\r]+names?') AS clause FROM documents),
y AS (SELECT doc_id, x, clause, regexp_replace(regexp_replace(regexp_replace(replace(x, chr(13), ''), '{marks}', chr(10) || '\\1', 'g'), '\\n[ \\t]*(\\n[ \\t]*)+', chr(1), 'g'), '[\\s\\x0b]+', ' ', 'g') AS flat FROM x),
p AS (SELECT doc_id, clause, unnest(list_distinct(flatten([string_split(x, chr(10)), string_split(flat, chr(1)), string_split(regexp_replace(flat, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))]))) AS passage FROM y),
w AS (SELECT doc_id, clause, {split("passage")} AS words FROM p),
b AS (SELECT doc_id, clause, words, {pairs} AS bigrams FROM w WHERE len(words) >= 2),
s AS (SELECT doc_id, license, bigrams, 2.0::DOUBLE * len(list_intersect(bigrams, tb)) / (len(bigrams) + len(tb))::DOUBLE AS dice
      FROM b, t LEFT JOIN f USING (license) WHERE list_has_any(bigrams, tb)
        AND (must IS NULL OR list_has_all(words, must) AND NOT list_has_any(words, never))
        AND CASE license WHEN '{WITH_CLAUSE}' THEN clause OR list_contains(words, '3') OR NOT list_contains(words, 'redistribution')
          WHEN '{WITHOUT_CLAUSE}' THEN NOT clause OR list_contains(words, '2') OR NOT list_contains(words, 'redistribution') ELSE true END
      QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, bigrams))
SELECT doc_id, license, max(dice) AS dice, count(DISTINCT bigrams)::BIGINT AS n_passages FROM s WHERE dice >= {threshold} GROUP BY doc_id, license
"""
