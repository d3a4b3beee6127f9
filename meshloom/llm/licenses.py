"""License scans with DataFrame functions only: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

A template is found in a text if the text has at least `CONTAINED` of the template's distinct runs of five words. Words that
every possible match needs (anchors, worked out from the templates) leave most texts without any further work.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.components import looked_up

from .common import tidied, written

RUN = 5
CONTAINED = 0.8
#: Windows of 16 words (12 runs), a new one each 4 words, and of 5 words (1 run), a new one each word.
WINDOW, STEP, HASHES = 16, 4, 12
#: Templates of fewer words than this are retrieved by their 5-word windows: a shared run always collides. Of a longer one's
#: 16-word windows at least one is hit to 0.8 and lies within 2 words of a window of the text: a Jaccard of 0.5 or more,
#: so none of 12 one-row bands collides with a probability of 0.5 ** 12 at most, and there are several such windows.
SHORT = 24
#: Up to so many words the templates are a constant of the plan; beyond, they are a table.
MOST_TEMPLATE_WORDS = 100_000

# Public license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved",
    "mit-line": "Released under the MIT License",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-clause-name": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "as-is-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
}

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_MATCHES = "array<struct<license string, containment double, first_word int>>"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _runs(words: Column, n: int) -> Column:
    """Hash of each run of n words."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


def _bands(runs: Column, step: int) -> Column:
    """One-row MinHash bands of the windows of WINDOW words that begin each `step` words."""
    wide = WINDOW - RUN + 1
    at = F.when(F.size(runs) > 0, F.sequence(F.lit(1), F.greatest(F.size(runs) - wide + step, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = F.array(*[F.lit(k) for k in range(HASHES)])
    return F.flatten(F.transform(at, lambda i: F.transform(rows, lambda k: F.xxhash64(k, F.array_min(F.transform(F.slice(runs, i, wide), lambda s: F.xxhash64(s, k)))))))


def _first(some: Column, of: Column) -> Column:
    return F.array_min(F.transform(some, lambda s: F.array_position(of, s))).cast("int") - 1


def _plain_words(text: str) -> list[str]:
    """As lowered() and _words() do: only A-Z has a lower case, and all beyond ASCII is a part of a word."""
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def _text_runs(text: str) -> list[tuple[str, ...]]:
    w = _plain_words(text)
    return sorted({tuple(w[i : i + RUN]) for i in range(max(1, len(w) - RUN + 1))}) if w else []


def anchors(templates: dict[str, str], contained: float = CONTAINED) -> list[str]:
    """Words of which a text that holds any template has at least one.

    A match has `contained` of a template's runs; so if the runs without an anchor are fewer than that, one with an anchor is
    among them. Chosen greedily: words that serve most, and of six letters if there are any, since short ones are in all texts.
    """
    runs = {name: _text_runs(text) for name, text in templates.items()}
    chosen: list[str] = []

    def open_() -> list[str]:
        return [n for n, rs in runs.items() if rs and sum(not set(r) & set(chosen) for r in rs) >= contained * len(rs) - 1e-9]

    while left := open_():
        gain = Counter(w for n in left for r in runs[n] if not set(r) & set(chosen) for w in set(r))
        chosen.append(min(gain, key=lambda w: (len(w) < 6, -gain[w], w)))
    return chosen


def _prepared(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """Name, retrieval hashes k, distinct run hashes d and number of words n of each template, by the expressions that texts go through."""
    rows = spark.createDataFrame([(n, t) for n, t in sorted(templates.items()) if _plain_words(t)], "name string, text string")
    words = rows.withColumn("w", _words(lowered(F.col("text")))).withColumn("n", F.size("w"))
    length = F.least(F.col("n"), F.lit(RUN))
    at = F.sequence(F.lit(1), F.col("n") - length + 1)
    runs = words.withColumn("r", F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, length), " "))))
    keys = F.when(F.col("n") < SHORT, F.col("r")).otherwise(_bands(F.col("r"), STEP))
    return runs.select("name", keys.alias("k"), F.array_distinct("r").alias("d"), "n")


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id and matches, an array of (license, containment, first_word) by license name, for every row.

    containment: the share of the template's distinct runs that the whole text has, `contained` or more; a template of fewer
    than five words is one run. first_word: the number, from 0, of the first word of the first run that they share.
    Null or empty text has no match; so has all text if there are no templates. Repeated rows and null ids each give
    their row; very long texts are read whole; empty input gives no rows; other columns aren't read. One narrow projection: nothing is
    shuffled or gathered. More than MOST_TEMPLATE_WORDS of templates are joined as a table instead, by the same hashes.
    """
    templates = TEMPLATES if templates is None else templates
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    if sum(len(_plain_words(t)) for t in templates.values()) > MOST_TEMPLATE_WORDS:
        return _scan_table(rows, written(_prepared(documents.sparkSession, templates)), contained)
    known = [(x["name"], x["k"], x["d"], x["n"]) for x in _prepared(documents.sparkSession, templates).collect()]
    if not known:
        return rows.select("doc_id", F.array().cast(_MATCHES).alias("matches"))
    anchor = F.lit(False)
    for a in anchors(templates, contained):
        anchor = anchor | F.contains(F.col("_l"), F.lit(a))
    few = sorted({min(n, RUN) for *_, n in known} - {RUN})
    rows = rows.withColumn("_l", lowered(F.col("_t"))).withColumn("_w", F.when(anchor, _words(F.col("_l"))))
    rows = rows.withColumn("_r", _runs(F.col("_w"), RUN))
    rows = rows.withColumn("_s", F.concat(*[_runs(F.col("_w"), n) for n in few])) if few else rows.withColumn("_s", F.array().cast("array<bigint>"))
    rows = rows.withColumn("_k", F.concat("_r", "_s", _bands(F.col("_r"), 2)))
    found = []
    for name, keys, runs, n in known:
        of = F.col("_r") if n >= RUN else F.col("_s")
        common = F.array_intersect(F.array(*map(F.lit, runs)), of)
        first = _first(common, of)
        if 0 < n < RUN and len(few) > 1:
            first = F.lit(None).cast("int")  # runs of several short lengths lie behind each other
        retrieved = F.arrays_overlap(F.col("_k"), F.array(*map(F.lit, keys)))
        share = F.size(common) / F.lit(float(len(runs)))
        found.append(F.when(retrieved, F.when(share >= contained - 1e-9, F.struct(F.lit(name).alias("license"), share.alias("containment"), first.alias("first_word")))))
    matches = F.when(F.col("_w").isNotNull(), F.filter(F.array(*found), lambda x: x.isNotNull()))
    return rows.select("doc_id", F.coalesce(matches, F.array().cast(_MATCHES)).alias("matches"))


@tidied
def _scan_table(rows: DataFrame, known: DataFrame, contained: float) -> DataFrame:
    """scan_licenses with the templates as a table: a text's hashes are looked up, and what they retrieve is verified by its runs."""
    few = sorted(r["n"] for r in known.select("n").where(F.col("n") < RUN).distinct().collect())  # 4 at most
    words = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", _words(lowered(F.col("_t"))).alias("_w"))
    runs = words.withColumn("_r", _runs(F.col("_w"), RUN)).withColumn("_s", F.concat(F.array().cast("array<bigint>"), *[_runs(F.col("_w"), n) for n in few]))
    texts = written(runs.drop("_w"))
    keys = written(texts.select("_row", F.explode(F.array_distinct(F.concat("_r", "_s", _bands(F.col("_r"), 2)))).alias("key")))
    of = known.select("name", F.explode("k").alias("key")).groupBy("key").agg(F.collect_set("name").alias("names"))
    pairs = written(looked_up(keys, "key", of).where("names is not null").select("_row", F.explode("names").alias("name")).distinct())
    both = looked_up(pairs, "name", known.select("name", F.struct("d", "n").alias("t"))).join(texts.drop("doc_id"), "_row")
    of_text = F.when(F.col("t.n") >= RUN, F.col("_r")).otherwise(F.col("_s"))
    common = F.array_intersect("t.d", of_text)
    first = F.when((F.col("t.n") >= RUN) | F.lit(len(few) < 2), _first(common, of_text))
    share = F.size(common) / F.size("t.d").cast("double")
    found = both.select("_row", F.struct(F.col("name").alias("license"), share.alias("containment"), first.alias("first_word")).alias("m")).where(F.col("m.containment") >= contained - 1e-9)
    matches = found.groupBy("_row").agg(F.sort_array(F.collect_list("m")).alias("matches"))
    return texts.select("_row", "doc_id").join(matches, "_row", "left").select("doc_id", F.coalesce("matches", F.array().cast(_MATCHES)).alias("matches"))
