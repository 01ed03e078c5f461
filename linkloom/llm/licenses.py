"""License scans by diagonal voting, by columns alone.

Every rolling ``GRAM``-word window of every document is joined to the positions it has in the license templates. A match
votes for the diagonal ``document position - template position``; votes are added up per diagonal, neighbouring diagonals (words put
in or left out) are merged, and a merged span is verified: its score is the number of template words that it covers, divided by the template's words
and the words put in between. Licenses of one family share most of their words, so every document word goes to the best span over it (the
higher score, then the longer template), and a span that does not get half of its words names nothing. The
templates are constants of this module, so the broadcast table has some thousand rows whatever the corpus.

Besides, fixed phrases are found where their words stand consecutively; they name the base labels.

Defined cases: a NULL text has no words; every row is scanned on its own, so repeated rows and NULL or repeated ids
give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.ngrams import folded_words, with_windows

GRAM = 3
SLACK = 3  # diagonals at most this far apart belong together
COVERED = 0.7

PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}

# The usual notices of public licenses, and whole texts of the short ones.
_NOTICES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    (
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("isc", "Released under the ISC License."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Licensed under CC0 1.0 Universal."),
)

# The members of the Creative Commons family and how they are spelled out.
_COMMONS = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nc": "Attribution-NonCommercial",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}


def _commons() -> list[tuple[str, str]]:
    out = []
    for code, name in _COMMONS.items():
        out.append((f"cc-{code}", f"Licensed under CC {code.upper()} 4.0."))
        out.append((f"cc-{code}", f"This work is licensed under a Creative Commons {name} 4.0 International License."))
    return out


TEMPLATES = (*_NOTICES, *_commons())


def _template_grams(spark: SparkSession) -> DataFrame:
    """``hash``, the window's words, and the places ``(template, position)`` that it has."""
    rows = [(i, text) for i, (_, text) in enumerate(TEMPLATES)]
    words = with_windows(spark.createDataFrame(rows, "template int, text string").withColumn("words", folded_words(F.col("text"))), "words", [GRAM])
    grams = words.select("template", "words", F.posexplode(f"_w{GRAM}").alias("position", "hash"))
    gram = F.slice("words", F.col("position") + 1, GRAM).alias("gram")
    return grams.select("hash", "template", "position", gram).groupBy("hash", "gram").agg(F.collect_list(F.struct("template", "position")).alias("places"))


def _phrase_starts(phrase: tuple[str, ...]) -> Column:
    """Where the words of a phrase stand consecutively; the last word is looked for first."""
    starts = F.sequence(F.lit(0), F.col("n_words") - len(phrase))
    at = F.filter(starts, lambda i: _all_of(F.get("words", i + j) == w for j, w in enumerate(phrase)))
    possible = (F.col("n_words") >= len(phrase)) & F.array_contains("words", phrase[-1]) & F.array_contains("words", phrase[0])
    return F.when(possible, at).otherwise(F.array().cast("array<int>"))


def _all_of(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified window matches (``template``, ``position``, ``diagonal``), and one row with template -1 per document row."""
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), folded_words(F.col(text)).alias("words")
    ).withColumn("n_words", F.size("words"))
    found = read.withColumns({f"_{label}": _phrase_starts(p) for label, p in PHRASES.items()})
    every = F.concat(*[f"_{label}" for label in PHRASES])
    base = found.withColumns({"n_base": F.size(every), "first_word": F.array_min(every), "last_word": F.array_max(every)})
    base = base.withColumns({f"_{label}": F.size(f"_{label}") for label in PHRASES})
    facts = ["doc_id", "n_words", "n_base", "first_word", "last_word", *[f"_{label}" for label in PHRASES]]
    arrays = with_windows(base, "words", [GRAM]).withColumn("_all", F.concat(F.array(F.lit(None).cast("long")), f"_w{GRAM}"))
    scanned = arrays.select("row", *facts, "words", F.posexplode_outer("_all").alias("at", "hash"))
    joined = scanned.join(F.broadcast(_template_grams(docs.sparkSession)), "hash", "left")
    itself = F.col("at") == 0
    hit = joined.filter(itself | (F.slice("words", F.greatest("at", F.lit(1)), GRAM) == F.col("gram")))
    places = F.when(itself, F.array(F.struct(F.lit(-1).alias("template"), F.lit(0).alias("position")))).otherwise(F.col("places"))
    listed = hit.select("row", "at", *[F.when(itself, F.col(c)).alias(c) for c in facts], F.explode_outer(places).alias("place"))
    return listed.select("row", *facts, "place.template", "place.position", (F.col("at") - 1 - F.col("place.position")).alias("diagonal"))


def spans(voted: DataFrame) -> DataFrame:
    """Per document row and template: merged diagonals with their ``score``, the share of template words covered.

    All steps group by the row first, so one shuffle by row serves them all; a group is one document's matches.
    """
    facts = [c for c in voted.columns if c not in ("row", "template", "position", "diagonal")]
    lines = voted.repartition("row").groupBy("row", "template", "diagonal").agg(F.collect_set("position").alias("positions"), *[F.max(c).alias(c) for c in facts])
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    merged = lines.withColumn("_new", apart.cast("int")).withColumn("span", F.sum("_new").over(order))
    sizes = F.array(*[F.lit(len(_fold(t))) for _, t in TEMPLATES])
    places = F.flatten(F.collect_list(F.transform("positions", lambda p: p + F.col("diagonal"))))
    grouped = merged.groupBy("row", "template", "span").agg(
        F.flatten(F.collect_list("positions")).alias("positions"), F.array_min(places).alias("first"), (F.array_max(places) + GRAM).alias("end"),
        F.min("diagonal").alias("diagonal"), *[F.max(c).alias(c) for c in facts],
    )
    reached = F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + (GRAM - 1))))))
    size = F.element_at(sizes, F.greatest("template", F.lit(0)) + 1)
    put_in = F.greatest(F.lit(0), F.col("end") - F.col("first") - reached)
    score = F.when(F.col("template") >= 0, reached / (size + put_in)).otherwise(F.lit(0.0))
    return grouped.withColumns({"score": score, "size": size}).drop("positions")


def best(found: DataFrame) -> DataFrame:
    """The verified spans that get at least half of their words: ``row``, ``template``, ``first``, ``end`` and ``score``."""
    verified = found.filter((F.col("template") >= 0) & (F.col("score") >= COVERED))
    claim = F.struct("score", "size", (-F.col("template")).alias("early"), (-F.col("span")).alias("nearer"), "first", "end")
    words = verified.select("row", F.explode(F.sequence("first", F.col("end") - 1)).alias("word"), claim.alias("claim"))
    won = words.groupBy("row", "word").agg(F.max("claim").alias("claim"))
    kept = won.groupBy("row", "claim").agg(F.count(F.lit(1)).alias("won")).filter(2 * F.col("won") >= F.col("claim.end") - F.col("claim.first"))
    return kept.select("row", (-F.col("claim.early")).alias("template"), "claim.first", "claim.end", "claim.score")


def _fold(text: str) -> list[str]:
    """The words of a template, counted on the driver as ``folded_words`` does in a plan."""
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def summarise(found: DataFrame) -> DataFrame:
    """One row per document row."""
    labels = F.array(*[F.lit(label) for label, _ in TEMPLATES])
    facts = ["doc_id", "n_words", "n_base", "first_word", "last_word", *[f"_{label}" for label in PHRASES]]
    named = best(found).select("row", F.element_at(labels, F.col("template") + 1).alias("label"))
    both = found.select("row", *facts, "score").unionByName(named, allowMissingColumns=True)
    rows = both.groupBy("row").agg(*[F.max(c).alias(c) for c in facts], F.collect_set("label").alias("own"), F.max("score").alias("score"))
    base = F.array_compact(F.array(*[F.when(F.col(f"_{label}") > 0, F.lit(label)) for label in PHRASES]))
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_base").cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "own")), ",").alias("labels"),
        F.round("score", 6).alias("score"),
    )
