"""Quality rules, decontamination and license scans against plain Python."""

import re

import numpy as np
import pytest
from cases import folded, ordered, rows_of, sha, spaced
from pyspark.sql import functions as F

from linkloom.llm import catalog, decontaminate, licenses, ngrams, quality


def base_counts(text):
    text = text or ""
    words = spaced(text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j + k for at in seen.values() if len(at) > 1 for j in at for k in range(3)}
    lines = [x for x in text.split("\n") if spaced(x)]
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_counts(docs, awkward):
    got = quality.label(docs)
    expected = ordered([(r[0], *base_counts(r[1])) for r in awkward])
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected
    assert not any(r["kept"] for r in got.filter("base_failed").collect())


def test_quality_verdicts_meet_the_labels(spark, sf_dir):
    judged = catalog.op6_quality_rules(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label")
    rows = judged.filter("NOT base_failed").join(labels, "doc_id").collect()
    assert rows and all(r["kept"] == (r["label"] == 1) for r in rows)


def planted_votes(n=20_000, seed=3):
    """Good texts: each rule is right nine times in ten. Bad ones: the first three rules see the defect, the others do not; a fifth abstains."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.9
    votes = np.where(rng.random((n, 6)) < 0.1, -1, 1)
    votes[~good, :3] = np.where(rng.random((int((~good).sum()), 3)) < 0.8, -1, 1)
    votes[rng.random(votes.shape) < 0.2] = 0
    return good, votes


def test_label_model_learns_from_unlabelled_votes():
    good, votes = planted_votes()
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table = quality.fit(patterns, counts.astype(float))
    assert abs(share - 0.9) < 0.02
    assert np.allclose(table[1], [0.72, 0.08, 0.2], atol=0.03) and np.allclose(table[0, :3], [0.16, 0.64, 0.2], atol=0.06)
    kept = (quality.posterior(patterns, share, table) >= 0.5)[inverse]
    assert (kept == good).mean() > 0.95
    all_pass = (votes != -1).all(1)
    assert (all_pass == good).mean() < 0.7


def test_posterior_weighs_votes_and_abstentions():
    """A lone bad vote of a weak rule is outvoted; without any bad vote a text can still look like the bad ones."""
    good, votes = planted_votes()
    votes[~good, 5] = 0  # one rule abstains on what is bad, and hardly elsewhere
    votes[good, 5] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.fit(patterns, counts.astype(float))
    lone, silent = np.array([[1, 1, 1, 1, -1, 1]]), np.array([[0, 0, 0, 1, 1, 0]])
    assert quality.posterior(lone, share, table)[0] > 0.9
    assert quality.posterior(silent, share, table)[0] < 0.5


def test_verdicts_differ_from_all_must_pass(spark):
    """On the given documents; the labels only measure."""
    sf_dir = "/root/testdata/sf0.01"
    votes = quality.rules()
    lone = quality.label(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("any_bad", F.array_contains(F.array(*votes.values()), quality.BAD))
    rows = lone.join(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id", "left").filter("NOT base_failed").collect()
    differ = [r for r in rows if r["kept"] == r["any_bad"]]
    assert len(differ) > 0.002 * len(rows)
    assert all(r["kept"] == (r["label"] == 1) for r in rows if r["label"] is not None)


def test_good_documents_keeps_clashing_columns(docs):
    clashing = docs.withColumns({c: F.lit("mine") for c in ("n_words", "kept", "quality", "base_failed", "_votes")})
    out = quality.good_documents(clashing)
    assert out.columns == clashing.columns
    kept = quality.label(docs).filter("kept")
    assert rows_of(out, "doc_id") == rows_of(kept, "doc_id")
    assert {r["n_words"] for r in out.collect()} <= {"mine"}


ITEMS = [(1, "w1xa w2xb w3xc short item"), (2, None), (3, ""), (None, "emoji 😀"), (1, "W1XA, w2xb; w3xc short ITEM"), (7, "été x y")]


def expected_hits(awkward, items):
    grams = {}
    for item, text in items:
        words = folded(text)
        size = min(10, len(words))
        for s in range(len(words) - size + 1 if size else 0):
            grams.setdefault(tuple(words[s : s + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in awkward:
        words, hit, found = folded(text), set(), set()
        for size in {len(g) for g in grams}:
            for s in range(len(words) - size + 1):
                for item in grams.get(tuple(words[s : s + size]), ()):
                    hit.update(range(s, s + size))
                    found.add(item)
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return ordered(out)


@pytest.mark.parametrize("block_bytes", [32 << 20, 200])
def test_hits(spark, docs, awkward, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rows = [(r[0], r[1]) for r in awkward]
    longest = next(t for _, t in rows if t and len(t) > 100_000)
    items = [*ITEMS, (8, " ".join(longest.split()[500:540])), (9, " ".join(longest.split()[520:545])), (8, "once more " + " ".join(longest.split()[90:101]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    clashing = docs.withColumns({c: F.lit(0) for c in ("row", "words", "hash", "items")})
    got = decontaminate.summarise(decontaminate.hits(clashing, table))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected_hits(rows, items)
    clean = decontaminate.clean_documents(clashing, table)
    assert clean.columns == clashing.columns
    assert clean.count() == sum(not r[-1] for r in expected_hits(rows, items))


def test_hits_without_items_or_documents(spark, docs, no_docs, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.summarise(decontaminate.hits(docs, none))
    assert rows_of(got, "doc_id", "n_hit") == ordered([(r[0], 0) for r in awkward])
    assert decontaminate.hits(no_docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_clean_documents_in_several_blocks(spark, docs, awkward, monkeypatch):
    items = spark.createDataFrame([(1, "mit license apache license"), (2, awkward_text(awkward))], "item_id int, text string")
    usual = rows_of(decontaminate.clean_documents(docs, items), "doc_id", "text")
    assert len(usual) < len(awkward)
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 1)
    clean = decontaminate.clean_documents(docs.withColumn("_version", F.lit("mine")), items)
    assert rows_of(clean, "doc_id", "text") == usual and "_version" in clean.columns
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (hash|range)partitioning", plan)


def awkward_text(awkward):
    return max((r[1] for r in awkward if r[1] and len(r[1]) < 5000), key=len)


def test_decontamination_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows_of(catalog.op1_decontamination(spark, sf_dir), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == expected_hits(rows, items)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 10, 13])
def test_window_hashes_agree_exactly_where_words_do(spark, size):
    words = [str(i % 11) for i in range(60)]
    df = spark.createDataFrame([(words,), (words[:4],), ([],)], "words array<string>")
    for (listed, hashes) in ngrams.with_windows(df, "words", [size]).select("words", f"_w{size}").collect():
        grams = [tuple(listed[i : i + size]) for i in range(len(listed) - size + 1)]
        assert len(hashes) == len(grams)
        assert len(set(zip(hashes, grams, strict=True))) == len(set(hashes)) == len(set(grams))


def phrase_columns(text):
    words = folded(text)
    found = {k: [i for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p] for k, p in licenses.PHRASES.items()}
    every = sorted(i for at in found.values() for i in at)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, at in found.items() if at))


def scan(df):
    return licenses.summarise(licenses.spans(licenses.votes(df)))


def test_license_base_columns(docs, awkward):
    got = scan(docs)
    expected = ordered([(r[0], *phrase_columns(r[1])) for r in awkward])
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got.collect())


def test_license_templates_survive_edits_and_need_their_words(spark):
    mit, gpl = licenses.TEMPLATES[1][1], licenses.TEMPLATES[5][1]
    edited = mit.split()
    edited[10:10] = ["two", "more"]
    del edited[30]
    rows = [(1, f"intro {mit} outro"), (2, "a b c " + " ".join(edited)), (3, " ".join(reversed(mit.split()))), (4, gpl + "\n" + mit), (5, " ".join(mit.split()[:12])), (6, "licensed under CC BY-NC 4.0")]
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "gpl,mit", 5: "", 6: "cc-by-nc"}
    assert got[1]["score"] == 1 and licenses.COVERED <= got[2]["score"] < 1 and 0 < got[5]["score"] < licenses.COVERED


NOTICES = {
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy, visit the site.",
    "cc-by-nd": "Unless noted, this work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "Photos: licensed under CC BY-NC-ND 4.0, all others reserved",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl,lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "": "This work is not licensed at all, and Attribution 4.0 is a word with a number.",
}


def test_notices_of_one_family_are_told_apart(spark):
    """Each notice alone, all of them in one text, and one with words put in."""
    rows = [(i, text) for i, text in enumerate(NOTICES.values())]
    filler = " ".join(f"w{i}" for i in range(30))
    rows.append((90, f" {filler} ".join(NOTICES.values())))
    rows.append((91, NOTICES["cc-by"].replace("Commons", "Commons (we really mean all of these many other words) ")))
    got = {r["doc_id"]: r["labels"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(NOTICES))] == list(NOTICES)
    assert got[90] == ",".join(sorted({x for k in NOTICES for x in k.split(",") if x}))
    assert got[91] == ""


def test_template_words_are_counted_as_the_plan_does():
    assert all(licenses._fold(t) == folded(t) for _, t in licenses.TEMPLATES)


def test_license_empty_table(no_docs):
    assert scan(no_docs).count() == 0


def test_quality_empty_table(no_docs):
    assert quality.label(no_docs).count() == 0
    assert quality.good_documents(no_docs).count() == 0
