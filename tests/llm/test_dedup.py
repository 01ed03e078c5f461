"""Near copies and substrings against all-pairs and dictionary versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import cut_repeats, near_classes, ordered, rows_of, sha
from pyspark.sql import functions as F

from linkloom.llm import catalog, components, nearcopies, substrings
from linkloom.llm import textscan as ts


def expected_join(awkward):
    rows = [(r[0], r[1]) for r in awkward]
    classes, links = near_classes(rows)
    ids = [min((rows[j][0] for j in c if rows[j][0] is not None), default=None) for c in classes]
    return ordered([(rows[i][0], ids[i], links[i]) for i in range(len(rows))])


def test_join_finds_every_link(docs, awkward):
    assert rows_of(nearcopies.join(docs), "doc_id", "class_id", "n_links") == expected_join(awkward)


def test_join_in_many_blocks(spark, monkeypatch):
    """A large class of near copies, compared in blocks of a few texts."""
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 50], f"new{i}", *words[i % 50 + 1 :]])) for i in range(80)]
    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", 9)
    got = rows_of(nearcopies.join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id", "n_links")
    classes, links = near_classes(rows)
    assert got == [(i, min(classes[i]), links[i]) for i in range(80)]


def test_block_pairs_of_one_class_are_spread_over_tasks(spark, monkeypatch):
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 50], f"new{i}", *words[i % 50 + 1 :]])) for i in range(80)]
    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", 9)
    monkeypatch.setattr(nearcopies, "components", lambda edges: edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.lit(1).cast("long")))
    dealt = []
    compare = nearcopies._compared

    def spy(*args):
        df = compare(*args)
        dealt.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(nearcopies, "_compared", spy)
    assert nearcopies.join(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_links")).first()[0] > 0
    assert re.search(r"Exchange hashpartitioning\(component[^,]*, low[^,]*, high", dealt[0])


def test_all_links_between_compared_texts_count():
    """Texts at the threshold and above, whatever trees they share; none of the pairs counted by hand may be missing."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 62, 45, np.uint64))]
    for _ in range(39):
        old = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.concatenate((old[rng.random(len(old)) > rng.choice([0.02, 0.1])], rng.integers(0, 1 << 62, rng.integers(0, 4), np.uint64)))))
    sets += [np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.arange(1, dtype=np.uint64)]  # 8 of 10 are exactly the threshold
    lone = [np.full(18, i, "<u8").tobytes() for i in range(len(sets))]  # no two texts share a tree
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 5 * len(both := np.intersect1d(a, b)) >= 4 * (len(a) + len(b) - len(both))}
    assert (40, 41) in near and len(near) > 50
    n = len(sets)
    for blocks in (1, 3):
        got = np.zeros(n, int)
        for low in range(blocks):
            for high in range(low, blocks):
                at = [i for i in range(n) if i % blocks in (low, high)]
                table = pa.table({"low": [low] * len(at), "high": [high] * len(at), "block": [i % blocks for i in at], "node": at, "copies": [1] * len(at), "paths": [lone[i] for i in at], "codes": [sets[i].astype("<u8").tobytes() for i in at]})
                out = nearcopies._compare(table)
                got[out["node"].to_numpy()] += out["n_links"].to_numpy()
        assert list(got) == [sum(i == x for x, _ in near) for i in range(n)]


def test_one_of_each_keeps_one_row_per_class_and_all_columns(docs, awkward):
    clashing = docs.withColumns({c: F.lit("mine") for c in ("node", "key", "version", "component")})
    kept = nearcopies.one_of_each(clashing)
    assert kept.columns == clashing.columns
    rows = [(r[0], r[1]) for r in awkward]
    classes, _ = near_classes(rows)
    wordless = sum(not (t or "").strip(" \t\n\x0b\x0c\r") for _, t in rows)
    with_words = {frozenset(c) for i, c in enumerate(classes) if (rows[i][1] or "").strip(" \t\n\x0b\x0c\r")}
    out = kept.collect()
    assert len(out) == len(with_words) + wordless
    assert {r["node"] for r in out} == {"mine"}


def test_forest_depth_shortens_until_the_recall_is_met():
    depth = nearcopies.forest_depth()
    assert 1 - (1 - 0.8**depth) ** nearcopies.TREES >= nearcopies.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** nearcopies.TREES
    assert nearcopies.forest_depth(trees=1, recall=0.9999) == 1


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2)]
    got = rows_of(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
    assert got == [(i, 1) for i in range(1, 21)] + [(i, 100) for i in range(100, 130)]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cut_removes_exactly_the_later_windows(docs, awkward):
    rows = [(r[0], r[1]) for r in awkward]
    expected = ordered([(i, n, gone, sha(kept)) for (i, _), (n, gone, kept) in zip(rows, cut_repeats(rows), strict=True)])
    got = substrings.cut(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha"))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == expected


def test_cut_keeps_columns_of_any_name(docs):
    names = ("_doc", "_version", "_spans", "_row", "_starts", "doc", "start", "anchor", "a.b", "n_words")
    clashing = docs.withColumns({c: F.lit("mine") for c in names})
    out = substrings.cut(clashing)
    assert out.columns == [c for c in clashing.columns if c != "n_words"] + ["kept", "n_words", "n_removed"]
    assert {tuple(r) for r in out.select(*[f"`{c}`" for c in names[:-1]]).collect()} == {("mine",) * (len(names) - 1)}
    columns = ("doc_id", "n_words", "n_removed", "kept")
    assert rows_of(out, *columns) == rows_of(substrings.cut(docs), *columns)


def test_blocks_and_pieces_of_any_size_give_the_same_factors(awkward, monkeypatch):
    """Without Spark: one text per reference block, and pieces that end at every other batch."""
    rows = [(r[0], r[1]) for r in awkward]
    batch = pa.record_batch({"doc": pa.array([(1 << 63) - 1 if i is None else i for i, _ in rows], pa.int64()), "version": pa.array([hash(t) % 1000 for _, t in rows], pa.int32()), "text": [t for _, t in rows]})

    def covered(chunk, piece):
        monkeypatch.setattr(ts, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(substrings, "PIECE_WINDOWS", piece)
        table = pa.Table.from_batches(list(substrings._index([batch]))).sort_by("anchor")
        out = set()
        for b in substrings._resolve(table.to_batches(max_chunksize=7)):
            for f in b.to_pylist():
                out |= {(f["doc"], f["version"], w) for w in range(f["start"], f["end"])}
        return out

    assert covered(4 << 20, 1 << 19) == covered(1, 5) == covered(2000, 64) != set()


def test_without_repeats_keeps_columns_and_untouched_texts(docs, awkward):
    clashing = docs.withColumns({"kept": F.lit(1), "n_words": F.lit(2), "n_removed": F.lit(3)})
    out = substrings.without_repeats(clashing)
    assert out.columns == clashing.columns
    rows = [(r[0], r[1]) for r in awkward]
    expected = [(i, t if not gone else kept) for (i, t), (n, gone, kept) in zip(rows, cut_repeats(rows), strict=True) if not gone or gone < n]
    assert rows_of(out, "doc_id", "text") == ordered(expected)
    assert {(r["kept"], r["n_words"], r["n_removed"]) for r in out.collect()} == {(1, 2, 3)}


@pytest.mark.parametrize("run", [nearcopies.join, nearcopies.one_of_each, substrings.cut, substrings.without_repeats])
def test_empty_table(no_docs, run):
    assert run(no_docs).count() == 0


def test_frequent_anchors_are_split_and_no_equal_windows_parted(spark, monkeypatch):
    """A phrase in every document, with other words around it: its windows share an anchor but are dealt apart."""
    rng = random.Random(8)
    phrase = [f"p{i}" for i in range(14)]
    rows = [(i, " ".join([*[f"w{rng.randrange(10**6)}" for _ in range(20)], *phrase, *[f"w{rng.randrange(10**6)}" for _ in range(20)]])) for i in range(400)]
    rows += [(1000 + i, rows[i * 7][1]) for i in range(40)]
    monkeypatch.setattr(substrings, "ANCHOR_WINDOWS", 16)
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = substrings._keyed(docs, "doc_id", "text").select(F.col("_doc").alias("doc"), F.col("_version").alias("version"), "text")
    frequent, parts = substrings.split_anchors(keyed)
    assert len(frequent) >= 1 and parts.max() >= 16 and list(frequent) == sorted(frequent)
    batch = pa.record_batch({"doc": [i for i, _ in rows], "version": pa.array([0] * len(rows), pa.int32()), "text": [t for _, t in rows]})

    def largest(*split):
        held = {}
        for b in substrings._index([batch], *split):
            for anchor, codes in zip(b.column("anchor").to_pylist(), b.column("codes").to_pylist(), strict=True):
                held[anchor] = held.get(anchor, 0) + len(codes or b"")
        return max(held.values()) // 6

    assert largest(frequent, parts) * 8 < largest()
    got = rows_of(substrings.cut(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha")), "doc_id", "n_words", "n_removed", "sha")
    assert got == ordered([(i, n, gone, sha(kept)) for (i, _), (n, gone, kept) in zip(rows, cut_repeats(rows), strict=True)])


def test_queries_match_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    cut = [(i, n, gone, sha(kept)) for (i, _), (n, gone, kept) in zip(rows, cut_repeats(rows), strict=True)]
    assert rows_of(catalog.op10_substring_dedup(spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(cut)
    classes, links = near_classes(rows)
    joined = [(rows[i][0], min(rows[j][0] for j in classes[i]), links[i]) for i in range(len(rows))]
    assert rows_of(catalog.op3_ngram_jaccard_join(spark, sf_dir), "doc_id", "class_id", "n_links") == ordered(joined)
