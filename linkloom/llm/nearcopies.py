"""Similarity join on word shingles by MinHash bands and exact verification.

A text is the set of its five-word shingles (a shorter text is one shingle). It enters each of ``TREES`` trees under the
path of its MinHash values. Two texts meet if some tree keeps them together down to a depth that is the same for all texts and trees (fixed
banding): the longest at which pairs at the threshold meet with at least the target recall. Texts that meet, also by way of others,
are compared set against set: all pairs that a filter on sizes and least frequent shingles leaves, and it leaves every link. So every
link reported is exact, and a link is lost only if nothing connects its texts: with a probability of 7.6e-5 at similarity 0.8, 2.0e-5 at 0.82.

Equal sets are one text with a number of copies, so copies are never paired with each other. Candidates are gathered by connected
components of the buckets (stars, not pairs), and a component is compared in blocks of bounded size, each pair of blocks in a task of
its own. Only counts and one edge per text leave a block: no pair is ever a row.

Defined cases: a NULL or wordless text is linked to nothing and forms a class of its own; repeated rows are copies; the class id is the
least doc_id in the class, NULL ids coming last (a class of NULL ids has a NULL class id); an empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.rows import pack, unpack
from linkloom.llm.textscan import Scan, chunks, inside, mix, repeats, windows
from linkloom.session import durable

SHINGLE = 5
THRESHOLD = 0.8
TREES = 18
RECALL = 0.9999
DEEPEST = 12
_LAST = (1 << 63) - 1  # stands for a NULL id while rows are compared
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 400_000


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix at which pairs of ``threshold`` similarity still meet with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(scan: Scan, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts in a row, and where each text's begin (one entry more than texts)."""
    n = len(scan.codes)
    counts = scan.word_counts
    starts = np.flatnonzero(inside(scan.first, size, n)[: max(0, n - size + 1)])
    codes = windows(scan.codes, size, size)[starts]
    owner = np.searchsorted(scan.first, starts, side="right") - 1
    for short in range(1, size):
        texts = np.flatnonzero(counts == short)
        if len(texts):
            codes = np.concatenate((codes, windows(scan.codes, short, short)[scan.first[texts]]))
            owner = np.concatenate((owner, texts))
    order = np.argsort(owner, kind="stable")
    codes, owner = codes[order], owner[order]
    once = ~repeats(mix(codes + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))[1]
    codes, owner = codes[once], owner[once]
    return codes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _paths(codes: np.ndarray, begin: np.ndarray, full: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One key per text and tree: the path of its least values down to ``depth``."""
    factors = np.random.default_rng(90_001).integers(1, 1 << 63, (trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(full), trees), np.uint64)
    for t in range(trees):
        for factor in factors[t]:
            least = np.minimum.reduceat(codes * factor, begin[:-1][full])
            out[:, t] = mix(out[:, t] * np.uint64(0x9E3779B97F4A7C55) + least + np.uint64(t + 1))
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: int = TREES, depth: int | None = None) -> DataFrame:
    """Per row: ``doc``, ``version`` (hash of the text), ``node`` (hash of the shingle set, NULL without words) and ``paths``."""
    depth = depth or forest_depth(trees=trees)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scan in chunks(batches):
            codes, begin = shingles(scan)
            full = np.flatnonzero(np.diff(begin))
            node, paths = np.zeros(len(scan.texts), np.int64), [None] * len(scan.texts)
            if len(full):
                node[full] = mix(np.add.reduceat(mix(codes), begin[:-1][full]) + np.diff(begin)[full].astype(np.uint64)).view(np.int64)
                for i, row in zip(full, _paths(codes, begin, full, trees, depth).astype("<u8"), strict=True):
                    paths[i] = row.tobytes()
            empty = np.diff(begin) == 0
            columns = [batch.column("doc"), batch.column("version"), pa.array(node, pa.int64(), mask=empty), pa.array(paths, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "version", "node", "paths"])

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("version"), F.col(text).alias("text"))
    return keyed.mapInArrow(sign, "doc long, version long, node long, paths binary")


def _candidates(nodes: DataFrame, trees: int) -> DataFrame:
    """Texts that share a band with another one, with the component of buckets that holds them."""
    at = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    listed = nodes.select("node", "paths", at.alias("tree")).select("node", F.substring("paths", F.col("tree") * 8 + 1, F.lit(8)).alias("path"))
    listed = listed.select("node", F.xxhash64("path").alias("bucket"))
    shared = listed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    edges = listed.join(shared, "bucket").filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(edges)


_COMPARED = "node long, n_links long, root long"


def _compare(table: pa.Table) -> pa.Table:
    """Count the links between two blocks of texts (or within one) and name the least text that each is linked to."""
    node, copies, block = (table[c].to_numpy() for c in ("node", "copies", "block"))
    sets = [np.frombuffer(s, "<u8") for s in table["codes"].to_pylist()]
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    sizes = np.array([len(s) for s in sets])
    names, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_rarity = np.empty(len(names), np.int64)
    by_rarity[np.argsort(counts, kind="stable")] = np.arange(len(names))
    owner = np.repeat(np.arange(len(sets)), sizes)
    local = by_rarity[local]
    local = local[np.lexsort((local, owner))]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    # Similar sets share at least THRESHOLD of either, so they also share one of the rarest that exceed the rest.
    prefix = sizes - np.ceil(THRESHOLD * sizes - 1e-9).astype(np.int64) + 1
    listed = (np.arange(len(local)) - begin[owner] < prefix[owner]) & (block[owner] == high)
    order = np.argsort(local[listed], kind="stable")
    shared, holder = local[listed][order], owner[listed][order]
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    marks = np.zeros(len(names), bool)
    for i in np.flatnonzero(block == low):
        own = local[begin[i] : begin[i] + prefix[i]]
        first, last = np.searchsorted(shared, own), np.searchsorted(shared, own, side="right")
        spread = np.repeat(last - np.cumsum(last - first), last - first) + np.arange((last - first).sum())
        right = np.unique(holder[spread])
        right = right[right > i] if low == high else right
        right = right[np.minimum(sizes[right], sizes[i]) / np.maximum(sizes[right], sizes[i]) >= THRESHOLD]
        if not len(right):
            continue
        own = local[begin[i] : begin[i + 1]]
        marks[own] = True
        both = np.array([np.count_nonzero(marks[local[begin[j] : begin[j + 1]]]) for j in right])
        marks[own] = False
        right = right[both / (sizes[right] + sizes[i] - both) >= THRESHOLD]
        if len(right):
            links[i] += copies[right].sum()
            links[right] += copies[i]
            met = np.unique(root[np.append(right, i)])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    linked = np.flatnonzero(links)
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    least = np.full(len(node), len(node), np.int64)
    np.minimum.at(least, root, rank)
    return pa.table({"node": node[linked], "n_links": links[linked], "root": node[order[least[root[linked]]]]})


def _compared(docs: DataFrame, nodes: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Verified link counts of the candidate texts, per block pair."""
    wanted = groups.join(nodes.drop("paths"), "node")
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("version"), F.col(text).alias("text"))
    read = keyed.join(wanted, ["doc", "version"])

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scan in chunks(batches):
            codes, begin = shingles(scan)
            packed = [codes[a:b].astype("<u8").tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            columns = [batch.column(c) for c in ("node", "component", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=["node", "component", "copies", "codes"])

    # Rows that repeat an id and a text bring the same set again; one of them is enough.
    found = read.mapInArrow(sets, "node long, component long, copies long, codes binary").dropDuplicates(["node"])
    found = durable(found)
    totals = found.groupBy("component").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("codes") / 8).alias("size"))
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("size") / BLOCK_SHINGLES)).cast("int")
    large = totals.select("component", blocks.alias("blocks")).filter("blocks > 1")
    dealt = found.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    paired = paired.select("component", "low", "high", "block", "node", "copies", "codes")
    # Dealt by block pair: what is already together by component would else stay so, in one task.
    pair = ["component", "low", "high"]
    return paired.repartition(*pair).groupBy(*pair).applyInArrow(_compare, _COMPARED)


def _classes(docs: DataFrame, doc_id: str, text: str, trees: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and per distinct shingle set its ``component``, copies, links and the row that stands for it."""
    signed = durable(signatures(docs, doc_id, text, trees))
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.coalesce("doc", F.lit(_LAST)).alias("doc"), "version", "paths")).alias("one")
    )
    nodes = durable(nodes.select("node", "copies", "one.*"))
    groups = _candidates(nodes, trees)
    compared = durable(_compared(docs, nodes, groups, doc_id, text))
    classes = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = compared.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = nodes.drop("paths").join(classes, "node", "left").join(counted, "node", "left")
    return signed, named.withColumns({"component": F.coalesce("component", "node"), "n_links": F.coalesce("n_links", F.lit(0))})


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """Per row: the id, ``class_id`` (of the connected texts) and ``n_links`` (other rows of at least ``THRESHOLD`` similarity)."""
    signed, named = _classes(docs, doc_id, text, trees)
    least = named.groupBy("component").agg(F.nullif(F.min("doc"), F.lit(_LAST)).alias("class_id"))
    of_node = named.join(least, "component").select("node", "class_id", (F.col("n_links") + F.col("copies") - 1).alias("n_links"))
    return signed.join(of_node, "node", "left").select(
        F.col("doc").alias(doc_id),
        F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id. Rows without words all stay."""
    _, named = _classes(docs, doc_id, text, trees)
    first = named.groupBy("component").agg(F.min(F.struct("doc", "version")).alias("one"))
    keys = first.select(F.col("one.doc").alias("key"), F.col("one.version").alias("version"))
    packed = pack(docs, doc_id, text).withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "version": F.xxhash64(F.coalesce("text", F.lit("")))})
    has_words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    kept = packed.filter(has_words).join(keys, ["key", "version"]).dropDuplicates(["key", "version"])
    return unpack(kept.unionByName(packed.filter(~has_words)), docs, text)
