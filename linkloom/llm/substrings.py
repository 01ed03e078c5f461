"""Substring de-duplication by relative Lempel-Ziv parsing.

The corpus is read in reference blocks of a few megabytes of text. In each block every document is factored greedily
against the block: neighbouring windows whose first occurrences neighbour each other form one factor. What the block does not explain goes into the index:
one entry per run of windows that share their least 5-word code (the anchor), holding the codes of those windows. Equal
windows have equal anchors, so entries that meet under one anchor are all that has to be compared; a repeat of another block's words is
found there, window by window, and not by factoring against that block's text. Since each window is looked up by itself, words at the boundary of two factors are covered by
the windows that straddle it.

A window of ``WINDOW`` words is a repeat if the same words also start earlier: under a smaller doc_id, or in the same
document at a smaller position. A block sends each of its windows at most once, so a passage that a third of all documents
share is one entry per block. Different windows that straddle a frequent phrase share its anchor; so the anchors of most windows are
looked for in a sample of the documents, and each is split by bits of the windows' own codes, which parts no equal windows. The sample only
decides how evenly the work is dealt. Blocks and documents are processed in bounded pieces; index entries in pieces of ``PIECE_WINDOWS`` and
at most one anchor more, which has about ``ANCHOR_WINDOWS`` windows (or a 65536th of all, or a single window's copies, one a block).

Defined cases: a NULL text has no words; rows with a NULL doc_id come after all others and count as one document; rows that
repeat a doc_id start at the same places, so they are not repeats of each other; texts of fewer than ``WINDOW`` words lose nothing; an
empty table gives an empty result; columns other than the id and the text are ignored by ``factors`` and kept by ``cut``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.rows import pack, unpack
from linkloom.llm.textscan import Scan, chunks, inside, long_windows, mix, repeats, runs, sliding_min, windows
from linkloom.session import durable

WINDOW, ANCHOR = 20, 5
PIECE_WINDOWS = 1 << 19
ANCHOR_WINDOWS = 1 << 16  # an anchor that seems to have more is split
MOST_SPLIT = 1 << 16  # an anchor that has a smaller share of all windows is not split, nor is one into more
SAMPLED = 32  # one document of so many is looked at for frequent anchors
_CODE_BYTES = 6  # a window code's bytes in the index; the 64 bits of the anchor come on top
_LAST = (1 << 63) - 1

_SCHEMA = pa.schema([
    ("anchor", pa.int64()), ("doc", pa.int64()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("source", pa.int64()), ("source_start", pa.int32()), ("codes", pa.binary()),
])
_DDL = "anchor long, doc long, version int, start int, end int, source long, source_start int, codes binary"


def _repeated(keys: np.ndarray, exact: tuple[np.ndarray, ...], doc: np.ndarray, pos: np.ndarray):
    """Indices of the windows that also start earlier, with the place of the earliest; ``exact`` must agree too."""
    some = np.flatnonzero(repeats(keys)[0])
    order = some[np.lexsort((pos[some], doc[some], *[e[some] for e in exact], keys[some]))]
    if not len(order):
        return order, order, order
    new = np.concatenate(([True], np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (keys, *exact)])))
    earliest = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (doc[order] != doc[earliest]) | (pos[order] != pos[earliest])
    found = np.argsort(order[later])
    return order[later][found], doc[earliest[later][found]], pos[earliest[later][found]]


def _factors(doc, version, pos, source, source_pos) -> pa.RecordBatch:
    """Greedy factors: runs of windows whose sources run along. All arrays come in the order of places."""
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)
    step = lambda x: x[1:] != x[:-1]
    begin, end = runs(step(doc), step(version), np.diff(pos) != 1, step(source), np.diff(source_pos) != 1)
    spread = mix(doc[begin].astype(np.uint64) * np.uint64(31) + pos[begin].astype(np.uint64)).view(np.int64)
    columns = [spread, doc[begin], version[begin], pos[begin], pos[end] + WINDOW, source[begin], source_pos[begin]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=False)] + [pa.nulls(len(begin), pa.binary())], schema=_SCHEMA)


def _entries(doc, version, pos, anchor, codes) -> pa.RecordBatch:
    step = lambda x: x[1:] != x[:-1]
    begin, end = runs(step(doc), step(version), np.diff(pos) != 1, step(anchor))
    packed = np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_CODE_BYTES])
    offsets = np.concatenate((begin, [len(codes)])).astype(np.int32) * _CODE_BYTES
    listed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])
    none = lambda kind: pa.nulls(len(begin), kind)
    columns = [
        pa.array(anchor[begin].view(np.int64)), pa.array(doc[begin]), pa.array(version[begin]), pa.array(pos[begin], pa.int32()),
        none(pa.int32()), none(pa.int64()), none(pa.int32()), listed,
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the number of different windows under each anchor, and of all under a NULL."""
    for _, scan in chunks(batches):
        n = len(scan.codes)
        if n < WINDOW:
            continue
        at = np.flatnonzero(inside(scan.first, WINDOW, n)[: n - WINDOW + 1])
        at = at[np.unique(long_windows(scan.codes, WINDOW)[at], return_index=True)[1]]
        anchors, counts = np.unique(sliding_min(windows(scan.codes, ANCHOR), WINDOW - ANCHOR + 1)[at], return_counts=True)
        listed = pa.concat_arrays([pa.array(anchors.view(np.int64)), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([listed, pa.array(np.append(counts, len(at)), pa.int64())], names=["anchor", "n"])


def split_anchors(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The anchors to split, in order, and into how many (a power of two), from ``doc``, ``version`` and ``text``."""
    some = keyed.filter(F.pmod(F.xxhash64("doc", "version"), F.lit(SAMPLED)) == 0)
    counts = durable(some.mapInArrow(_frequent, "anchor long, n long").groupBy("anchor").agg((F.sum("n") * SAMPLED).alias("n")))
    total = counts.filter("anchor IS NULL").first()
    least = max(ANCHOR_WINDOWS, (total["n"] if total else 0) / MOST_SPLIT)
    found = counts.filter(F.col("anchor").isNotNull() & (F.col("n") > least)).collect()
    anchors, n = (np.array([r[c] for r in found], np.int64) for c in ("anchor", "n"))
    order = np.argsort(anchors.view(np.uint64))
    parts = np.exp2(np.ceil(np.log2(n[order] / least))).astype(np.uint64)
    return anchors.view(np.uint64)[order], np.minimum(parts, np.uint64(MOST_SPLIT))


def _split(anchors: np.ndarray, codes: np.ndarray, frequent: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """``anchors`` of windows, each frequent one replaced by as many as it has parts."""
    at = np.minimum(np.searchsorted(frequent, anchors), len(frequent) - 1)
    hot = np.flatnonzero(frequent[at] == anchors)
    out = anchors.copy()
    out[hot] = mix(anchors[hot] + mix(codes[hot]) % parts[at[hot]] * np.uint64(0x9E3779B97F4A7C55))
    return out


def _index(batches: Iterable[pa.RecordBatch], frequent: np.ndarray | None = None, parts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Per reference block: the factors within the block, and index entries for the windows it explains no other way."""
    for batch, scan in chunks(batches):
        yield from _index_block(scan, batch.column("doc").to_numpy(), batch.column("version").to_numpy(), frequent, parts)


def _index_block(scan: Scan, docs: np.ndarray, versions: np.ndarray, frequent: np.ndarray | None, parts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n = len(scan.codes)
    if n < WINDOW:
        return
    at = np.flatnonzero(inside(scan.first, WINDOW, n)[: n - WINDOW + 1])
    owner = scan.text_of_word()[at]
    doc, version, pos = docs[owner], versions[owner], at - scan.first[owner]
    codes = long_windows(scan.codes, WINDOW)[at]
    again, source, source_pos = _repeated(codes, (), doc, pos)
    yield _factors(doc[again], version[again], pos[again], source, source_pos)
    left = np.ones(len(at), bool)
    left[again] = False
    if left.any():
        anchors = sliding_min(windows(scan.codes, ANCHOR), WINDOW - ANCHOR + 1)[at]
        anchors, codes = anchors[left], codes[left]
        if frequent is not None and len(frequent):
            anchors = _split(anchors, codes, frequent, parts)
        yield _entries(doc[left], version[left], pos[left], anchors, codes)


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the entries under each anchor, which come sorted by anchor; factors pass through."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("codes").nbytes // _CODE_BYTES + batch.num_rows
        if size >= PIECE_WINDOWS:
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            yield from _resolve_piece(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = len(anchor) - cut if cut else size // 2
    if held:
        yield from _resolve_piece(pa.Table.from_batches(held))


def _resolve_piece(table: pa.Table) -> Iterator[pa.RecordBatch]:
    done = pc.is_null(table["codes"])
    yield from table.filter(done).to_batches()
    table = table.filter(pc.invert(done))
    if not table.num_rows:
        return
    counts = pc.binary_length(table["codes"]).to_numpy() // _CODE_BYTES
    packed = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(-1, _CODE_BYTES)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :_CODE_BYTES] = packed
    codes = wide.view("<u8").ravel().astype(np.uint64)
    entry = np.repeat(np.arange(len(counts)), counts)
    pos = table["start"].to_numpy()[entry] + np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor, doc = table["anchor"].to_numpy()[entry].view(np.uint64), table["doc"].to_numpy()[entry]
    again, source, source_pos = _repeated(mix(anchor + codes * np.uint64(0xD1342543DE82EF95)), (codes, anchor), doc, pos)
    version = table["version"].to_numpy()[entry]
    if len(again):
        order = again[o := np.lexsort((pos[again], version[again], doc[again]))]
        yield _factors(doc[order], version[order], pos[order], source[o], source_pos[o])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({
        "_doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), "_version": F.shiftright(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 32).cast("int")
    })


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated spans: words ``start`` to ``end`` of ``doc``, and where the earliest copy starts.

    ``version`` is a hash of the text, which tells apart different texts under one id. Factors that the anchors cut apart are
    not joined again; they overlap by ``WINDOW`` - 1 words.
    """
    keyed = _keyed(docs, doc_id, text).select(F.col("_doc").alias("doc"), F.col("_version").alias("version"), F.col(text).alias("text"))
    frequent, parts = split_anchors(keyed)
    entries = keyed.mapInArrow(lambda batches: _index(batches, frequent, parts), _DDL).repartition("anchor").sortWithinPartitions("anchor")
    return entries.mapInArrow(_resolve, _DDL).drop("anchor", "codes")


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by one space), ``n_words`` and ``n_removed``."""
    added = [c for c in ("kept", "n_words", "n_removed") if c in docs.columns]
    base = docs.drop(*added)
    kept = base.columns
    spans = factors(docs, doc_id, text).groupBy(F.col("doc").alias("_doc"), F.col("version").alias("_version"))
    spans = spans.agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    keyed = _keyed(base.select(F.struct(*[f"`{c}`" for c in kept]).alias("_row")), f"_row.`{doc_id}`", f"_row.`{text}`")  # no column of the caller's can clash
    ready = keyed.join(spans, ["_doc", "_version"], "left").select("_row", F.col("_spans.start").alias("_starts"), F.col("_spans.end").alias("_ends"))
    made = T.StructType([ready.schema["_row"], T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_row").field(kept.index(text)).cast(pa.binary()).to_pylist()
            left, n_words, n_removed = [], [], []
            for words, starts, ends in zip(((t or b"").split() for t in texts), batch.column("_starts").to_pylist(), batch.column("_ends").to_pylist(), strict=True):
                n_words.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, ends, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                n_removed.append(n_words[-1] - len(words))
                left.append(b" ".join(words))
            extra = [pa.array(left, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *extra], names=["_row", "kept", "n_words", "n_removed"])

    return ready.mapInArrow(remove, made).select("_row.*", "kept", "n_words", "n_removed")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated words cut out. Texts that repeat nothing stay as they are; those that lose every word go."""
    cut_docs = cut(pack(docs, doc_id, text)).filter("n_removed = 0 OR n_removed < n_words")
    return unpack(cut_docs.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs, text)
