"""Benchmark decontamination: find windows of benchmark items in documents, by columns alone.

The distinct windows of all items become a hash set. Its size in bytes is measured; it is broadcast in blocks of at most
``BLOCK_BYTES``, and the documents are scanned once per block, so a benchmark of any size takes the same way. Every
window of every document is looked up; a hit counts only if the words themselves agree. Only hits, and one row per document, leave the scan.

Defined cases: NULL or wordless texts and items have no windows; an item without an id counts as the item ``''``; repeated items
add nothing; every document row gets a row of its own, repeated or not; items that share a window are all named;
an empty benchmark hits nothing. Other columns of either table are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.ngrams import folded_words, with_windows
from linkloom.llm.rows import pack, unpack
from linkloom.session import durable

WINDOW = 10
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 1 << 20


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows with their words, length and the sorted ids of the items that hold them."""
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), folded_words(F.col(text)).alias("words"))
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    cut = listed.filter(F.size("words") > 0).select("item", "words", size.alias("size"), F.explode(starts).alias("start"))
    grams = cut.select("item", "size", F.slice("words", F.col("start"), F.col("size")).alias("gram"))
    return grams.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row ``doc_id``, ``version`` (hash of the text), ``n_words``, the hit ``spans`` (start, end; by start) and the ``items`` found."""
    sized = durable(item_windows(items, window=window))
    lengths = sorted(r["size"] for r in sized.select("size").distinct().collect())  # at most ``window`` values
    hashed = None
    for size in lengths:
        one = with_windows(sized.filter(F.col("size") == size), "gram", [size])
        one = one.select(F.element_at(f"_w{size}", 1).alias("hash"), F.col("size").alias("gram_size"), "gram", "items")
        hashed = one if hashed is None else hashed.unionByName(one)
    read = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("version"),
        folded_words(F.col(text)).alias("words"),
    ).withColumn("n_words", F.size("words"))
    arrays = with_windows(read, "words", lengths)
    # One leading NULL, which no window matches, stands for the document itself.
    listed = arrays.withColumn("_all", F.concat(F.array(F.lit(None).cast("long")), *[f"_w{s}" for s in lengths]))
    scanned = listed.select("row", "doc_id", "version", "n_words", "words", F.posexplode_outer("_all").alias("at", "hash"))
    if hashed is None:
        found = scanned.select("*", F.lit(None).cast("int").alias("gram_size"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("array<string>").alias("items"))
    else:
        total = hashed.agg(F.sum(F.length(F.concat_ws(" ", "gram", "items")) + 64)).first()[0] or 0
        blocks = max(1, math.ceil(total / BLOCK_BYTES))
        found = None
        for block in range(blocks):
            side = F.broadcast(hashed.filter(F.pmod("hash", F.lit(blocks)) == block))
            joined = scanned.join(side, "hash", "left" if block == 0 else "inner")
            start, before = F.lit(None).cast("int"), F.lit(1)
            for size in lengths:
                start = F.coalesce(start, F.when(F.col("gram_size") == size, F.col("at") - before))
                before = before + F.greatest(F.col("n_words") - (size - 1), F.lit(0))
            placed = joined.withColumn("start", start)
            right = F.slice("words", F.col("start") + 1, F.col("gram_size")) == F.col("gram")
            right = (F.col("gram_size") == F.least(F.col("n_words"), F.col("gram_size"))) & right
            part = placed.filter(right | (F.col("at") == 0)) if block == 0 else placed.filter(right)
            found = part if found is None else found.unionByName(part)
    span = F.when(F.col("start").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.col("gram_size")).alias("end")))
    return found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("version").alias("version"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).drop("row")


def covered(spans: str = "spans"):
    """How many words lie in any of the spans, which come sorted by start."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        first,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["n"].cast("long"),
    )


def summarise(found: DataFrame) -> DataFrame:
    """The digest of ``hits`` per document."""
    n_hit = covered()
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item.

    The ids and versions of the others are broadcast in blocks of ``BLOCK_ROWS``, counted first, so no text is shuffled.
    """
    bad = hits(docs, items, doc_id, text, window).filter(F.size("spans") > 0)
    bad = durable(bad.select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct())
    blocks = max(1, math.ceil(bad.count() / BLOCK_ROWS))
    packed = pack(docs, doc_id, text).withColumn("_version", F.xxhash64(F.coalesce("text", F.lit(""))))
    for block in range(blocks):
        part = F.broadcast(bad.filter(F.pmod("bad_version", F.lit(blocks)) == block))
        packed = packed.join(part, (F.col("_version") == F.col("bad_version")) & F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return unpack(packed, docs, text)
