"""Nearest neighbours by inner product through cross-polytope hashing.

Vectors are scaled to unit length and turned by pseudo-rotations (random signs and a fast Hadamard transform, three times); the nearest
signed axis is the hash, and several hashes in a row make a bucket. Each of ``TABLES`` tables has its own rotations. The number
of buckets grows with the table, one per ``BUCKET_ROWS`` rows: the last hash only looks at the first coordinates of its rotation.
If lengths differ, a coordinate is added that brings every vector to the longest length and is 0 for queries; then the smallest angle
is the largest inner product.

A query looks into the buckets that its rotated vector is closest to. How many is measured, not set: for ``CALIBRATED`` queries the
true neighbours among all rows are found, and the number of probes is the least with which ``RECALL`` of them are met. Candidates are
compared in double precision, summed from the first component to the last, on the vectors as given.

Equal vectors are grouped first: of each vector only its k + 1 smallest ids can be among the nearest, and a vector that is asked for
many times is searched once. Buckets are packed into deals of about ``GROUP_ROWS`` vectors. A larger bucket is split over several deals, each
of which gets the queries of that bucket. So a vector is shipped once per table, a query once per deal, and no pairs are formed:
each deal gives each query its best k + 1. What reaches the driver is bounded: the sample's neighbours, and the buckets that hold more than
``GROUP_ROWS`` or a ``MOST_SPLIT``-th of all rows. Queries that found fewer than k are searched once more in all buckets.

Defined cases: rows without an id, and vectors that are NULL, empty, zero or hold NULL or a value that is not finite, take no part; shorter
vectors count as filled up with zeros; of rows that repeat an id the one with the greatest vector counts (by its first component, then the
second and so on); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import durable

TABLES = 4
BUCKET_ROWS = 256
CALIBRATED, RECALL = 256, 0.96
GROUP_ROWS, MOST_SPLIT = 1 << 14, 1 << 16
CELLS = 1 << 22  # scores held at a time


class Hasher:
    """Buckets and probe sequences for vectors of up to ``size`` components."""

    def __init__(self, size: int, buckets: int, longest: float | None, tables: int = TABLES, seed: int = 11):
        self.size, self.longest, self.tables = size, longest, tables
        self.width = 1 << max(0, size + (longest is not None) - 1).bit_length()
        self.axes: list[int] = []  # per hash: the coordinates it looks at
        left = buckets
        while left > 1:
            self.axes.append(min(self.width, 1 << max(0, -(-left // 2) - 1).bit_length()))
            left = -(-left // (2 * self.axes[-1]))
        self.buckets = int(np.prod([2 * a for a in self.axes], dtype=np.int64))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, max(1, len(self.axes)), 3, self.width))

    def unit(self, vectors: np.ndarray, asked: bool) -> np.ndarray:
        """Unit vectors, filled up to the width of the rotations."""
        out = np.zeros((len(vectors), self.width))
        scale = np.abs(vectors).max(axis=1, keepdims=True)
        out[:, : self.size] = vectors / scale
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        if self.longest is not None and not asked:
            share = np.minimum(1.0, norm * scale / self.longest)
            out *= share / norm
            out[:, self.size] = np.sqrt(1.0 - share[:, 0] ** 2)
            return out
        return out / norm

    def _rotated(self, units: np.ndarray, table: int, hash_no: int) -> np.ndarray:
        out = units
        for signs in self.signs[table, hash_no]:
            out = out * signs
            half = 1
            while half < self.width:
                pairs = out.reshape(len(out), -1, 2, half)
                out = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(len(out), -1)
                half *= 2
            out = out / np.sqrt(self.width)
        return out[:, : self.axes[hash_no]]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each indexed vector in each table."""
        units = self.unit(vectors, asked=False)
        out = np.zeros((len(vectors), self.tables), np.int64)
        for table in range(self.tables):
            for hash_no, axes in enumerate(self.axes):
                turned = self._rotated(units, table, hash_no)
                axis = np.abs(turned).argmax(axis=1)
                out[:, table] = out[:, table] * (2 * axes) + 2 * axis + (turned[np.arange(len(turned)), axis] < 0)
        return out

    def probes(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """Per vector and table the ``count`` buckets it is closest to, best first."""
        units = self.unit(vectors, asked=True)
        out = np.zeros((len(vectors), self.tables, min(count, self.buckets)), np.int64)
        for table in range(self.tables):
            codes, losses = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
            for hash_no, axes in enumerate(self.axes):
                turned = self._rotated(units, table, hash_no)
                signed = np.stack((turned, -turned), axis=2).reshape(len(vectors), -1)
                loss = (signed.max(axis=1, keepdims=True) - signed) ** 2
                kept = np.argsort(loss, axis=1, kind="stable")[:, :count]  # no other axis can be in the best ``count``
                sums = (losses[:, :, None] + np.take_along_axis(loss, kept, 1)[:, None, :]).reshape(len(vectors), -1)
                joint = (codes[:, :, None] * (2 * axes) + kept[:, None, :]).reshape(len(vectors), -1)
                best = np.argsort(sums, axis=1, kind="stable")[:, :count]
                codes, losses = np.take_along_axis(joint, best, 1), np.take_along_axis(sums, best, 1)
            out[:, table] = codes
        return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _better(scores: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells that can be among the ``k`` best of their row; sums in another order may be ``slack`` off."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(scores >= (least - slack)[:, None])


def _best(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the ``k`` best of what is asked; ids are counted once."""
    if not len(asked):
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, -scores, asked))
    same = lambda x: x[order][1:] == x[order][:-1]
    order = order[np.concatenate(([True], ~(same(asked) & same(ids))))]  # found in two buckets, with the same score
    begins = np.flatnonzero(np.concatenate(([True], asked[order][1:] != asked[order][:-1])))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def _scored(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, vector numbers and exact scores of all that can be among the ``k`` best."""
    found = []
    size = np.linalg.norm(queries, axis=1) * (np.linalg.norm(vectors, axis=1).max() if len(vectors) else 0.0) * 1e-12
    rows = max(1, CELLS // max(1, len(vectors)))
    for i in range(0, len(queries), rows):
        q, v = _better(queries[i : i + rows] @ vectors.T, k, size[i : i + rows])
        found.append((q + i, v, _products(queries[q + i], vectors[v])))
    q, v, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    best = _best(q, ids[v], s, k)
    return q[best], v[best], s[best]


_FOUND = pa.schema([("rep", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


class _Deal:
    """The vectors of one deal, by bucket."""

    def __init__(self, number: int):
        self.number, self.held, self.ready = number, [], None

    def add(self, *arrays: np.ndarray) -> None:
        self.held.append(arrays)

    def search(self, reps: np.ndarray, queries: np.ndarray, buckets: pa.Array, k: int) -> pa.RecordBatch | None:
        if not self.held and self.ready is None:
            return None
        if self.ready is None:
            ids, vectors, codes = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.argsort(codes, kind="stable")
            self.ready, self.held = (ids[order], vectors[order], codes[order]), []
        ids, vectors, codes = self.ready
        asked = np.repeat(np.arange(len(reps)), np.diff(buckets.offsets.to_numpy()))
        wanted = buckets.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        asked, wanted = asked[order], wanted[order]
        found = []
        for bucket in np.unique(wanted):
            low, high = np.searchsorted(codes, [bucket, bucket + 1])
            if high > low:
                rows = asked[slice(*np.searchsorted(wanted, [bucket, bucket + 1]))]
                q, v, s = _scored(queries[rows], vectors[low:high], ids[low:high], k)
                found.append((rows[q], ids[low:high][v], s))
        if not found:
            return None
        q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
        best = _best(q, i, s, k)
        return pa.RecordBatch.from_arrays([pa.array(reps[q[best]]), pa.array(i[best]), pa.array(s[best])], schema=_FOUND)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id`` and vector ``v`` of the rows that take part."""
    kind = dict(rows.dtypes)[vector]
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    base = rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return base.filter(finite & F.exists("v", lambda x: x != 0))


def _hot(coded: DataFrame, rows: int, tables: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Buckets to split: (table, bucket) to first deal and number of deals; deals of their own, numbered below 0."""
    least = max(GROUP_ROWS, rows * tables / MOST_SPLIT)
    counts = coded.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").agg(F.count(F.lit(1)).alias("n"))
    out, used = {}, 0
    for r in counts.filter(F.col("n") > least).orderBy("t", "code").collect():
        parts = int(-(-r["n"] // least))
        used += parts
        out[r["t"], r["code"]] = (-used, parts)
    return out


def _dealt(coded: DataFrame, reps: DataFrame, hasher: Hasher, probes: int, hot: dict, groups: int) -> DataFrame:
    """Vectors (kind 0) and queries (kind 1) of each deal."""
    vector = dict(coded.dtypes)["v"]
    tables, size = hasher.tables, hasher.size
    schema = pa.schema([("deal", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float32() if vector == "array<float>" else pa.float64())), ("buckets", pa.list_(pa.int64()))])
    ddl = f"deal long, kind int, id long, v {vector}, buckets array<long>"
    # A bucket's number says its table too; neighbouring buckets are spread over the deals.
    spread = lambda codes: ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            codes = np.array(batch.column("codes").to_pylist(), np.int64).reshape(len(ids), tables)
            for t in range(tables):
                named = codes[:, t] * tables + t
                deals = spread(named)
                for i, code in enumerate(codes[:, t].tolist()) if hot else ():
                    if (t, code) in hot:
                        first, parts = hot[t, code]
                        deals[i] = first + int(ids[i]) * 0x9E3779B1 % 0x7FFFFFFF % parts
                columns = [pa.array(deals), pa.array(np.zeros(len(ids), np.int32)), batch.column("id"), batch.column("v").cast(schema.field("v").type), pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32), pa.array(named))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows := max(1, CELLS // (probes * tables * 8))):
                batch = whole.slice(at, rows)
                wanted = hasher.probes(_matrix(batch.column("v"), size), probes)
                named = (wanted * tables + np.arange(tables)[:, None]).reshape(len(wanted), -1)
                deals = spread(named)
                out: dict[str, list] = {"deal": [], "row": [], "buckets": []}
                for i in range(len(named)):
                    to: dict[int, list[int]] = {}
                    for name, deal in zip(named[i].tolist(), deals[i].tolist(), strict=True):
                        first, parts = hot.get((name % tables, name // tables), (deal, 1)) if hot else (deal, 1)
                        for d in range(first, first + parts):
                            to.setdefault(d, []).append(name)
                    out["deal"] += to
                    out["row"] += [i] * len(to)
                    out["buckets"] += to.values()
                picked = batch.take(pa.array(out["row"], pa.int32()))
                columns = [pa.array(out["deal"], pa.int64()), pa.array(np.ones(len(picked), np.int32)), picked.column("id"), picked.column("v").cast(schema.field("v").type), pa.array(out["buckets"], schema.field("buckets").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return coded.mapInArrow(index, ddl).union(reps.mapInArrow(ask, ddl))


def _search(dealt: DataFrame, size: int, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _Deal(-1 << 62)
        for batch in batches:
            numbers, kinds = batch.column("deal").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip(np.append(0, cuts), np.append(cuts, len(numbers)), strict=True):
                if high == low:
                    continue
                piece = batch.slice(low, high - low)
                if deal.number != numbers[low]:
                    deal = _Deal(numbers[low])
                ids, vectors = piece.column("id").to_numpy(), _matrix(piece.column("v"), size)
                if kinds[low] == 0:
                    deal.add(ids, vectors, piece.column("buckets").flatten().to_numpy())
                elif (found := deal.search(ids, vectors, piece.column("buckets"), k)) is not None:
                    yield found

    return dealt.repartition("deal").sortWithinPartitions("deal", "kind").mapInArrow(run, "rep long, id long, score double")


def _one_per_id(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("id").agg(F.max("v").alias("v")).withColumn("code", F.xxhash64("v"))


def _top(found: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best of each key, each id once, with their rank."""
    once = found.groupBy(key, "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def true_neighbours(table: DataFrame, queries: list[tuple[int, np.ndarray]], size: int, k: int, codes: bool = False) -> DataFrame:
    """Exact search for a bounded list of queries among all rows of ``table``, one task's best k each before any shuffle."""
    numbers, vectors = np.array([q[0] for q in queries], np.int64), np.array([q[1] for q in queries])
    schema = pa.schema([*_FOUND, ("codes", pa.list_(pa.int64()))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            ids = batch.column("id").to_numpy()
            q, v, s = _scored(vectors, _matrix(batch.column("v"), size), ids, k + 1)
            own = numbers[q] == ids[v]
            named = np.array(batch.column("codes").to_pylist(), np.int64).reshape(len(ids), -1)[v] if codes else np.zeros((len(v), 0), np.int64)
            new = tuple(x[~own] for x in (q, ids[v], s, named))
            best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new, strict=True))
            keep = _best(best[0], best[1], best[2], k)
            best = tuple(x[keep] for x in best)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[best[0]]), pa.array(best[1]), pa.array(best[2]), pa.array(best[3].tolist(), schema.field("codes").type)], schema=schema)

    found = table.mapInArrow(scan, "rep long, id long, score double, codes array<long>")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def probes_needed(hasher: Hasher, queries: list[tuple[int, np.ndarray]], neighbours: list[tuple[int, list[int]]], recall: float = RECALL) -> int:
    """The least number of probes that meets ``recall`` of the true neighbours, given as (query, bucket in each table)."""
    if not neighbours:
        return hasher.buckets
    row = {q: i for i, (q, _) in enumerate(queries)}
    asked, codes = np.array([row[q] for q, _ in neighbours]), np.array([c for _, c in neighbours])
    vectors, count = np.array([v for _, v in queries]), 64
    while True:
        count = min(count, hasher.buckets)
        place = np.full(len(asked), hasher.buckets)
        step = max(1, CELLS // (hasher.tables * count))
        for low in range(0, len(vectors), step):
            wanted = hasher.probes(vectors[low : low + step], count)
            at = np.flatnonzero((asked >= low) & (asked < low + step))
            for t in range(hasher.tables):
                same = wanted[asked[at] - low, t] == codes[at, t][:, None]
                place[at] = np.minimum(place[at], np.where(same.any(axis=1), same.argmax(axis=1), hasher.buckets))
        needed = int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1
        if needed <= count or count == hasher.buckets:
            return min(needed, hasher.buckets)
        count *= 4


def nearest(rows: DataFrame, k: int, asked: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each row that is ``asked`` for: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``asked`` is a condition on the id.
    """
    base = usable(rows, vec_id, vector)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size"), F.min(length).alias("low"), F.max(length).alias("high")).first()
    n, size = facts["n"], facts["size"] or 1
    longest = facts["high"] if n and facts["high"] < float("inf") and facts["low"] < facts["high"] * (1 - 1e-6) else None
    hasher = Hasher(size, -(-n // BUCKET_ROWS), longest)

    rank = F.row_number().over(W.partitionBy("code", "v").orderBy("id"))
    kept = _one_per_id(base).withColumn("_copy", rank).filter(F.col("_copy") <= k + 1).select("id", "v")
    coded = durable(kept.mapInArrow(_coder(hasher), f"id long, v {dict(kept.dtypes)['v']}, codes array<long>"))
    queries = durable(_one_per_id(usable(rows.filter(asked), vec_id, vector)))
    reps = durable(queries.groupBy("code", "v").agg(F.min("id").alias("id")).select("id", "v", "code"))

    sample = [(r["id"], np.append(np.array(r["v"], np.float64), np.zeros(size - len(r["v"])))) for r in reps.orderBy(F.xxhash64("id"), "id").limit(CALIBRATED).collect()]
    known = true_neighbours(coded, sample, size, k, codes=True).select("rep", "codes").collect() if sample else []
    probes = probes_needed(hasher, sample, [(r["rep"], r["codes"]) for r in known])
    groups = max(1, -(-n * hasher.tables // GROUP_ROWS))
    hot = _hot(coded, n, hasher.tables)
    asked_for = reps.select("id", "v")
    found = durable(_top(_search(_dealt(coded, asked_for, hasher, probes, hot, groups), size, k + 1), "rep", k + 1))
    if probes < hasher.buckets:
        counts = found.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        short = durable(asked_for.join(counts, asked_for["id"] == counts["rep"], "left").filter(F.coalesce("n", F.lit(0)) <= k).select("id", "v"))
        if not short.isEmpty():
            again = _top(_search(_dealt(coded, short, hasher, hasher.buckets, hot, groups), size, k + 1), "rep", k + 1)
            found = found.join(short.select(F.col("id").alias("rep")), "rep", "left_anti").unionByName(again)

    members = queries.withColumnRenamed("id", "query_id").join(reps.withColumnRenamed("id", "rep"), ["code", "v"]).select("query_id", "rep")
    answers = members.join(found.select("rep", "id", "score"), "rep").filter("id != query_id")
    return _top(answers, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _coder(hasher: Hasher):
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = hasher.codes(_matrix(batch.column("v"), hasher.size))
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * hasher.tables
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["id", "v", "codes"])

    return code
