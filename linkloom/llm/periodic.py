"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least ``MIN_LENGTH`` words and ``MIN_EXPONENT``
periods long and that no neighbouring word extends. The suffixes of a text are brought into an order that puts common prefixes
side by side (prefix doubling), neighbours are weighted with the length of their common prefix (LCP), and the suffix classes are
united by decreasing LCP with union-find. Each class keeps its positions in order. Two positions that become neighbours in
a united class agree on exactly as many words as the level says; if their distance is no larger, they seed a run:

- its period is the distance, and no smaller one exists, as the shorter shift would have been united earlier and stood between them;
- it ends where the agreement ends, and it starts at the left position unless the words before the two are equal. In that case the same
  run is seeded again further left, so every run is found once.

Suffixes that agree on less than the shortest run of period 1 needs can seed nothing, so the descent ends there.
The smaller class moves into the larger one; positions are kept in blocks, so one move costs the root of the class at most.

A text is worked on as a whole, in pieces of ``CHUNK_BYTES`` of text (or one text, if longer). A piece takes 4 bytes per word
and doubling, that is 4 * log2 of the longest repeat, besides some fixed arrays. Nothing is shuffled.

Defined cases: a NULL, empty or blank text has no words and no runs, its collapsed text is empty; each row is judged by itself, so rows
that repeat an id or a text get equal results; an empty table gives an empty result; columns other than the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
CHUNK_BYTES = 2 << 20
BLOCK = 1024
SPACES = "[\\x20\\x09-\\x0D]+"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_DDL = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

Run = tuple[int, int, int]  # start, length, period


class _Places:
    """Positions in order, in blocks."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, place: int):
        self.blocks, self.heads, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        return chain.from_iterable(self.blocks)

    def _block(self, place: int) -> int:
        return max(0, bisect_right(self.heads, place) - 1)

    def add(self, place: int) -> None:
        at = self._block(place)
        block = self.blocks[at]
        insort(block, place)
        self.size += 1
        if len(block) > BLOCK:
            self.blocks.insert(at + 1, block[BLOCK // 2 :])
            del block[BLOCK // 2 :]
            self.heads.insert(at + 1, self.blocks[at + 1][0])
        self.heads[at] = block[0]

    def around(self, place: int) -> tuple[int | None, int | None]:
        at = self._block(place)
        block = self.blocks[at]
        i = bisect_left(block, place)
        before = block[i - 1] if i else self.blocks[at - 1][-1] if at else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None
        return before, after


def _neighbours(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes and their LCP, where it is ``least`` or more.

    ``words`` are small numbers; every text ends with a number that occurs nowhere else, so no common prefix leaves its text.
    """
    rank = words.astype(np.int64)
    live = np.arange(len(rank))
    names, reach = [], 1  # names[i]: what 2**i words from each position are called
    while True:
        order = live[np.argsort(rank[live], kind="stable")]
        new = np.concatenate(([True], rank[order[1:]] != rank[order[:-1]])) if len(order) else np.zeros(0, bool)
        shared = ~(new & np.concatenate((new[1:], [True])))
        order, new = order[shared], new[shared]
        names.append(rank.astype(np.int32) if len(rank) < 1 << 31 else rank.copy())
        if reach <= least:
            base = order
        if not len(order):
            break
        # Sort each class by what follows the words that its members share; the first of a new class gives it its rank.
        following = rank[order + reach]
        group = np.cumsum(new) - 1
        inner = np.lexsort((following, group))
        order, following = order[inner], following[inner]
        split = new | np.concatenate(([True], following[1:] != following[:-1]))
        begins, at = np.flatnonzero(new), np.arange(len(order))
        rank = rank.copy()
        rank[order] = rank[order] + np.maximum.accumulate(np.where(split, at, 0)) - begins[group]
        live, reach = order, 2 * reach
    base = base[np.argsort(rank[base], kind="stable")]
    left, right = base[:-1], base[1:]
    agreed = np.zeros(len(left), np.int64)
    for level in range(len(names) - 1, -1, -1):
        same = names[level][left + agreed] == names[level][right + agreed]
        agreed += same.astype(np.int64) << level
    long = np.flatnonzero(agreed >= least)
    return left[long], right[long], agreed[long]


def _first_ranks(words: np.ndarray) -> np.ndarray:
    """Each number becomes the place of its first occurrence in sorted order, so that refined ranks stay apart."""
    ordered = np.sort(words)
    return np.searchsorted(ordered, words)


def seeds(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs of the numbered words, each once, in no order. Texts must end with numbers of their own."""
    least = max(1, min_length - 1)
    left, right, agreed = (x.tolist() for x in _by_level(*_neighbours(_first_ranks(words), least)))
    root: dict[int, int] = {}
    places: dict[int, _Places] = {}
    spelled = words.tolist()
    found: list[Run] = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def seed(p: int, q: int, level: int) -> None:
        period = q - p
        if period <= level and level + period >= max(min_length, min_exponent * period) and (p == 0 or spelled[p - 1] != spelled[q - 1]):
            found.append((p, level + period, period))

    for x, y, level in zip(left, right, agreed, strict=True):
        big, small = find(x), find(y)
        if (places[big].size if big in places else 1) < (places[small].size if small in places else 1):
            big, small = small, big
        root[small] = big
        into = places.get(big) or places.setdefault(big, _Places(big))
        moved = list(places.pop(small)) if small in places else [small]
        for p in moved:
            into.add(p)
        for i, p in enumerate(moved):
            before, after = into.around(p)
            if before is not None and not (i and moved[i - 1] == before):
                seed(before, p, level)
            if after is not None and not (i + 1 < len(moved) and moved[i + 1] == after):
                seed(p, after, level)
    return found


def _by_level(left: np.ndarray, right: np.ndarray, agreed: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(-agreed, kind="stable")
    return left[order], right[order], agreed[order]


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as its words, by start and then period."""
    numbers, firsts, used = [], [0], 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        numbers.append(np.append(ids, len(known)) + used)  # the last number ends the text
        used += len(known) + 1
        firsts.append(firsts[-1] + len(words) + 1)
    out: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return out
    found = sorted(seeds(np.concatenate(numbers)), key=lambda r: (r[0], r[2]))
    owner = np.searchsorted(firsts, [r[0] for r in found], side="right") - 1
    for i, (start, length, period) in zip(owner, found, strict=True):
        out[i].append((start - firsts[i], length, period))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words left when each run keeps only its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def _pieces(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    piece, size = [], 0
    for text in texts:
        if size and size + len(text or b"") > CHUNK_BYTES:
            yield piece
            piece, size = [], 0
        piece.append((text or b"").split())
        size += len(text or b"") + 1
    if piece:
        yield piece


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``n_words``, its ``runs`` by start and then period, and the ``collapsed`` text (words joined by one space)."""
    kind = dict(docs.dtypes)[doc_id]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for piece in _pieces(batch.column(1).cast(pa.binary()).to_pylist()):
                runs = runs_of(piece)
                left = [b" ".join(collapse(words, r)) for words, r in zip(piece, runs, strict=True)]
                listed = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs]
                columns = [batch.column(0).slice(at, len(piece)), pa.array([len(w) for w in piece], pa.int64()), pa.array(listed, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(piece)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id {kind}, {_DDL}")


def digest(found: DataFrame) -> DataFrame:
    """Per row: number of runs, the strongest one (greatest exact length / period, then least start and period), and two hashes."""
    stronger = F.array_sort(
        "runs",
        lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.signum(b["length"] * a["period"] - a["length"] * b["period"]))
        .when(a["start"] != b["start"], F.signum(a["start"] - b["start"]))
        .otherwise(F.signum(a["period"] - b["period"]))
        .cast("int"),
    )
    best = found.withColumn("_best", F.get(stronger, F.lit(0)))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return best.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stand-in input of the query: every tenth document (by the hash of its id) gets a periodic tail; a NULL id hashes as ''.

    Such a text becomes its words joined by one space; all others stay as they are.
    """
    hashed = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    seed = F.floor(hashed / 10)
    words = F.array_remove(F.split(text, SPACES), "")

    def planted(w: Column) -> Column:
        n = F.size(w)
        first = F.pmod(seed, n).cast("int")
        period = (F.lit(1) + F.floor((n - first) / (F.lit(3) + F.pmod(seed, F.lit(8))))).cast("int")
        placed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < first, i).otherwise(first + (i - first) % period)))
        return F.when(n > 0, F.concat_ws(" ", placed))

    changed = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.withColumn(text, F.when(hashed % 10 == 0, F.coalesce(changed, F.col(text))).otherwise(F.col(text)))
