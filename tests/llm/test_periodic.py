"""Periodic runs against a version that tries every period."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from cases import DOCS, ordered, rows_of, sha, spaced
from pyspark.sql import functions as F

from linkloom.llm import catalog, periodic

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def plain_runs(words):
    _, ids = np.unique(np.array(words, object).astype(str), return_inverse=True) if words else (None, np.zeros(0, int))
    found = {}
    for period in range(1, len(ids) // 4 + 1):
        same = np.concatenate(([False], ids[period:] == ids[:-period], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            run = (int(start), int(end - start) + period)
            if run[1] >= max(6, 4 * period):
                found.setdefault(run, period)  # a larger period of the same stretch is not its smallest
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), kept)


def plant(doc_id, text):
    words = spaced(text)
    hashed = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = hashed // 10, len(words)
    if hashed % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_of_random_texts():
    rng = random.Random(8)
    texts = []
    for _ in range(500):
        letters = rng.choice([1, 2, 3, 6])
        words = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(70))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 7)
        texts.append(words)
    got = periodic.runs_of(texts)
    assert got == [plain_runs([w.decode() for w in words]) for words in texts]
    assert sum(map(len, got)) > 200


@pytest.mark.parametrize("block", [4, 1024])
def test_long_runs_move_between_blocks(monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    words = [b"x"] * 3000 + [b"%d" % (i % 7) for i in range(700)] + [b"y", b"x"] * 40
    assert periodic.runs_of([words, [], [b"x"] * 6, [b"x"] * 5]) == [[(0, 3000, 1), (3000, 700, 7), (3700, 80, 2)], [], [(0, 6, 1)], []]


def test_places_stay_in_order():
    rng = random.Random(2)
    values = rng.sample(range(100_000), 5000)
    places = periodic._Places(values[0])
    for v in values[1:]:
        places.add(v)
    assert list(places) == sorted(values) and len(places.blocks) > 1
    in_order = [None, *sorted(values), None]
    assert all(places.around(in_order[i]) == (in_order[i - 1], in_order[i + 1]) for i in range(1, len(values) + 1))


def test_awkward_documents(docs, awkward):
    clashing = docs.withColumns({c: F.lit("mine") for c in ("n_words", "runs", "collapsed", "words")})
    got = rows_of(periodic.digest(periodic.find(clashing)), *COLUMNS)
    assert got == ordered([plain_digest(r[0], spaced(r[1])) for r in awkward])


def test_planted_runs(docs, awkward):
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in awkward)
    got = rows_of(periodic.digest(periodic.find(periodic.with_planted_runs(docs))), *COLUMNS)
    assert got == ordered([plain_digest(r[0], plant(r[0], r[1])) for r in awkward])


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = ordered([plain_digest(r[0], plant(r[0], r[1])) for r in rows])
    assert rows_of(catalog.op13_periodic_runs(spark, sf_dir), *COLUMNS) == want
    assert sum(r[1] for r in want) > 10


def test_empty_table(spark):
    assert periodic.digest(periodic.find(periodic.with_planted_runs(spark.createDataFrame([], DOCS)))).collect() == []
