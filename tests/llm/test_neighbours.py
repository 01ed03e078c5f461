"""Cross-polytope search against brute force: recall, exact scores, exact order, and awkward vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import catalog, crosspolytope

SCHEMA = "vec_id long, embedding array<float>, rep string, id string, codes int"


def plain_scores(rows, asked):
    """Per query the scores of all candidates, best first; sums run from the first component to the last."""
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known[i] = max(known.get(i, ()), tuple(np.float32(v).astype(float)))
    size = max(map(len, known.values()), default=0)
    ids, vectors = np.array(list(known)), np.array([np.append(v, np.zeros(size - len(v))) for v in known.values()])
    out = {}
    for query in filter(asked, known):
        sums, vector = np.zeros(len(vectors)), vectors[ids == query][0]
        for j in range(size):
            sums += vector[j] * vectors[:, j]
        out[query] = sorted(((i, s) for i, s in zip(ids.tolist(), sums.tolist(), strict=True) if i != query), key=lambda x: (-x[1], x[0]))
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def check(got, want, k, least):
    """Ranks, order and scores are exact; ``least`` of the true neighbours are found."""
    assert set(got) == {q for q, w in want.items() if w}
    hits = 0
    for query, rows in got.items():
        scores = dict(want[query])
        assert [r[0] for r in rows] == list(range(1, min(k, len(scores)) + 1))
        assert rows == [(i + 1, v, scores[v]) for i, (v, _) in enumerate(sorted(((r[1], scores[r[1]]) for r in rows), key=lambda x: (-x[1], x[0])))]
        hits += len({v for v, _ in want[query][:k]} & {r[1] for r in rows})
    assert hits >= least * sum(min(k, len(w)) for w in want.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "mine", None, 3) for i, v in rows], SCHEMA).repartition(4)


def search(df, k=10, every=5):
    return crosspolytope.nearest(df, k, F.col("vec_id") % every == 0)


def test_query_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(found(catalog.op11_nearest_neighbours(spark, sf_dir)), plain_scores(rows, lambda i: i % 20 == 0), 20, 0.9)


@pytest.mark.parametrize("lengths", ["equal", "spread", "one long"])
def test_recall_for_any_lengths(spark, monkeypatch, lengths):
    monkeypatch.setattr(crosspolytope, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    vectors = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if lengths == "spread":
        vectors *= np.exp(rng.normal(size=(3000, 1)))
    elif lengths == "one long":
        vectors[7] *= 1000
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    check(found(search(frame(spark, rows), every=20)), plain_scores(rows, lambda i: i % 20 == 0), 10, 0.9)


def awkward_vectors():
    rng = random.Random(12)
    some = lambda n=6: [float(np.float32(rng.uniform(-1, 1))) for _ in range(n)]
    rows = [(i, some()) for i in range(120)]
    same = some()
    rows += [(i, same) for i in range(200, 320)]  # far more copies than neighbours asked for
    rows += [(400, None), (405, []), (410, [0.0] * 6), (415, [None, *some(5)]), (420, [float("nan"), *some(5)]), (425, [float("inf"), *some(5)]), (None, some())]
    rows += [(430, some(3)), (435, some(1)), (440, [-x for x in same]), rows[0], rows[0], rows[130], (10, some()), (11, some())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_per_bucket", [1, 256])
def test_awkward_vectors(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(crosspolytope, "BUCKET_ROWS", rows_per_bucket)
    rows = awkward_vectors()
    check(found(search(frame(spark, rows))), plain_scores(rows, lambda i: i % 5 == 0), 10, 0.9 if rows_per_bucket == 1 else 1.0)


def test_hot_buckets_are_split(spark, monkeypatch):
    """Many vectors that differ by little fall into one bucket of every table; no deal holds much more than its share."""
    monkeypatch.setattr(crosspolytope, "GROUP_ROWS", 50)
    monkeypatch.setattr(crosspolytope, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(5)
    near = rng.normal(size=16) + 1e-3 * rng.normal(size=(600, 16))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.concatenate((near, rng.normal(size=(300, 16)))))]
    sizes = []
    kept = crosspolytope._search

    def spy(dealt, *rest):
        sizes.extend(r["count"] for r in dealt.filter("kind = 0").groupBy("deal").count().collect())
        return kept(dealt, *rest)

    monkeypatch.setattr(crosspolytope, "_search", spy)
    check(found(search(frame(spark, rows))), plain_scores(rows, lambda i: i % 5 == 0), 10, 0.9)
    assert max(sizes) < 4 * 50 and len(sizes) > 40


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0]), (1, [2.0]), (2, [-1.0])], [(0, None), (5, [0.0])]])
def test_tables_with_few_vectors(spark, rows):
    check(found(search(frame(spark, rows))), plain_scores(rows, lambda i: i % 5 == 0), 10, 1.0)


def test_probes_come_in_the_order_of_their_loss():
    """Against all buckets written out, with several hashes a table."""
    hasher = crosspolytope.Hasher(8, 3000, None, tables=2)
    assert hasher.axes[:2] == [8, 8] and hasher.buckets >= 3000
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(20, 8))
    probes = hasher.probes(vectors, 50)
    every = hasher.probes(vectors, hasher.buckets)
    assert (probes == every[:, :, :50]).all()
    assert all(sorted(p) == list(range(hasher.buckets)) for row in every for p in row)
    assert (every[:, :, 0] == hasher.codes(vectors)).all()


def test_rotations_keep_lengths_and_angles():
    hasher = crosspolytope.Hasher(12, 10, None)
    rng = np.random.default_rng(4)
    units = hasher.unit(rng.normal(size=(30, 12)), asked=True)
    hasher.axes = [hasher.width]
    turned = hasher._rotated(units, 1, 0)
    assert np.allclose(turned @ turned.T, units @ units.T)
