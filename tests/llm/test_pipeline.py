"""The pipeline against the operators' brute-force versions, stage by stage."""

from cases import cut_repeats, folded, near_classes, ordered, rows_of, spaced
from test_text_rules import expected_hits

import corpus_pipeline as cp
from linkloom.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(df, path, spark):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_each_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [s for _, s in cp.STAGES]

    good = write(stages[0](spark, docs, sf_dir), tmp_path / "0", spark)
    assert good.columns == COLUMNS
    assert rows_of(good, *COLUMNS) == rows_of(docs.join(quality.label(docs).filter("kept").select("doc_id"), "doc_id"), *COLUMNS)

    single = write(stages[1](spark, good, sf_dir), tmp_path / "1", spark)
    rows = rows_of(good, *COLUMNS)
    classes, _ = near_classes([r[:2] for r in rows])
    assert rows_of(single, *COLUMNS) == [rows[i] for i in sorted({min(c) for c in classes})]

    cut = write(stages[2](spark, single, sf_dir), tmp_path / "2", spark)
    rows = rows_of(single, *COLUMNS)
    left = [(*r[:1], kept if gone else r[1], *r[2:4]) for r, (n, gone, kept) in zip(rows, cut_repeats([r[:2] for r in rows]), strict=True) if not gone or gone < n]
    assert rows_of(cut, *COLUMNS) == ordered([(*r, len(r[1])) for r in left])

    clean = write(stages[3](spark, cut, sf_dir), tmp_path / "3", spark)
    items = rows_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    hit = {r[0] for r in expected_hits(rows_of(cut, "doc_id", "text"), items) if r[-1]}
    assert rows_of(clean, *COLUMNS) == [r for r in rows_of(cut, *COLUMNS) if r[0] not in hit]

    mixed = stages[4](spark, clean, sf_dir)
    kept = set(rows_of(clean, *COLUMNS))
    sampled = rows_of(mixed, *COLUMNS)
    assert 0 < len(sampled) < len(kept) and set(sampled) <= kept
    assert all(n == len(spaced(t)) for t, n in rows_of(mixed, "text", "n_tokens"))


def test_stages_on_an_empty_table(spark, sf_dir, no_docs, tmp_path):
    docs = no_docs
    for number, (_, stage) in enumerate(cp.STAGES):
        docs = write(stage(spark, docs, sf_dir), tmp_path / str(number), spark)
        assert docs.count() == 0 and docs.columns[:5] == COLUMNS


def test_stages_on_awkward_documents(spark, docs, awkward, sf_dir, tmp_path):
    """The filters leave rows as they are; NULLs and repeated rows break nothing."""
    now, given = docs, {r[0] for r in awkward}
    for number, (_, stage) in enumerate(cp.STAGES):
        now = write(stage(spark, now, sf_dir), tmp_path / str(number), spark)
        assert {r["doc_id"] for r in now.collect()} <= given
    assert all(folded(t) for (t,) in rows_of(now, "text"))
