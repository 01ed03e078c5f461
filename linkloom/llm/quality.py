"""Quality rules combined by weak supervision.

Each rule looks at one property of a text and votes good, bad, or abstains; several rules see each kind of defect. Expectation-maximisation
over the counts of all vote patterns estimates how often each rule votes good, votes bad and abstains on good and on bad texts, and the posterior
probability of "good" replaces a filter in which every rule has to pass: a lone bad vote of a rule that is often wrong decides nothing against
the others, and a text that nobody votes against can still look like the bad ones. The estimates are bounded by nothing but a prior worth
``PRIOR_TEXTS`` texts. They are made on the texts that pass the base rules, as the others go anyway. A pattern is one of ``3 ** len(RULES)``, so
the table of counts that reaches the driver has at most 6561 rows whatever the corpus.

Defined cases: a NULL or blank text has no words and fails the base rules; every row is judged on its own, so repeated rows and repeated or
NULL ids change nothing but the counts; an empty table gives an empty result; other columns pass through ``measure`` and
``judge`` unless they bear the name of a result column, in which case the result replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.rows import pack, unpack
from linkloom.llm.textscan import Scan, chunks, inside, mix, repeats, windows
from linkloom.session import durable

GOOD, BAD, ABSTAIN = 1, -1, 0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_FROM = 0.5
ROUNDS = 50
OUTCOMES = (GOOD, BAD, ABSTAIN)
PRIOR = ((0.35, 0.45, 0.2), (0.8, 0.05, 0.15))  # how often a rule casts each outcome on bad and on good texts, before any text is seen
PRIOR_SHARE = 0.8  # of good texts
PRIOR_TEXTS = 10.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed", "n_capitals", "n_letters", "n_shouts")


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOLS, _CLOSERS, _SHOUTS = _flags(b"#*$%&|<>"), _flags(b".!?:;\"')"), _flags(b"!")
_CAPITALS = _flags(bytes(range(65, 91)))
_LETTERS = _flags(bytes([*range(65, 91), *range(97, 123)]))
_STARTS_CHARACTER = np.arange(256) & 0xC0 != 0x80


def _count_texts(scan: Scan) -> dict[str, np.ndarray]:
    raw, words = scan.raw, scan.word_counts
    triples = windows(scan.codes, 3)
    fits = inside(scan.first, 3, len(scan.codes))[: len(triples)]
    keys = mix(triples + scan.text_of_word()[: len(triples)].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    again = np.zeros(len(scan.codes) + 2, bool)  # two words late, so that a window's three words are slices of it
    again[np.flatnonzero(fits) + 2] = repeats(keys[fits])[0]
    covered = again[2:] | again[1:-1] | again[:-2]
    sums = np.concatenate(([0], np.cumsum(covered)))
    starts, ends, owner = scan.lines()
    line_keys = mix(scan.range_codes(starts, ends) + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    n = len(scan.texts)
    last = scan.ends[np.searchsorted(scan.ends, ends, side="right") - 1] - 1 if len(starts) else starts
    return {
        "n_words": words,
        "word_chars": scan.count_bytes(~scan.space & _STARTS_CHARACTER[raw]),
        "n_symbols": scan.count_bytes(_SYMBOLS[raw]),
        "n_dup_lines": np.bincount(owner[repeats(line_keys)[1]], minlength=n),
        "n_repeat_words": sums[scan.first[1:]] - sums[scan.first[:-1]],
        "n_lines": np.bincount(owner, minlength=n),
        "n_closed": np.bincount(owner[_CLOSERS[raw[last]]], minlength=n),
        "n_capitals": scan.count_bytes(_CAPITALS[raw]),
        "n_letters": scan.count_bytes(_LETTERS[raw]),
        "n_shouts": scan.count_bytes(_SHOUTS[raw]),
    }


def measure(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs``, with or without its text, plus the counts that the rules look at (``COUNTS``)."""
    kept = [c for c in docs.columns if c not in COUNTS and (keep_text or c != text)]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*[f"`{c}`" for c in kept]).dtypes] + [f"{c} long" for c in COUNTS])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scan in chunks(batches, text):
            counts = _count_texts(scan)
            columns = [batch.column(c) for c in kept] + [pa.array(counts[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *COUNTS])

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])]).mapInArrow(count, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rules() -> dict[str, Column]:
    """The rules' votes; a rule abstains where neither side is clear or there is nothing to look at."""
    words, lines, letters = F.col("n_words"), F.col("n_lines"), F.col("n_letters")
    return {
        "symbols": _vote(10 * F.col("n_symbols") > words, (words > 0) & (50 * F.col("n_symbols") <= words)),
        "density": _vote(20 * F.col("n_symbols") > F.col("word_chars"), (words > 0) & (100 * F.col("n_symbols") <= F.col("word_chars"))),
        "repeats": _vote(5 * F.col("n_repeat_words") > words, (words > 0) & (20 * F.col("n_repeat_words") <= words)),
        "lines": _vote(5 * F.col("n_dup_lines") > lines, (lines > 2) & (10 * F.col("n_dup_lines") <= lines)),
        "capitals": _vote(10 * F.col("n_capitals") > 3 * letters, (letters > 0) & (10 * F.col("n_capitals") <= letters)),
        "shouts": _vote(10 * F.col("n_shouts") > 3 * words, (words > 0) & (20 * F.col("n_shouts") <= words)),
        "word_length": _vote(
            (10 * F.col("word_chars") < 44 * words) | (10 * F.col("word_chars") > 60 * words),
            (words > 0) & (10 * F.col("word_chars")).between(46 * words, 56 * words),
        ),
        "closed_lines": _vote((lines > 0) & (10 * F.col("n_closed") < 9 * lines), (lines > 0) & (100 * F.col("n_closed") >= 98 * lines)),
    }


RULES = ("symbols", "density", "repeats", "lines", "capitals", "shouts", "word_length", "closed_lines")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns.

    Returns the share of good texts and a table ``[class, rule, outcome]``: how likely a rule casts each of ``OUTCOMES`` on a text of
    that class (0 bad, 1 good). The first step uses the prior, which says only that rules are right more often than not.
    """
    cast = np.stack([patterns == o for o in OUTCOMES], 2).astype(float)
    prior = PRIOR_TEXTS * np.array(PRIOR)[:, None, :]
    share, table = PRIOR_SHARE, np.tile(prior / PRIOR_TEXTS, (1, patterns.shape[1], 1))
    for _ in range(rounds):
        good = posterior(patterns, share, table)
        weights = np.stack([(1 - good) * counts, good * counts])
        share = (weights[1].sum() + PRIOR_SHARE * PRIOR_TEXTS) / (counts.sum() + PRIOR_TEXTS)
        table = (np.einsum("cp,pro->cro", weights, cast) + prior) / (weights.sum(1)[:, None, None] + PRIOR_TEXTS)
    return float(share), table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of "good" for each pattern of votes."""
    cast = np.stack([patterns == o for o in OUTCOMES], 2).astype(float)
    logs = np.log([1 - share, share])[:, None] + np.einsum("pro,cro->cp", cast, np.log(table))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def judge(measured: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``quality`` (posterior of "good") and ``kept`` to measured texts."""
    votes = rules()
    code = sum((votes[r] + 1) * F.lit(3**i) for i, r in enumerate(RULES)).cast("int")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    coded = measured.drop("_votes", "base_failed").withColumns({"_votes": code, "base_failed": failed})
    counted = coded.groupBy("_votes").agg(F.count_if(~F.col("base_failed")).alias("count")).collect()  # at most 3 ** len(RULES) rows
    spark = measured.sparkSession
    codes = np.array(sorted(r["_votes"] for r in counted), np.int64)
    counts = np.array([r["count"] for r in sorted(counted, key=lambda r: r["_votes"])], float)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(RULES))], 1) if len(codes) else np.zeros((0, len(RULES)), np.int64)
    good = posterior(patterns, *fit(patterns, counts))
    rows = [(int(c), round(float(p), 9)) for c, p in zip(codes, good, strict=True)]
    judged = coded.drop("quality").join(F.broadcast(spark.createDataFrame(rows, "_votes int, quality double")), "_votes", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).drop("_votes")


def label(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measure and judge every document; the counts are kept in the shared folder between the two passes."""
    return judge(durable(measure(docs, text)))


def good_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. The texts are scanned twice, for the counts and for the verdicts, and never shuffled."""
    return unpack(judge(measure(pack(docs, doc_id, text), keep_text=True)).filter("kept"), docs, text)
