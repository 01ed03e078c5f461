"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all
its segmentations into pieces, which a forward pass gives; a text's score is the product over its words. The piece
probabilities are learned by expectation-maximisation: a forward-backward pass counts the pieces that each segmentation is
expected to use. Nothing else is learned and the vocabulary is never changed.

Learning reads a bounded sample: about ``FIT_TEXTS`` texts per language, picked by a hash of the id; word counts and expected piece counts are
summed in Spark, and the table of vocabulary times languages that reaches the driver does not depend on the corpus. The driver reads the vocabulary,
and every piece of it counts. Every text is scored over its whole length. Words are runs of letters (Unicode category L, with their marks), lower-cased; a
word's score is remembered within a task, up to ``CACHE_WORDS`` words. Words over ``LONG_WORD`` bytes, such as sentences in scripts without
spaces, are scored whole like all others, byte by byte with a window of the last forward values; while learning they are left out.

Defined cases: a NULL text, or one without letters, is ``und`` with the score 0; rows without a language or an id teach nothing; a NULL id is not held
out; ties go to the alphabetically first language; without any labelled text all are ``und``; repeated rows are scored alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import durable

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FIT_TEXTS = 500
ROUNDS = 3
LONG_WORD = 40  # bytes
LONG_BLOCK = 1 << 15  # bytes of a long word that are looked up at a time
SMOOTHING = 0.1
CACHE_WORDS = 400_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


class Pieces:
    """The vocabulary's pieces, all single bytes among them, looked up by code."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
        kept = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})
        codes = np.array([self._code(p) for p in kept], np.uint64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.size = len(kept)
        self.longest = max(map(len, kept))

    @staticmethod
    def _code(piece: bytes) -> int:
        code = 0
        for byte in piece:
            code = (code * int(_BASE) + byte + 1) % (1 << 64)
        return code

    def substrings(self, block: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For words of equal length (a byte matrix): piece number per word for each (start, end), ``size`` if there is none."""
        n = block.shape[1]
        out = {}
        for start in range(n):
            code = np.zeros(len(block), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                code = code * _BASE + block[:, end - 1].astype(np.uint64) + np.uint64(1)
                out[start, end] = self._numbers(code)
        return out

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), self.size - 1)
        return np.where(self.codes[at] == codes, self.order[at], self.size)

    def endings(self, raw: np.ndarray, first: int, last: int) -> np.ndarray:
        """Piece numbers ``[end - first, length - 1]`` of what ends at the places ``first + 1`` to ``last`` of one long word."""
        low = max(0, first + 1 - self.longest)
        codes, out = np.zeros(last - low, np.uint64), np.full((last - first, self.longest), self.size)
        for length in range(1, self.longest + 1):
            codes = codes[: max(0, last - low - length + 1)]
            codes = codes * _BASE + raw[low + length - 1 : low + length - 1 + len(codes)].astype(np.uint64) + np.uint64(1)
            numbers = self._numbers(codes)  # of what starts at low, low + 1, ...
            ends = np.arange(max(first + 1, low + length), last + 1)
            out[ends - first - 1, length - 1] = numbers[ends - length - low]
        return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)


def _spelled(word: str) -> bytes:
    """The word with a leading space, as the vocabulary has it."""
    return b" " + word.encode()


def _long_score(word: bytes, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """The forward pass over one word of any length; values are kept relative to the latest one, whose logarithm is added up."""
    raw, total = np.frombuffer(word, np.uint8), np.zeros(table.shape[1])
    window = np.zeros((pieces.longest, table.shape[1]))  # forward values of the places before, latest first
    window[0] = 1
    for first in range(0, len(raw), LONG_BLOCK):
        for numbers in pieces.endings(raw, first, min(len(raw), first + LONG_BLOCK)):
            value = (table[numbers] * window).sum(0)
            window[1:] = window[:-1] / value
            window[0] = 1
            total += np.log(value)
    return total


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log-probabilities, one row per word and one column per language; ``table`` has a row of zeros for "no piece" at its end."""
    spelled = [_spelled(w) for w in words]
    scores = np.zeros((len(words), table.shape[1]))
    short = np.array([i for i, w in enumerate(spelled) if len(w) <= LONG_WORD], np.int64)
    for at, block in _by_length([spelled[i] for i in short]):
        n, numbers = block.shape[1], pieces.substrings(block)
        forward = [np.ones((len(at), table.shape[1]))]
        for end in range(1, n + 1):
            forward.append(sum(forward[start] * table[numbers[start, end]] for start in range(max(0, end - pieces.longest), end)))
        scores[short[at]] = np.log(forward[n])
    for i, word in enumerate(spelled):
        if len(word) > LONG_WORD:
            scores[i] = _long_score(word, pieces, table)
    return scores


def expected_pieces(words: list[bytes], counts: np.ndarray, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, given one language's probabilities (with a 0 at the end)."""
    out = np.zeros(pieces.size + 1)
    for at, block in _by_length(words):
        n, numbers = block.shape[1], pieces.substrings(block)
        chance = {k: chances[v] for k, v in numbers.items()}
        forward, backward = [np.ones(len(at))], [np.zeros(0)] * n + [np.ones(len(at))]
        for end in range(1, n + 1):
            forward.append(sum(forward[start] * chance[start, end] for start in range(max(0, end - pieces.longest), end)))
        for start in range(n - 1, -1, -1):
            backward[start] = sum(backward[end] * chance[start, end] for end in range(start + 1, min(n, start + pieces.longest) + 1))
        weight = counts[at] / forward[n]
        for (start, end), which in numbers.items():
            np.add.at(out, which, weight * forward[start] * chance[start, end] * backward[end])
    return out[:-1]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, fit_texts: int = FIT_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their piece probabilities, from ``doc_id``, ``text`` and ``lang``."""
    taught = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    pieces = Pieces(vocabulary)
    table = np.full((pieces.size + 1, len(languages)), 1 / pieces.size)
    table[-1] = 0
    if not languages:
        return languages, table
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, fit_texts / size))).otherwise(share)
    picked = taught.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((lang, w) for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) for w in words_of(text) if len(_spelled(w)) <= LONG_WORD)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = picked.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    counted = durable(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        table = _step(counted, languages, pieces, table)
    return languages, table


def _step(counted: DataFrame, languages: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words, counts = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            for number, name in enumerate(languages):
                own = [(_spelled(w), n) for lang, w, n in zip(langs, words, counts, strict=True) if lang == name]
                if own:
                    sums = expected_pieces([p for p, _ in own], np.array([n for _, n in own], float), pieces, table[:, number])
                    some = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), number, np.int32)), pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["lang", "piece", "n"]
                    )

    sums = counted.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most languages x vocabulary
    new = np.full(table.shape, SMOOTHING)
    new[-1] = 0
    np.add.at(new, (found["piece"].to_numpy(), found["lang"].to_numpy()), found["n"].to_numpy())
    return new / new.sum(0)


def predict(docs: DataFrame, languages: list[str], table: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (the language's share of the posterior) per row."""

    pieces = Pieces(vocabulary)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                if len(known) > CACHE_WORDS:
                    known, scores = {}, scores[:0]
                numbers, first = [], [0]
                for text in batch.column("text").to_pylist():
                    numbers += [known.setdefault(w, len(known)) for w in words_of(text)]
                    first.append(len(numbers))
                if len(known) > len(scores):
                    new = list(known)[len(scores) :]
                    scores = np.concatenate((scores, word_scores(new, pieces, table)))
                first = np.array(first)
                full = np.flatnonzero(np.diff(first)) if languages else np.zeros(0, np.int64)
                names, sure = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
                if len(full):
                    sums = np.add.reduceat(scores[numbers], first[:-1][full], axis=0)
                    best = sums.argmax(1)
                    names[full] = np.array(languages, object)[best]
                    sure[full] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.round(sure, 9))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    read = docs.select("doc_id", held_out().alias("held_out"), "text")
    return read.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Learn from the part of ``docs`` that is not held out, and predict all."""
    return predict(docs, *fit(docs, vocabulary), vocabulary)
