"""Toxicity by compression distance: the same windows under a toxic and an ordinary dictionary.

Two zstandard dictionaries share what is common in ordinary text; behind it, one has a dictionary
trained on what toxic texts say again and again and ordinary ones never, the other has the like of
other ordinary texts. A window of a few words that the toxic dictionary compresses better speaks
for toxicity; how many windows do so by how many bytes is summed up for the whole text, and a
logistic model turns it into a score. Dictionaries and thresholds are fitted on a bounded sample of
labelled rows (``PER_CLASS`` of each label, those with the smallest hashes); the share of toxic rows
is that of all labelled rows, counted, so what 0.5 means does not hang on the sample's size. All else
covers every row and the whole of every text.

Defined results: a null or empty text is scored too, as a text with one empty window. Rows that
repeat score alike. Labels that contradict each other for one id count as they stand; null labels
and null texts teach nothing. Without labels of both kinds every score is 0. Ties among sampled rows go by
id. Very long texts are scored whole, window by window. An empty table gives an empty table. Other columns
stay; one named like the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_column

#: Labelled rows of each kind that are looked at: toxic, ordinary.
PER_CLASS = (1000, 2000)
#: Words of a window.
WINDOW = 16
#: Bytes of the shared dictionary, and of the part that sets the two apart.
SHARED, APART = 32768, 1024
#: Texts in which a word must occur to be said again and again.
OFTEN = 3
#: Gains, in bytes, that are counted.
STEPS = np.arange(-3, 8)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def windows(words: Sequence[bytes], size: int = WINDOW) -> list[bytes]:
    """Runs of ``size`` words that cover the text; one empty run for a text without words."""
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(0, max(1, len(words)), size)]


def _settings() -> zstandard.ZstdCompressionParameters:
    # matches of three bytes count, as the words that matter are short
    return zstandard.ZstdCompressionParameters.from_level(
        3, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0,
        write_checksum=0, write_dict_id=0)


class Model(NamedTuple):
    """Dictionaries by pairs (toxic, ordinary), and the logistic model over the gains."""

    pairs: tuple[tuple[bytes, bytes], ...]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


class Gains:
    """How many bytes the toxic dictionaries save on each window of a text."""

    def __init__(self, pairs: Sequence[tuple[bytes, bytes]]) -> None:
        self.pairs = [tuple(map(self._compressor, pair)) for pair in pairs]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = _settings()
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=known)

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        total = 0
        for toxic, ordinary in self.pairs:
            total = total + np.array([len(ordinary.compress(w)) - len(toxic.compress(w))
                                      for w in windows(words)], np.float64)
        return total / len(self.pairs)


def features(gains: np.ndarray) -> list[float]:
    """Shares of windows by gain, means of the best windows, and how much there was to see."""
    best, n = np.sort(gains)[::-1], len(gains)
    return [*((best >= s).mean() for s in STEPS), best.mean(), best[0],
            *(best[:max(1, n // k)].mean() for k in (2, 5, 10)), 1 / np.sqrt(n), np.log(n)]


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        # too little to choose from: what there is serves as it is
        return b"".join(samples)[-size:]


def _apart(texts: Sequence[set[bytes]], known: set[bytes]) -> bytes:
    often = Counter(w for words in texts for w in words - known)
    keep = {w for w, n in often.items() if n >= OFTEN} or set(often)
    samples = [b" " + b" ".join(sorted(words & keep)) + b" " for words in texts]
    return _train([s for s in samples if len(s) > 8], APART, 8)


def fit(toxic: Sequence[str], ordinary: Sequence[str], rows: tuple[int, int] | None = None) -> Model | None:
    """Dictionaries from two thirds of each kind, the logistic model from the last third. ``rows`` are
    the toxic and ordinary rows that the texts were chosen from, without it the texts themselves."""
    if not toxic or not ordinary:
        return None
    sides = [[words_of(t) for t in side] for side in (toxic, ordinary)]
    for_model = [side[2::3] or side for side in sides]
    halves = [([w for i, w in enumerate(side) if i % 3 != 2] or side) for side in sides]
    bad, good = ([set(words) for words in side] for side in halves)
    everyone = set().union(*good)
    pairs = []
    for turn in (0, 1):
        base, other = halves[1][turn::2], good[1 - turn::2]
        known = set().union(*map(set, base))
        shared = _train([w for words in base for w in windows(words)], SHARED, 16)
        pairs.append((shared + _apart(bad[turn::2] or bad, everyone), shared + _apart(other, known)))
    gains = Gains(pairs)
    x = np.array([features(gains.of(words)) for side in for_model for words in side])
    y = np.repeat([1.0, 0.0], [len(side) for side in for_model])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    a = np.c_[np.ones(len(x)), (x - mean) / spread]
    weights = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -30, 30)))
        curve = a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, a.T @ (y - p) - weights)
    # the last thirds have the sample's share of toxic rows; the odds are put right to that of all rows
    bad_rows, good_rows = rows or (len(toxic), len(ordinary))
    weights[0] += np.log(bad_rows / good_rows) - np.log(len(for_model[0]) / len(for_model[1]))
    return Model(tuple(pairs), mean, spread, weights)


_GAINS: dict[tuple[tuple[bytes, bytes], ...], Gains] = {}


def _gains(pairs: tuple[tuple[bytes, bytes], ...]) -> Gains:
    """This worker's compressors; those of the last model are kept."""
    if pairs not in _GAINS:
        _GAINS.clear()
        _GAINS[pairs] = Gains(pairs)
    return _GAINS[pairs]


def score_texts(model: Model, texts: Sequence[str | None]) -> np.ndarray:
    gains = _gains(model.pairs)
    x = (np.array([features(gains.of(words_of(t))) for t in texts]) - model.mean) / model.spread
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model | None:
    """Fit on labelled rows; the caller leaves out those held back. Rows are counted and the smallest
    hashes chosen before any text moves, and only the chosen texts reach the driver."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        "_id IS NOT NULL AND _y IN (0, 1)").distinct()
    known = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().join(marked, "_id")
    count = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    # a limit behind an order keeps the first rows of each task, and only those travel
    toxic, ordinary = (known.where(F.col("_y") == kind).orderBy(F.xxhash64("_id"), "_id").limit(n)
                       for kind, n in zip((1, 0), per_class, strict=True))
    chosen = toxic.unionByName(ordinary)
    # one text for each id
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(
        "_text IS NOT NULL").join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(
        F.min("_text").alias("_text"))
    rows = texts.orderBy(F.xxhash64("_id"), "_id").collect()
    return fit([r["_text"] for r in rows if r["_y"] == 1], [r["_text"] for r in rows if r["_y"] == 0],
               (count.get(1, 0), count.get(0, 0)))


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_toxic``, from 0 to 1."""
    if model is None:
        return docs.withColumn("_toxic", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list[np.ndarray]:
        return [score_texts(shared.value, texts)]

    return with_column(docs, make, {"_toxic": "double"}, text_col, done=_GAINS.clear)
