"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The blended-spectrum presence kernel of two texts counts the n-grams of one to three characters
that both have, over the geometric mean of how many each has; n-grams are those that occur in some
landmark, of whatever characters: a table finds their places while the landmarks' characters are few,
and a sorted list of the n-grams' codes beyond that. Texts
are compared with the landmarks only (Nyström), and one ridge regression for each language against
the rest scores them: a batch of texts is one product of matrices after the other.

Landmarks and training texts are a bounded sample: of each of the ``LANGUAGES`` languages with the most
rows the ``TRAIN`` rows with the smallest hashes, of which the first ``LANDMARKS`` are landmarks. A text
of the sample teaches by its first ``SAMPLE`` characters, so what reaches the driver is bounded in bytes.
Prediction covers every row and the whole of every text.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text
if there is nothing to learn from. Null languages and texts teach nothing. Rows that repeat are
predicted alike; a tie goes to the language that sorts first. Very long texts are looked at whole. An
empty table gives an empty table. Other columns stay; those named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import with_column

LANDMARKS = 32
TRAIN = 250
#: Languages that are learned, and characters that a text of the sample teaches by.
LANGUAGES = 256
SAMPLE = 100_000
#: Characters of the landmarks up to which n-grams have a table of their own.
TABLE = 200
RIDGE = 1e-2
#: Steepness with which the regressions' values become a score.
SHARP = 4.0
#: Texts whose presences are held at once.
BATCH = 256

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Spectrum:
    """Which of the landmarks' n-grams a text has."""

    def __init__(self, landmarks: Sequence[str]) -> None:
        letters = sorted({c for text in landmarks for c in self._clean(text)})
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        self.grams = [np.unique(np.concatenate([g[n] for g in map(self._grams, landmarks)])) for n in range(3)]
        self.first = np.cumsum([0, *map(len, self.grams)])
        self.size = int(self.first[-1])
        self.place = []
        if self.base <= TABLE:
            for n, found in enumerate(self.grams):
                place = np.full(self.base ** (n + 1), -1, np.int32)
                place[found] = self.first[n] + np.arange(len(found))
                self.place.append(place)

    @staticmethod
    def _clean(text: str) -> str:
        return " ".join(("", *text.lower().split(), ""))

    def _grams(self, text: str) -> tuple[np.ndarray, ...]:
        """Codes of n-grams; a character that no landmark has is 0, and no landmark's n-gram holds it."""
        points = np.frombuffer(self._clean(text).encode("utf-32-le", "replace"), np.uint32)
        one = self.code[points]
        two = one[:-1] * self.base + one[1:]
        return one, two, two[:-1] * self.base + one[2:]

    def _places(self, n: int, grams: np.ndarray) -> np.ndarray:
        if self.place:
            return self.place[n][grams]
        known = self.grams[n]
        grams = np.unique(grams)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.where(known[at] == grams, self.first[n] + at, -1)

    def presence(self, texts: Sequence[str]) -> np.ndarray:
        """Unit rows; n-grams that no landmark has fall into a last column that is cut off."""
        out = np.zeros((len(texts), self.size + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            for n, grams in enumerate(self._grams(text)):
                row[self._places(n, grams)] = 1
        out = out[:, :-1]
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


class Model(NamedTuple):
    spectrum: Spectrum
    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]


def fit(texts: Sequence[str], languages: Sequence[str], landmarks: int = LANDMARKS) -> Model | None:
    """Rows in order; the first ``landmarks`` of each language are landmarks."""
    if not texts:
        return None
    names = sorted(set(languages))
    seen: Counter[str] = Counter()
    chosen = []
    for text, lang in zip(texts, languages, strict=True):
        seen[lang] += 1
        if seen[lang] <= landmarks:
            chosen.append(text)
    spectrum = Spectrum(chosen)
    marks = spectrum.presence(chosen)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    to_features = vector[:, good] / np.sqrt(value[good])
    x = np.concatenate([spectrum.presence(texts[i:i + BATCH]) @ marks.T
                        for i in range(0, len(texts), BATCH)]).astype(np.float64) @ to_features
    y = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    # each language weighs the same, however many rows it has
    weight = 1 / np.sqrt(np.array([seen[lang] for lang in languages]))[:, None]
    a = np.c_[x, np.ones(len(x))] * weight
    solved = np.linalg.solve(a.T @ a + RIDGE * np.eye(a.shape[1]), a.T @ (y * weight))
    return Model(spectrum, marks, np.r_[to_features @ solved[:-1], solved[-1:]].astype(np.float32), names)


def predict_texts(model: Model, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores, a batch of matrix products at a time."""
    languages, sure = [], []
    for at in range(0, len(texts), BATCH):
        part = texts[at:at + BATCH]
        kernel = model.spectrum.presence([t or "" for t in part]) @ model.landmarks.T
        value = SHARP * (kernel @ model.weights[:-1] + model.weights[-1]).astype(np.float64)
        best = value.argmax(1)
        share = np.exp(value - value.max(1, keepdims=True))
        share = share.max(1) / share.sum(1)
        known = [t is not None and LETTER.search(t) is not None for t in part]
        languages += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        sure.append(np.where(known, share, 0.0))
    return languages, np.concatenate(sure) if sure else np.zeros(0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train: int = TRAIN) -> Model | None:
    """Fit on the given rows; the caller leaves out those held back. Rows are chosen by hash before
    any text moves, and only the chosen texts reach the driver."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(
        key.alias("_key"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    most = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES)
    rows = rows.join(F.broadcast(most.select("_lang")), "_lang").withColumn("_text", F.left("_text", F.lit(SAMPLE)))
    place = Window.partitionBy("_lang").orderBy("_key")
    chosen = rows.select("_lang", "_key").withColumn("_n", F.row_number().over(place)).where(
        F.col("_n") <= train).select("_lang", "_key").distinct()
    found = rows.join(F.broadcast(chosen), ["_lang", "_key"]).groupBy("_lang", "_key").agg(
        F.min("_text").alias("_text")).orderBy("_key", "_lang").collect()
    return fit([r["_text"] for r in found], [r["_lang"] for r in found])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lang`` and ``_sure``."""
    if model is None:
        return docs.withColumns({"_lang": F.lit(UNKNOWN), "_sure": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_column(docs, lambda texts: list(predict_texts(shared.value, texts)),
                       {"_lang": "string", "_sure": "double"}, text_col, BATCH)
