"""Language identification with a blended-spectrum string kernel.

Two texts are as alike as the share of byte n-grams (n = 1 to 4, presence only) that they have in common:
k(x, y) = |P(x) & P(y)| / sqrt(|P(x)| |P(y)|). P holds the n-grams of the landmarks; others cannot match.
Nystroem landmarks turn the kernel into features, one ridge regression per language against the rest is
fitted on them, and the product of landmarks, features and weights is kept as one matrix (n-grams x
languages), so that scoring is a presence matrix times that matrix, block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.texts import slices, wide_hash

#: Bounds of the labelled sample: documents of one language, languages, characters of one document.
TRAIN_DOCS, MAX_LANGUAGES, TRAIN_CHARS = 240, 64, 2000
#: Landmarks of one language, and of all.
LANDMARKS, MAX_LANDMARKS = 40, 512
#: Bytes of a text that are scored as one row; a text's score is the mean over its rows.
ROW_BYTES = 1024
BLOCK_ROWS = 256
RIDGE = 1.0
#: Steepness of the scores' softmax.
SHARPNESS = 4.0
UNDETERMINED = "und"
#: Lengths in bytes from which a text's measures are held to those of unseen learned texts of that length; it is in
#: no learned language if both its best value and its known share are lower than all but this share have them.
LENGTHS, ODD_SHARE = (0, 20, 60, 200, 1000), 0.02
ORDERS = (1, 2, 3, 4)
_SLOTS = 18
_LETTER = re.compile(r"[^\W\d_]")

#: Bytes as features see them: white space, digits and ASCII punctuation are all one space.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts with three spaces after each, the row of each byte (-1: none), each row's text."""
    parts, row_of, text_of, rows = [], [], [], 0
    for i, t in enumerate(texts):
        b = t.lower().encode("utf-8", "replace")
        n = max(1, -(-len(b) // ROW_BYTES))
        parts += [b, b"   "]
        row_of.append(np.minimum(np.arange(len(b)) // ROW_BYTES, n - 1) + rows)
        row_of.append(np.full(3, -1))
        text_of.append(np.full(n, i))
        rows += n
    data = _FOLD[np.frombuffer(b"".join(parts), np.uint8)] if parts else np.zeros(0, np.uint8)
    return data, np.concatenate(row_of) if row_of else np.zeros(0, np.int64), np.concatenate(text_of) if text_of else np.zeros(0, np.int64)


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that starts at each byte; what runs over the end is filled with spaces."""
    wide = np.concatenate((data, np.full(n - 1, 32, np.uint8))).astype(np.uint32)
    code = wide[: len(data)].copy()
    for k in range(1, n):
        code = (code << np.uint32(8)) | wide[k : k + len(data)]
    return code


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    #: For each n: the feature at each slot (or -1), and each feature's n-gram with the slots' order.
    slots: list[np.ndarray] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    features: int = 0
    weights: np.ndarray | None = None
    #: For each of LENGTHS the best value and the known share that few texts in a learned language are below.
    least: np.ndarray | None = None

    def marks(self, data: np.ndarray, row_of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each n: the row and the feature of each n-gram that is one, in order."""
        marks = []
        for n, slots, grams in zip(ORDERS, self.slots, self.grams):
            code = _codes(data, n)
            found = slots[_slot(code)]
            at = np.flatnonzero((found >= 0) & (row_of >= 0))
            found = found[at]
            same = grams[found] == code[at]
            marks.append((row_of[at[same]], found[same]))
        return marks

    def presence(self, marks: list[tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of the presence matrix: the first row and the rows."""
        for first in range(0, rows, BLOCK_ROWS):
            block = np.zeros((min(BLOCK_ROWS, rows - first), self.features), np.float32)
            for row, found in marks:
                a, b = np.searchsorted(row, (first, first + BLOCK_ROWS))
                block[row[a:b] - first, found[a:b]] = 1
            yield first, block

    def _measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the mean value of each language, the share of its 3- and 4-grams that are features, its length.

        That is in bytes, but no more than the different features of one row: a word repeated is a short text.
        """
        data, row_of, text_of = _rows(texts)
        marks = self.marks(data, row_of)
        total, weight, most = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts))
        for first, block in self.presence(marks, len(text_of)):
            found = block.sum(1)
            value = block @ self.weights / np.sqrt(np.maximum(found, 1))[:, None]
            which = text_of[first : first + len(block)]
            np.add.at(total, which, value * found[:, None])
            np.add.at(weight, which, found)
            np.maximum.at(most, which, found)
        size = np.bincount(text_of[row_of[row_of >= 0]], minlength=len(texts))
        long = [row for n, (row, _) in zip(ORDERS, marks) if n >= 3]
        known = sum(np.bincount(text_of[row], minlength=len(texts)) for row in long) / np.maximum(size * len(long), 1)
        return total / np.maximum(weight, 1)[:, None], known, np.minimum(size, most)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text that has a letter, else undetermined; and whether it is in a learned language."""
        letters = np.array([bool(_LETTER.search(t)) for t in texts], bool)
        names, scores, learned = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if self.weights is None or not letters.any():
            return names, scores, learned
        asked = np.flatnonzero(letters)
        mean, known, size = self._measure([texts[i] for i in asked])
        power = np.exp(SHARPNESS * (mean - mean.max(1, keepdims=True)))
        share = power / power.sum(1, keepdims=True)
        best = share.argmax(1)
        for i, b, s in zip(asked, best, share.max(1)):
            names[i], scores[i] = self.languages[b], s
        learned[asked] = known > 0
        if self.least is not None:
            least = self.least[np.searchsorted(LENGTHS, size, side="right") - 1]
            learned[asked] &= (mean.max(1) >= least[:, 0]) | (known >= least[:, 1])
        return names, scores, learned

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text that has a letter; else undetermined."""
        return self.judge(texts)[:2]


def train(samples: dict[str, list[str]]) -> LanguageModel:
    """Fit on texts by language, with the lowest usual measures of texts that a model of the other half has not seen.

    The best value and the known share are absolute: other than the score they do not grow as languages get fewer.
    Too few texts to find such a share of them calibrate nothing; then only a text with nothing known is in no language.
    """
    model = _train(samples)
    if sum(len(set(v)) for v in samples.values()) < 1 / ODD_SHARE:
        return model
    halves = [{k: [t for i, t in enumerate(v) if i % 2 == part] for k, v in samples.items()} for part in (0, 1)]
    found: list[np.ndarray] = []
    for learn, ask in (halves, halves[::-1]):
        half = _train(learn)
        if half.weights is None:
            return model
        for take in (8, *LENGTHS[1:], 2 * LENGTHS[-1]):
            cuts = [t.encode("utf-8", "replace")[: take * 3 // 2].decode("utf-8", "ignore") for v in ask.values() for t in v]
            if cuts := [t for t in cuts if _LETTER.search(t)]:
                mean, known, size = half._measure(cuts)
                found.append(np.stack((size, mean.max(1), known), 1))
    seen = np.concatenate(found) if found else np.zeros((0, 3))
    bins = np.searchsorted(LENGTHS, seen[:, 0], side="right") - 1
    least = [np.quantile(seen[bins == at, 1:], ODD_SHARE, axis=0) if (bins == at).any() else np.full(2, np.inf) for at in range(len(LENGTHS))]
    for at in range(1, len(least)):  # lengths that no text has are held to what shorter ones are
        least[at] = np.where(np.isinf(least[at]), least[at - 1], least[at])
    # a shorter text is never held to more than a longer one
    model.least = np.minimum.accumulate(np.array(least)[::-1], axis=0)[::-1] if np.isfinite(least[-1]).all() else None
    return model


def _train(samples: dict[str, list[str]]) -> LanguageModel:
    """Fit on texts by language; a sample is also used cut short, as short texts will come."""
    model = LanguageModel(sorted(samples))
    texts, labels = [], []
    for label, name in enumerate(model.languages):
        for t in samples[name]:
            cuts = {t[:ROW_BYTES], t[:200], t[-60:]}
            cuts = sorted(c for c in cuts if _LETTER.search(c))
            texts += cuts
            labels += [label] * len(cuts)
    if not texts:
        return LanguageModel()
    labels = np.array(labels)
    per = max(1, min(LANDMARKS, MAX_LANDMARKS // len(model.languages)))
    marks = [i for label in range(len(model.languages)) for i in sorted(np.flatnonzero(labels == label), key=lambda i: -len(texts[i]))[:per]]
    data, row_of, _ = _rows([texts[i][:ROW_BYTES] for i in marks])
    start = 0
    for n in ORDERS:
        grams = np.unique(_codes(data, n)[row_of >= 0])
        slots = np.full(1 << _SLOTS, -1, np.int32)
        where = _slot(grams)
        _, first = np.unique(where, return_index=True)  # of n-grams that meet in a slot one is a feature
        grams, where = grams[first], where[first]
        slots[where] = start + np.arange(len(grams))
        model.slots.append(slots)
        model.grams.append(np.concatenate((np.zeros(start, np.uint32), grams)))
        start += len(grams)
    model.features = start

    def normal(items: list[str]) -> np.ndarray:
        data, row_of, text_of = _rows(items)
        made = np.zeros((len(items), model.features), np.float32)
        for first, block in model.presence(model.marks(data, row_of), len(text_of)):
            np.maximum.at(made, text_of[first : first + len(block)], block)
        return made / np.sqrt(np.maximum(made.sum(1, keepdims=True), 1))

    land = normal([texts[i][:ROW_BYTES] for i in marks])
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    feats = np.concatenate([normal(texts[i : i + BLOCK_ROWS]) @ land.T for i in range(0, len(texts), BLOCK_ROWS)]).astype(np.float64) @ root
    target = np.where(labels[:, None] == np.arange(len(model.languages)), 1.0, -1.0)
    share = np.bincount(labels, minlength=len(model.languages)) / len(labels)
    balance = 1 / (share[labels] * len(model.languages))
    ridge = feats.T @ (feats * balance[:, None]) + RIDGE * np.eye(feats.shape[1])
    solved = np.linalg.solve(ridge, feats.T @ (target * balance[:, None]))
    model.weights = (land.T.astype(np.float64) @ (root @ solved)).astype(np.float32)
    return model


def fit(docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of the labelled rows for which ``learn`` holds.

    At most TRAIN_DOCS texts, TRAIN_CHARS characters of each, of each of the MAX_LANGUAGES most frequent
    languages, picked by a hash of the text. Rows with a null text or language teach nothing.
    """
    rows = docs.filter(learn).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not common:
        return LanguageModel()
    part = F.create_map(*[F.lit(x) for r in common for x in (r.lang, int(min(1.0, 4 * TRAIN_DOCS / r.n) * 1_000_000))])
    picked = rows.withColumn("pick", wide_hash(5, F.col("text"))).filter(F.pmod("pick", F.lit(1_000_000)) < part[F.col("lang")])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    bounded = picked.select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text"), "pick").withColumn("at", order).filter(F.col("at") <= TRAIN_DOCS)
    samples: dict[str, list[str]] = {}
    for r in bounded.orderBy("lang", "at").collect():
        samples.setdefault(r.lang, []).append(r.text)
    return train(samples)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, over the whole text.

    A null text or one without a letter is undetermined with score 0; so is all if nothing was learnt. Input
    columns of these two names are replaced; other columns stay.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            names, scores = model.score([t or "" for t in batch.column(text).to_pylist()])
            columns = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose text is in a learned language, unchanged: determined, and with a measure as learned texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            yield batch.filter(pa.array(model.judge([t or "" for t in batch.column(text).to_pylist()])[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
