"""Toxicity by compression distance to two Zstandard dictionaries.

One raw-content dictionary holds the commonest words of ordinary text; the other holds the same and, nearest
to its end, the words that toxic text uses significantly more often. A window is one word between marks. It
counts as toxic if the toxic dictionary explains it all (its compressed length is that of a single match) and
saves at least a threshold of bytes against the ordinary dictionary. The threshold and the probability of the
label, given the toxic windows of a text, are calibrated on labelled rows that no dictionary has seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.texts import cut, slices, wide_hash

DICTIONARY_BYTES = 16_384
#: A toxic word is in so many toxic documents and in so many times as many as by chance; besides, its G statistic
#: must be over 2 ln(words tried), which chance reaches for about one word.
LEAST_DOCS, LEAST_RATIO = 3, 3.0
#: Thresholds of saved bytes that calibration chooses from.
GAINS = range(3, 13)
MEMO_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]{1,40}")
_OPEN, _CLOSE = b"\x01\x02\x03\x04", b"\x05\x06\x07\x08"
#: Stands before every window and at the end of both dictionaries, so that a block is never stored uncompressed.
_FRAME = b"<<== one window of text ==>>"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Compressors:
    """Compressed lengths of windows with either dictionary; not sent to tasks."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            16, window_log=16, hash_log=15, chain_log=15, min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        self.memo: dict[str, tuple[int, int]] = {}
        self._run = []
        for content in (ordinary, toxic):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=params)
            self._run.append(zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress)

    def lengths(self, word: str) -> tuple[int, int]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            window = _FRAME + _OPEN + word.encode("utf-8", "replace") + _CLOSE
            found = self.memo[word] = (len(self._run[0](window)), len(self._run[1](window)))
        return found


_READY: dict[tuple[bytes, bytes], _Compressors] = {}


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    explained: int = 0
    gain: int = 0
    #: Weights of the intercept and the three measures.
    weights: list[float] = field(default_factory=list)
    #: The share of toxic labels, which is the score if nothing could be learnt.
    prior: float = 0.0

    def _compressors(self) -> _Compressors:
        key = (self.ordinary, self.toxic)
        if key not in _READY:
            _READY[key] = _Compressors(*key)
        return _READY[key]

    def windows(self, text: str) -> list[tuple[str, int]]:
        """The toxic windows of a text and the bytes saved on each."""
        lengths, out = self._compressors().lengths, []
        for word in _words(text):
            plain, toxic = lengths(word)
            if plain - toxic >= self.gain and toxic <= self.explained:
                out.append((word, plain - toxic))
        return out

    def measures(self, text: str) -> tuple[float, float, float, float]:
        found = self.windows(text)
        return _measures(len(found), max((g for _, g in found), default=0))

    def outline(self, text: str) -> list[int]:
        """How many windows save so many bytes, for each of ``GAINS``, and the most that one saves (0 if below them)."""
        lengths, saved = self._compressors().lengths, []
        for word in _words(text):
            plain, toxic = lengths(word)
            if plain - toxic >= GAINS[0] and toxic <= self.explained:
                saved.append(plain - toxic)
        return [*(sum(g >= least for g in saved) for least in GAINS), max(saved, default=0)]

    def score(self, text: str) -> float:
        if not self.weights:
            return self.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * m for w, m in zip(self.weights, self.measures(text)))))))


def _measures(windows: int, most: int) -> tuple[float, float, float, float]:
    return (1.0, math.log1p(windows), float(windows > 0), most / 10)


def _logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights for the measures ``x`` of labels ``y``, each standing for so many rows."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (rows * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (rows * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _content(words: Iterable[str]) -> bytes:
    """The windows of the first ``words`` that a dictionary has room for, the first nearest to the end."""
    out, size = [], 0
    for word in words:
        entry = _OPEN + word.encode() + _CLOSE
        size += len(entry)
        if size > DICTIONARY_BYTES:
            break
        out.append(entry)
    return b"".join(reversed(out))


def _built(common: Iterable[str], strong: Iterable[str], prior: float) -> ToxicityModel:
    """Dictionaries of the commonest ordinary and the strongest toxic words, both from the first on."""
    ordinary = _content(common)
    return ToxicityModel(ordinary + _FRAME, ordinary + _content(strong) + _FRAME, prior=prior)


def _best_gain(rows: Counter[tuple[int, int]]) -> int:
    """The threshold of the best F1, given how many rows have a label and a largest saving."""
    toxic = sum(n for (label, _), n in rows.items() if label)
    best = (-1.0, 0)
    for gain in GAINS:
        hits = [(label, n) for (label, most), n in rows.items() if most >= gain]
        best = max(best, (2 * sum(n for label, n in hits if label) / max(1, sum(n for _, n in hits) + toxic), gain))
    return best[1]


def _weights(rows: Counter[tuple[int, int, int]], gain: int) -> list[float]:
    """Weights of the measures, given how many rows have a label, a number of windows at ``gain`` and a largest saving."""
    keys = sorted(rows)
    x = np.array([_measures(windows, most if most >= gain else 0) for _, windows, most in keys])
    return _logistic(x, np.array([float(label) for label, _, _ in keys]), np.array([float(rows[k]) for k in keys])).tolist()


def train(seen: list[tuple[str, int]], unseen: list[tuple[str, int]], prior: float) -> ToxicityModel:
    """Dictionaries from ``seen``, calibration on ``unseen``; both are texts with their label. :func:`fit` does this on tables."""
    counts, totals = (Counter(), Counter()), [0, 0]
    for text, label in dict(seen).items():  # equal texts count once
        counts[label].update(set(_words(text)))
        totals[label] += 1
    picked, tried = [], sum(n >= LEAST_DOCS for n in counts[1].values())
    for word, n in counts[1].items():
        m = counts[0][word]
        share = totals[1] / (totals[0] + totals[1])
        expected = (n + m) * share
        if n < LEAST_DOCS or n <= LEAST_RATIO * expected:
            continue
        g = 2 * (n * math.log(n / expected) + (m * math.log(m / (n + m - expected)) if m else 0.0))
        if g > 2 * math.log(tried):
            picked.append((g, word))
    if not picked or not any(label for _, label in unseen):
        return ToxicityModel(prior=prior)
    chosen = {w for _, w in picked}
    common = [w for w, _ in sorted(counts[0].items(), key=lambda x: (-x[1], x[0])) if w not in chosen]
    model = _built(common, [w for _, w in sorted(picked, reverse=True)], prior)
    model.explained = int(np.median([model._compressors().lengths(w)[1] for w in chosen]))
    outlines = [(label, model.outline(text)) for text, label in unseen]
    model.gain = _best_gain(Counter((label, o[-1]) for label, o in outlines))
    at = GAINS.index(model.gain)
    model.weights = _weights(Counter((label, o[at], o[-1]) for label, o in outlines), model.gain)
    return model


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, m): the toxic and the ordinary texts of ``texts`` (t, y) that hold a word; the empty word stands for all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int]] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in held], pa.string()), pa.array([y for _, y in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "y", "n"]
            )
            held.clear()
            return made

        for batch in slices(batches, "t"):
            for text, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist()):
                held.update((w, y) for w in {"", *_words(text)})
                if len(held) > MEMO_WORDS:
                    yield out()
        yield out()

    n, m = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((1, "n"), (0, "m")))
    return texts.select("t", "y").mapInArrow(run, "word string, y int, n bigint").groupBy("word").agg(n, m)


def _median_length(words: DataFrame, model: ToxicityModel) -> int:
    """The median compressed length of ``words`` with the toxic dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model._compressors().lengths(w)[1] for w in batch.column("word").to_pylist()], pa.int32())], names=["length"])

    return int(words.select("word").mapInArrow(run, "length int").agg(F.median("length")).first()[0])


def _outlines(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """(y, windows, most) of ``texts`` (t, y): see :meth:`ToxicityModel.outline`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = [model.outline(t) for t in batch.column("t").to_pylist()]
            made = [batch.column("y"), pa.array([o[:-1] for o in found], pa.list_(pa.int32())), pa.array([o[-1] for o in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["y", "windows", "most"])

    return texts.select("t", "y").mapInArrow(run, "y int, windows array<int>, most int")


def fit(docs: DataFrame, labels: DataFrame, seen: Column, unseen: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on the whole texts of all labelled rows.

    ``seen`` and ``unseen`` are conditions on the id column: rows for the dictionaries and for calibration. Rows
    with a null text or label teach nothing. Labels of more than one kind for an id are each used. Equal texts
    count once for the dictionaries, as ordinary if they have both labels. Words are counted and texts measured
    in tasks; the driver gets the words that fill the dictionaries and counts of equal measures.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    use = known.select("*", F.when(seen, 0).when(unseen, 1).alias("use")).filter("use is not null")
    prior = float(use.agg(F.avg("y")).first()[0] or 0.0)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter(F.col("t").isNotNull() & (seen | unseen))
    rows = rows.join(use.distinct().hint("merge"), "id")  # labels may be as many as documents
    once = rows.filter("use = 0").groupBy(wide_hash(1, F.col("t")).alias("h1"), wide_hash(2, F.col("t")).alias("h2")).agg(F.first("t").alias("t"), F.min("y").alias("y"))
    counts = cut(_word_counts(once))
    totals = counts.filter("word = ''").first()
    words = counts.filter("word <> ''")
    tried = words.filter(F.col("n") >= LEAST_DOCS).count()
    if not tried:
        return ToxicityModel(prior=prior)
    both = F.col("n") + F.col("m")
    expected = both * (totals.n / (totals.n + totals.m))
    g = 2 * (F.col("n") * F.log(F.col("n") / expected) + F.when(F.col("m") > 0, F.col("m") * F.log(F.col("m") / (both - expected))).otherwise(0.0))
    told = (F.col("n") >= LEAST_DOCS) & (F.col("n") > LEAST_RATIO * expected)
    rated = words.withColumn("g", F.when(told, g)).withColumn("picked", F.coalesce(F.col("g") > 2 * math.log(tried), F.lit(False)))
    room = DICTIONARY_BYTES // (len(_OPEN) + 1 + len(_CLOSE)) + 1  # more words than a dictionary holds
    strong = [r.word for r in rated.filter("picked").orderBy(F.desc("g"), F.desc("word")).limit(room).collect()]
    if not strong:
        return ToxicityModel(prior=prior)
    common = [r.word for r in rated.filter("not picked and m > 0").orderBy(F.desc("m"), "word").limit(room).collect()]
    model = _built(common, strong, prior)
    model.explained = _median_length(rated.filter("picked"), model)
    outlines = cut(_outlines(rows.filter("use = 1"), model))
    bests = Counter({(r.y, r.most): r["count"] for r in outlines.groupBy("y", "most").count().collect()})
    if not any(y for y, _ in bests):
        return ToxicityModel(prior=prior)
    model.gain = _best_gain(bests)
    windows = F.element_at("windows", GAINS.index(model.gain) + 1).alias("windows")
    model.weights = _weights(Counter({(r.y, r.windows, r.most): r["count"] for r in outlines.groupBy("y", windows, "most").count().collect()}), model.gain)
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with the score of the whole text in column ``name``, which is replaced if it is there.

    Empty and null texts have no toxic window and get the score that calibration found for none.
    """
    keep = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = pa.array([model.score(t or "") for t in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, name])

    return docs.mapInArrow(run, schema)
