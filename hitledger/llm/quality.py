"""Document quality rules in a short-circuit cascade.

Every rule measures a document and rejects it or not; a document is kept if no rule rejects it. On a bounded
sample each rule's cost and the share it rejects are measured, and the rules then run in falling order of
rejection per cost, each one only on the documents that are still in. The order changes the time, never the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.texts import joined, slices

#: Documents on which costs and selectivities are measured.
SAMPLE_DOCS = 400
#: Words in the window whose repetition counts.
WINDOW = 8


def _flags(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_SPACE = _flags(b"\x20\x09\x0a\x0b\x0c\x0d")
_SYMBOL = _flags(b"#*$%&|<>")
_CAPITAL = _flags(bytes(range(65, 91)))
_SMALL = _flags(bytes(range(97, 123)))
_ALPHA = _CAPITAL | _SMALL | _flags(bytes(range(128, 256)))
_STARTS_CHAR = ~_flags(bytes(range(128, 192)))


class Texts:
    """Measures of a few documents; each array has one value for each of them and is made when asked for."""

    def __init__(self, texts: Sequence[bytes]):
        self.texts = texts

    def only(self, mask: np.ndarray) -> Texts:
        return Texts([t for t, m in zip(self.texts, mask) if m])

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return joined(pa.array(self.texts, pa.large_binary()))

    def _per_text(self, marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        ends = self._bytes[1]
        return total[ends] - total[np.concatenate(([0], ends[:-1]))]

    @cached_property
    def _words(self) -> tuple[list[bytes], np.ndarray]:
        """All words one after another, and the number of each text's words."""
        each = [t.split() for t in self.texts]
        return [w for ws in each for w in ws], np.array([len(ws) for ws in each], np.int64)

    @property
    def n_words(self) -> np.ndarray:
        return self._words[1]

    def _sum_words(self, marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        ends = np.cumsum(self.n_words)
        return total[ends] - total[ends - self.n_words]

    @cached_property
    def word_chars(self) -> np.ndarray:
        data = self._bytes[0]
        return self._per_text(~_SPACE[data] & _STARTS_CHAR[data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self._bytes[0]])

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return self._lines[0]

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        full = [[line for line in t.split(b"\n") if line.strip()] for t in self.texts]
        return np.array([len(x) for x in full], np.int64), np.array([len(x) - len(set(x)) for x in full], np.int64)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside a window of 8 words that the text has twice or more."""
        words, counts = self._words
        n = len(words)
        if n < WINDOW:
            return np.zeros(len(counts), np.int64)
        seen: dict[bytes, int] = {}
        code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        width = 1
        while width < WINDOW:  # the code of 2, 4, then 8 words from here on
            code = np.unique(code[:-width] * (code.max() + 1) + code[width:], return_inverse=True)[1]
            width *= 2
        starts = np.arange(n - WINDOW + 1)
        starts = starts[text[starts] == text[starts + WINDOW - 1]]
        if not len(starts):
            return np.zeros(len(counts), np.int64)
        _, group, size = np.unique(text[starts] * (code.max() + 1) + code[starts], return_inverse=True, return_counts=True)
        again = starts[size[group] > 1]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + WINDOW, -1)
        return self._sum_words(np.cumsum(step[:-1]) > 0)

    @cached_property
    def n_stutter(self) -> np.ndarray:
        """Words equal to the word before them."""
        words, counts = self._words
        same = np.fromiter((a == b for a, b in zip(words[1:], words)), bool, max(len(words) - 1, 0))
        marks = np.concatenate((np.zeros(min(1, len(words)), bool), same))
        starts = np.cumsum(counts) - counts
        marks[starts[counts > 0]] = False
        return self._sum_words(marks)

    def _words_with(self, flags: np.ndarray) -> np.ndarray:
        """Of each word, the number of bytes that ``flags`` marks."""
        words = self._words[0]
        if not words:
            return np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        total = np.concatenate(([0], np.cumsum(flags[data], dtype=np.int64)))
        return total[ends] - total[np.concatenate(([0], ends[:-1]))]

    @cached_property
    def n_alpha_words(self) -> np.ndarray:
        return self._sum_words(self._words_with(_ALPHA) > 0)

    @cached_property
    def n_capital_words(self) -> np.ndarray:
        """Words with two capitals or more and no small letter, of A-Z."""
        return self._sum_words((self._words_with(_CAPITAL) > 1) & (self._words_with(_SMALL) == 0))


@dataclass(frozen=True)
class Rule:
    name: str
    #: True for each document to reject.
    rejects: Callable[[Texts], np.ndarray]


#: Rules that the base measures decide.
BASE_RULES = [
    Rule("too_few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
]
#: Published heuristics for web text: word length, symbols, repeated lines, words without a letter, shouting, stutter.
RULES = [
    Rule("word_length", lambda t: (t.word_chars < 3 * t.n_words) | (t.word_chars > 12 * t.n_words)),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 5 * t.n_lines),
    Rule("letters", lambda t: 10 * t.n_alpha_words < 7 * t.n_words),
    Rule("shouting", lambda t: 10 * t.n_capital_words > 3 * t.n_words),
    Rule("stutter", lambda t: 10 * t.n_stutter > 3 * t.n_words),
]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def cascade(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """True for each kept document; a rule sees only what the rules before it let through."""
    kept = np.ones(len(texts.texts), bool)
    for rule in rules:
        bad = rule.rejects(texts)
        if bad.any():
            kept[np.flatnonzero(kept)[bad]] = False
            texts = texts.only(~bad)
    return kept


def measured_order(sample: Sequence[bytes], rules: Sequence[Rule]) -> list[Rule]:
    """The rules by the share they reject for each second they take."""
    worth = []
    for rule in rules:
        texts = Texts(sample)
        began = time.perf_counter()
        share = float(rule.rejects(texts).mean()) if sample else 0.0
        worth.append(share / max(time.perf_counter() - began, 1e-9))
    return [rule for _, rule in sorted(zip(worth, rules), key=lambda x: -x[0])]


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """Measure on at most ``sample_docs`` documents; only the order of the rules depends on them."""
    rows = docs.select(F.col(text).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(7)) == 0).limit(sample_docs).collect()
    return measured_order([(r.t or "").encode() for r in rows], rules)


def assess(docs: DataFrame, text: str = "text", *, rules: Sequence[Rule] | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The base measures of every document, ``base_failed`` and ``kept``, beside the input's columns.

    A null text has no words. Base rules need every measure, which is returned; the other rules run as a
    cascade on what passed. Input columns with the names of the measures are replaced. Equal rows get equal
    results; an empty table gives an empty table.
    """
    ordered = order_rules(docs, rules if rules is not None else RULES, text, sample_docs)
    flags = ["base_failed", "kept"]
    keep = [c for c in docs.columns if c not in BASE + flags]
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField(c, T.BooleanType()) for c in flags])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = Texts([t or b"" for t in batch.column(text).cast(pa.large_binary()).to_pylist()])
            failed = np.zeros(batch.num_rows, bool)
            for rule in BASE_RULES:
                failed |= rule.rejects(texts)
            kept = ~failed
            kept[kept] = cascade(texts.only(kept), ordered)
            made = [pa.array(getattr(texts, c)) for c in BASE] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=keep + BASE + flags)

    needed = docs if text in keep else docs.select(*keep, text)
    return needed.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", *, rules: Sequence[Rule] | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that no rule rejects, all rules in one cascade; the columns stay as they are."""
    ordered = order_rules(docs, rules if rules is not None else [*BASE_RULES, *RULES], text, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = Texts([t or b"" for t in batch.column(text).cast(pa.large_binary()).to_pylist()])
            yield batch.filter(pa.array(cascade(texts, ordered)))

    return docs.mapInArrow(run, docs.schema)
