"""Token counts with a tokenizer that is compiled into finite-state transducers.

The first transducer cuts normalised text into words (letters, single digits, other signs, clitics). The
second reads a word byte by byte, the last byte marked, and its transitions carry the change in the number of
byte-pair tokens. Its states are what the tokens of a word's prefix leave open: for every boundary from which a
vocabulary item may still go on, the item's trie node, the token before the boundary and the token count there
relative to the count here. States are made when text first asks for them.

Texts are cut into chunks. What a chunk does is a map of states: up to the end of the word it starts in it
depends on the state before, after that it does not. The maps of all chunks are made side by side and then
composed along each text by a scan.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from hitledger.llm.texts import slices

#: Symbols in a chunk; states that are kept from one part of a batch to the next.
CHUNK = 1024
MAX_STATES = 50_000
END = "</w>"
SPACE, LETTER, DIGIT, OTHER, UNSEEN = 0, 1, 2, 3, 255
#: What may follow an apostrophe at the start of a word of its own.
CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")
_STEP = 32  # added to a change of the count, which is small, to pack it with the next state


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Merges:
    """The merge rules; items are numbered as the vocabulary numbers them."""

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = _byte_letters()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            key, item = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[key], self.made[key] = rank, item
            self.parts[item] = key
        #: Symbols of each item: bytes, plus 256 for the last byte of a word.
        self.symbols: dict[int, tuple[int, ...]] = {}
        for text, item in vocab.items():
            ends = text.endswith(END) and len(text) > len(END)
            raw = [letters[c] for c in (text[: -len(END)] if ends else text)]
            self.symbols[item] = (*raw[:-1], raw[-1] + 256 * ends)
        self.single = {s[0]: item for item, s in self.symbols.items() if len(s) == 1}
        self._whole: dict[int, bool] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}

    def whole(self, item: int) -> bool:
        """Whether the rules turn the item's symbols into this one item."""
        if item not in self._whole:
            parts = [self.single[s] for s in self.symbols[item]]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
                pair = (parts[best], parts[best + 1])
                if pair not in self.made:
                    break
                parts[best : best + 2] = [self.made[pair]]
            self._whole[item] = parts == [item]
        return self._whole[item]

    def _spine(self, item: int, right: bool) -> list[tuple[int, float]]:
        """The items at one edge of the item as it was merged, each with the rank that used it up."""
        key = (item, right)
        if key not in self._spines:
            found, until = [(item, float("inf"))], float("inf")
            while item in self.parts:
                until = self.rank[self.parts[item]]
                item = self.parts[item][right]
                found.append((item, until))
            self._spines[key] = found
        return self._spines[key]

    def apart(self, left: int, right: int) -> bool:
        """Whether two items side by side stay two: no rule would join their edges before they are complete."""
        key = (left, right)
        if key not in self._apart:
            self._apart[key] = not any(
                (rank := self.rank.get((a, b))) is not None and rank < a_until and rank <= b_until
                for a, a_until in self._spine(left, True)
                for b, b_until in self._spine(right, False)
            )
        return self._apart[key]


class CountingTransducer:
    """Deterministic; state 0 is between words. ``packed`` holds, for state and symbol, the next state's row and the change."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._next: dict[tuple[int, int], int] = {}
        self._item: dict[int, int] = {}
        for item, symbols in merges.symbols.items():
            node = 0
            for s in symbols:
                node = self._next.setdefault((node, s), len(self._next) + 1)
            self._item[node] = item
        self._inner = {node for node, _ in self._next}
        self.column = np.full(512, -1, np.int32)
        self.width = 64
        self._reset()

    def _reset(self) -> None:
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.packed = np.full((1024, self.width), -1, np.int32)

    def trim(self) -> None:
        """Forget the states when they are many; to be called when none is in use."""
        if len(self.states) > MAX_STATES:
            self._reset()

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Table columns of symbols; each symbol gets one when it is first seen."""
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)):
            if self.column[s] < 0:
                self.column[s] = self.column.max() + 1
        if self.column.max() >= self.width:
            wider = np.full((len(self.packed), 2 * self.width), -1, np.int32)
            wider[:, : self.width] = self.packed
            old, self.width, self.packed = self.width, 2 * self.width, wider
            known = wider >= 0
            wider[known] = ((wider[known] >> 6) // old * self.width << 6) | (wider[known] & 63)
            return self.columns(symbols)
        return self.column[symbols]

    def step(self, state: int, symbol: int) -> None:
        """Make one transition."""
        open_, made, count, item_here = [], None, 0, -1
        for node, before, relative in self.states[state]:
            node = self._next.get((node, symbol))
            if node is None:
                continue
            item = self._item.get(node)
            if item is not None and made is None and self.merges.whole(item) and (before < 0 or self.merges.apart(before, item)):
                made, count, item_here = True, relative + 1, item
            if node in self._inner:
                open_.append((node, before, relative))
        if symbol >= 256:
            following = self.states[0]
        else:
            following = (*((n, b, r - count) for n, b, r in open_), (0, item_here, 0))
        to = self.number.get(following)
        if to is None:
            to = self.number[following] = len(self.states)
            self.states.append(following)
            if to == len(self.packed):
                self.packed = np.concatenate((self.packed, np.full_like(self.packed, -1)))
        self.packed[state, self.column[symbol]] = (to * self.width << 6) | (count + _STEP)

    def run(self, symbols: np.ndarray, columns: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run many stretches of symbols side by side, each from its state: the last states and the counts."""
        order = np.argsort(start - stop, kind="stable")
        at, length = start[order], (stop - start)[order]
        row, count = (state[order] * self.width).astype(np.int32), np.zeros(len(order), np.int32)
        flat = self.packed.reshape(-1)
        alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for done, n in enumerate(alive):
            here = at[:n] + done
            cell = row[:n] + columns[here]
            found = flat[cell]
            if found.min() < 0:
                missing = np.unique(cell[found < 0])
                symbol_of = {int(c): int(s) for c, s in zip(cell[found < 0], symbols[here[found < 0]])}
                for c in missing:
                    self.step(int(c) // self.width, symbol_of[int(c)])
                flat = self.packed.reshape(-1)
                found = flat[cell]
            count[:n] += (found & 63) - _STEP
            row[:n] = found >> 6
        last, total = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        last[order], total[order] = row // self.width, count
        return last, total


class CompiledTokenizer:
    """Counts tokens as the tokenizer file's own library does, without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self._cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.transducer = CountingTransducer(Merges(spec["model"]["vocab"], spec["model"]["merges"]))
        self.kind = np.full(0x110000, UNSEEN, np.uint8)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """The kind of each character, asked from the library when it is first seen."""
        kinds = self.kind[points]
        if (kinds == UNSEEN).any():
            for p in np.unique(points[kinds == UNSEEN]):
                spans = [s for _, s in self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(p)}!")]
                self.kind[p] = LETTER if spans[0] == (0, 2) else DIGIT if len(spans) == 3 else OTHER if spans[1][0] == 1 else SPACE
            kinds = self.kind[points]
        return kinds

    def _symbols(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all parts' words one after another, and where each part's symbols end."""
        normal = [(p if p.isascii() else unicodedata.normalize("NFC", p).replace("Σ", "σ")).lower() for p in parts]
        text = "\n".join(normal) + "\n"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self._kinds(points)
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        first = (kind == DIGIT) | ((kind != before) & (kind != SPACE))
        marks = np.flatnonzero((points == 39) & first)
        taken = np.zeros(0, np.int64)
        for clitic in CLITICS:
            letters = [ord(c) for c in clitic]
            fits = marks[marks + len(letters) < len(points)]
            for i, letter in enumerate(letters):
                fits = fits[points[fits + 1 + i] == letter]
            marks = np.setdiff1d(marks, fits, assume_unique=True)
            first[fits + 1] = False
            after = fits + 1 + len(letters)
            first[after[kind[after] == LETTER]] = True
            taken = np.concatenate((taken, fits))
        last = np.concatenate((first[1:] | (kind[1:] == SPACE), np.ones(1, bool)))
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(size)
        symbols = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
        symbols[ends[last] - 1] += 256
        words = kind != SPACE
        kept = symbols[words if len(words) == len(symbols) else np.repeat(words, size)]
        before_part = np.cumsum(np.where(words, size, 0))
        return kept, before_part[np.cumsum([len(n) + 1 for n in normal]) - 1]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total, parts, owner = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            pieces = self._cut.split(t) if self._cut and "<" in t else [t]
            total[i] += len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        if not parts:
            return total
        symbols, ends = self._symbols(parts)
        self.transducer.trim()
        found = self._scan(symbols, ends)
        np.add.at(total, np.array(owner), found)
        return total

    def _scan(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each part, from the maps of its chunks."""
        starts = np.concatenate(([0], ends[:-1]))
        per = -(-(ends - starts) // CHUNK)
        part = np.repeat(np.arange(len(ends)), per)
        nth = np.arange(len(part)) - np.repeat(np.cumsum(per) - per, per)
        a = starts[part] + nth * CHUNK
        b = np.minimum(a + CHUNK, ends[part])
        columns = self.transducer.columns(symbols)
        # where a chunk stops depending on the state before it: behind the first end of a word (the first chunk: at once)
        word_ends = np.flatnonzero(symbols >= 256)
        free = word_ends[np.minimum(np.searchsorted(word_ends, a), len(word_ends) - 1)] + 1 if len(word_ends) else b.copy()
        free = np.where(nth == 0, a, np.minimum(free, b))
        fixed = (nth == 0) | np.isin(free - 1, word_ends)
        state, count = self.transducer.run(symbols, columns, free, b, np.zeros(len(a), np.int64))
        known, waiting = fixed.copy(), np.flatnonzero(nth > 0)
        while len(waiting):  # compose with the chunk before; a chunk inside one long word waits for that chunk
            now = waiting[known[waiting - 1]]
            to, more = self.transducer.run(symbols, columns, a[now], free[now], state[now - 1])
            count[now] += more
            open_ = ~fixed[now]
            state[now[open_]] = to[open_]
            known[now] = True
            waiting = waiting[~np.isin(waiting, now)]
        return np.bincount(part, count, len(ends)).astype(np.int64)


_COMPILED: dict[str, CompiledTokenizer] = {}


def compiled(path: str) -> CompiledTokenizer:
    """One compiled tokenizer for each file and process; its states serve all tasks of a worker."""
    if path not in _COMPILED:
        _COMPILED[path] = CompiledTokenizer(path)
    return _COMPILED[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows with ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text; a null text counts as empty.

    Strings of special tokens inside a text count as one token, as the library has it by default. Input columns
    of these two names are replaced, other columns stay; an empty table gives an empty table.
    """
    added = ["n_bytes", "n_tokens"]
    keep = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(path)
        for batch in slices(batches, text, 2 << 20):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            made = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokenizer.counts(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=keep + added)

    return docs.mapInArrow(run, schema)
