"""SentencePiece encoding and decoding (BPE models with byte fallback) with a suffix array.

The different words of a batch, but for those that a batch before it had, are concatenated and their suffixes sorted, as deep as the longest piece.
Every piece of the model is found by binary search as one range of the sorted suffixes; the ranges give all
places where a piece lies, its edges. Edges are sorted by where they end and relaxed in that order: of the
edges into a place the one is right whose piece stays apart from the piece before it. Byte-pair encodings of
prefixes agree, so exactly one edge fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hitledger.llm.texts import slices

SPACE = "▁"
#: Characters of words that one suffix array covers; bytes of text that are encoded together.
ARRAY_CHARS, ENCODE_BYTES = 1 << 18, 2 << 20
#: Encoded words that a worker remembers for its next batches.
MEMO_WORDS = 250_000
_UNKNOWN = -1
_DEPTH = 16
#: Slots that hold pairs of pieces with their verdicts, and the odd factor that spreads pairs over them.
_SLOT_BITS, _SPREAD = 20, np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class PieceModel:
    """The pieces of a model file and how they merge."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        self.bytes_ = np.full(256, -1, np.int32)
        self.piece: dict[int, str] = {}
        self.spell: list[bytes] = [b""] * self.size
        for i in range(self.size):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_[int(p[3:5], 16)] = i
                self.spell[i] = bytes([int(p[3:5], 16)])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.piece[i] = p
                self.spell[i] = p.replace(SPACE, " ").encode()
        if max(map(len, self.piece.values())) > _DEPTH or (self.bytes_ < 0).any():
            raise ValueError("pieces of at most 16 characters and byte fallback are supported")
        #: A smaller rank merges first.
        self.rank = {p: -lib.get_score(i) for i, p in self.piece.items()}
        self.number = {p: i for i, p in self.piece.items()}
        #: No piece goes on from another character to a space: then words are encoded each by itself.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.piece.values())
        self._spines: dict[tuple[int, bool], list[tuple[str, float]]] = {}
        self._parts: dict[int, tuple[str, str] | None] = {}
        # characters in order, as dense codes; 0 ends a word, unknown characters come last
        self.chars = sorted({c for p in self.piece.values() for c in p})
        self.code = {c: i + 1 for i, c in enumerate(self.chars)}
        self.other = len(self.chars) + 1
        self.ids = np.array(sorted(self.piece), np.int32)
        self.length = np.array([len(self.piece[i]) for i in self.ids], np.int64)
        padded = np.zeros((len(self.ids), _DEPTH), np.uint64)
        for row, i in enumerate(self.ids):
            padded[row, : self.length[row]] = [self.code[c] for c in self.piece[i]]
        self.low = _packed(padded)
        padded[np.arange(_DEPTH) >= self.length[:, None]] = 0xFFFF
        self.high = _packed(padded)
        self._forget()
        self.known = np.zeros(0, np.int64)
        self.verdict = np.zeros(0, bool)
        # the pair last seen in each slot, and its verdict: most are found there without a search
        self.slot_code = np.full(1 << _SLOT_BITS, np.iinfo(np.int64).min)
        self.slot_verdict = np.zeros(1 << _SLOT_BITS, bool)

    def _forget(self) -> None:
        self.memo = _Numbers()
        self.memo_ids, self.memo_counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _split(self, i: int) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece; '' twice for a single character, None if merging ends elsewhere."""
        if i not in self._parts:
            parts, last = list(self.piece[i]), ("", "")
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], float("inf")))
                if parts[best] + parts[best + 1] not in self.rank:
                    break
                last = (parts[best], parts[best + 1])
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self._parts[i] = last if len(parts) == 1 else None
        return self._parts[i]

    def _spine(self, i: int, right: bool) -> list[tuple[str, float]]:
        """What stands at one edge of the piece as it is merged, each with the rank of the merge that takes it up."""
        key = (i, right)
        if key not in self._spines:
            found, until = [(self.piece[i], float("inf"))], float("inf")
            while (parts := self._split(self.number[found[-1][0]])) and parts[0]:
                until = self.rank[found[-1][0]]
                found.append((parts[right], until))
            self._spines[key] = found
        return self._spines[key]

    def follows(self, before: int, i: int) -> bool:
        """Whether the piece is one piece and stays apart from the piece before it (-2: a word begins here)."""
        if i == _UNKNOWN:
            return True
        if self._split(i) is None:
            return False
        if before < 0:
            return True
        return not any(
            (rank := self.rank.get(a + b)) is not None and rank < a_until and rank <= b_until
            for a, a_until in self._spine(before, True)
            for b, b_until in self._spine(i, False)
        )

    def allowed(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """``follows`` of many pairs; verdicts are remembered."""
        code = (before.astype(np.int64) + 2) * (self.size + 1) + ids + 1
        slot = ((code.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)
        said = self.slot_verdict[slot]
        missed = np.flatnonzero(self.slot_code[slot] != code)
        if len(missed):
            said[missed] = self._verdicts(code[missed])
            self.slot_code[slot[missed]], self.slot_verdict[slot[missed]] = code[missed], said[missed]
        return said

    def _verdicts(self, code: np.ndarray) -> np.ndarray:
        """Verdicts of pairs from all that are known, which those that are new join."""
        at = np.searchsorted(self.known, code)
        at[at == len(self.known)] = 0
        fresh = self.known[at] != code if len(self.known) else np.ones(len(code), bool)
        if fresh.any():
            new = np.unique(code[fresh])
            said = np.array([self.follows(int(c) // (self.size + 1) - 2, int(c) % (self.size + 1) - 1) for c in new], bool)
            places = np.searchsorted(self.known, new)
            self.known, self.verdict = np.insert(self.known, places, new), np.insert(self.verdict, places, said)
            at = np.searchsorted(self.known, code)
        return self.verdict[at]

    # -- words -> ids ----------------------------------------------------------------------------------------

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        seen, where = np.unique(points, return_inverse=True)
        return np.array([0 if p == 0xFFFF else self.code.get(chr(p), self.other) for p in seen], np.int64)[where]

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every place of every piece."""
        wide = np.concatenate((codes, np.zeros(_DEPTH, np.int64))).astype(np.uint64)
        n = len(codes)
        four = (wide[:-3] << np.uint64(48)) | (wide[1:-2] << np.uint64(32)) | (wide[2:-1] << np.uint64(16)) | wide[3:]
        rank = np.unique(four, return_inverse=True)[1]
        for step in (4, 8):
            further = np.concatenate((rank[step:], np.zeros(step, np.int64)))
            rank = np.unique(rank * (rank.max() + 1) + further, return_inverse=True)[1]
        suffixes = np.argsort(rank[:n], kind="stable")
        sorted_ = [four[k : k + n][suffixes] for k in range(0, _DEPTH, 4)]
        first, behind = _search(sorted_, self.low, False), _search(sorted_, self.high, True)
        times = behind - first
        which = np.repeat(np.arange(len(self.ids)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        start = suffixes[first[which] + nth]
        lone = np.flatnonzero(codes == self.other)  # an unknown character is an edge of its own
        start, ids = np.concatenate((start, lone)), np.concatenate((self.ids[which], np.full(len(lone), _UNKNOWN, np.int32)))
        end = start + np.concatenate((self.length[which], np.ones(len(lone), np.int64)))
        return start, end, ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, unknown characters as bytes, and the number of each word's ids."""
        ids, counts, block, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
        for n, w in enumerate(words, 1):
            block.append(w)
            size += len(w) + 1
            if size >= ARRAY_CHARS or n == len(words):
                made, owner = self._encode_block(block)
                ids.append(made)
                counts.append(np.bincount(owner, minlength=len(block)))
                block, size = [], 0
        return np.concatenate(ids), np.concatenate(counts)

    def _encode_block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "￿".join(w.replace("￿", "￾") if "￿" in w else w for w in words) + "￿"
        codes = self._codes(text)
        lengths = np.array([len(w) for w in words], np.int64)
        origin = np.cumsum(lengths + 1) - lengths - 1
        start, end, ids = self._edges(codes)
        word_of = np.repeat(np.arange(len(words)), lengths + 1)
        word = word_of[start]
        # relax in the order of ends, all words abreast: edges that end at the same distance from their word's start
        step = end - origin[word]
        step = step.astype(np.uint16) if lengths.max() < 1 << 16 else step
        order = np.argsort(step, kind="stable")
        start, end, ids, step = start[order], end[order], ids[order], step[order]
        last = np.full(len(codes) + 1, -3, np.int64)
        back = np.zeros(len(codes) + 1, np.int64)
        last[origin] = -2
        bounds = np.searchsorted(step, np.arange(1, (int(step[-1]) if len(step) else 0) + 2))
        for a, b in zip(bounds, bounds[1:]):
            good = np.flatnonzero(self.allowed(last[start[a:b]], ids[a:b])) + a
            last[end[good]], back[end[good]] = ids[good], start[good]
        marks = np.zeros(len(codes) + 1, bool)  # ends of the pieces on the paths
        at = (origin + lengths)[lengths > 0]
        begin = origin[lengths > 0]
        while len(at):
            marks[at] = True
            at = back[at]
            alive = at > begin
            at, begin = at[alive], begin[alive]
        ends = np.flatnonzero(marks)
        made = last[ends]
        owner = word_of[ends - 1]
        if (made == _UNKNOWN).any():
            expanded, owners = [], []
            for e, i, w in zip(ends.tolist(), made.tolist(), owner.tolist()):
                new = [i] if i != _UNKNOWN else [int(self.bytes_[x]) for x in words[w][e - 1 - origin[w]].encode()]
                expanded += new
                owners += [w] * len(new)
            made, owner = np.array(expanded), np.array(owners)
        return made.astype(np.int32), owner

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin and end."""
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        number, each = self.memo, []
        units_of = [0]
        for t in texts:
            whole = SPACE + t.replace(" ", SPACE) if t else ""
            units = _WORD.findall(whole) if self.by_word else [whole] * bool(whole)
            each += map(number.__getitem__, units)
            units_of.append(len(each))
        ids, counts = self.encode_words(list(islice(number, len(self.memo_counts), None)))
        ids = self.memo_ids = np.concatenate((self.memo_ids, ids))
        counts = self.memo_counts = np.concatenate((self.memo_counts, counts))
        units = np.array(each, np.int64)
        first = np.cumsum(counts) - counts
        times = counts[units]
        ends = np.concatenate(([0], np.cumsum(times)))
        take = np.repeat(first[units] - ends[:-1], times) + np.arange(ends[-1])
        return ids[take], ends[units_of]

    def decode(self, ids) -> str:
        """The text of ids: bytes that form no character become replacement characters; one leading space goes."""
        text = b"".join([self.spell[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def _packed(codes: np.ndarray) -> list[np.ndarray]:
    return [(codes[:, k] << np.uint64(48)) | (codes[:, k + 1] << np.uint64(32)) | (codes[:, k + 2] << np.uint64(16)) | codes[:, k + 3] for k in range(0, _DEPTH, 4)]


def _search(rows: list[np.ndarray], keys: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all keys at once in rows sorted by several columns."""
    n = len(rows[0])
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), n, np.int64)
    while (low < high).any():
        mid = (low + high) >> 1
        look = np.minimum(mid, n - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for row, key in zip(rows, keys):
            value = row[look]
            less |= same & (value < key)
            same &= value == key
        go = (less | (same & right)) & (low < high)
        low, high = np.where(go, mid + 1, low), np.where(go | (low >= high), high, mid)
    return low


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """The rows with ``token_ids`` and ``n_tokens`` of the whole text; a null text has no tokens.

    With ``check`` the ids are decoded again and ``round_trip`` says whether the text came back. Input columns
    of these names are replaced, others stay.
    """
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("round_trip", T.BooleanType())] * check
    keep = [c for c in docs.columns if c not in [f.name for f in added]]
    schema = T.StructType([docs.schema[c] for c in keep] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches, text, ENCODE_BYTES):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids, ends = pieces.encode(texts)
            made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(np.diff(ends))]
            if check:
                same = [pieces.decode(ids[a:b].tolist()) == t.replace(SPACE, " ") for a, b, t in zip(ends, ends[1:], texts)]
                made.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=keep + [f.name for f in added])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, token_ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """The rows with the text of ``token_ids`` in a new column; null for null ids."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts = [None if i is None else pieces.decode(i) for i in batch.column(token_ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)
