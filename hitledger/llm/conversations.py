"""Repair of conversation structure by generalised LR parsing with weighted edits.

The roles of a conversation are the input of a small grammar. All cheapest ways to edit them into a sentence are
followed at once over a graph-structured stack: a top is an LR state above a shared node, equal tops are one node
and keep the least (cost, audit), where the audit is the text of the edits' initials. Before each row any number
of turns may be inserted; the row is then deleted, kept, or given another role.

What a row does to a set of tops depends only on their order and on the row's role and fault, so each such step is
made once and remembered. A conversation that lies in several tasks is parsed from every top it could have in each
part; the parts are then joined by the same rule.

Rows are in order of turn (nulls first), then role, then text. A null role or text is one space. Repeated rows
are rows. Turns are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.texts import cut, slices, wide_hash

#: The role grammar over initials: an optional system turn, then pairs of user and assistant; or nothing.
ROLES = (("C", ()), ("C", ("s", "T")), ("C", ("T",)), ("T", ("u", "a")), ("T", ("T", "u", "a")))
#: Roles that an edit may give, by initial.
GIVEN = {"u": "user", "a": "assistant"}
#: Conversations of more text than this are not held by a task but go on as parts.
HELD_BYTES = 32 << 20
#: Characters of a text that decide where a range of rows may begin.
RANGE_CHARS = 256

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Weights:
    """Costs of the edits; ``truncated`` is added for a truncated row that is not deleted."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Stacks:
    """LR stacks of a grammar whose nodes are shared: a node is a state above another node."""

    def __init__(self, productions=ROLES):
        self.productions = (("'", (productions[0][0],)), *productions)
        self.left = {p[0] for p in self.productions}
        self.tokens = tuple(dict.fromkeys(x for _, r in self.productions for x in r if x not in self.left))
        self.follow = self._follow()
        self.states: dict[frozenset, int] = {}
        self.go: list[dict[str, int]] = []
        self.done: dict[int, list[int]] = {}
        self._state(self._closure({(0, 0)}))
        self.nodes: list[tuple[int, int]] = []
        self._ids: dict[tuple[int, int], int] = {}
        self.start = self._node(0, -1)

    def _follow(self) -> dict[str, set[str]]:
        empty: set[str] = set()
        first = {x: {x} for x in self.tokens} | {x: set() for x in self.left}
        follow: dict[str, set[str]] = {x: set() for x in self.left}
        follow["'"].add("$")
        size = -1
        while size != (size := len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values()))):
            for left, right in self.productions:
                for at, x in enumerate(right):
                    if all(y in empty for y in right[:at]):
                        first[left] |= first[x]
                    if x in self.left:
                        rest = right[at + 1 :]
                        for k, y in enumerate(rest):
                            if all(z in empty for z in rest[:k]):
                                follow[x] |= first[y]
                        if all(y in empty for y in rest):
                            follow[x] |= follow[left]
                if all(x in empty for x in right):
                    empty.add(left)
        return follow

    def _closure(self, items: set[tuple[int, int]]) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            p, dot = todo.pop()
            right = self.productions[p][1]
            if dot < len(right):
                for q, (left, _) in enumerate(self.productions):
                    if left == right[dot] and (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        return frozenset(items)

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            at = self.states[items] = len(self.go)
            self.go.append({})
            moves: dict[str, set] = {}
            for p, dot in items:
                right = self.productions[p][1]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((p, dot + 1))
            for x, kernel in sorted(moves.items()):
                self.go[at][x] = self._state(self._closure(kernel))
            self.done[at] = [p for p, dot in items if dot == len(self.productions[p][1])]
        return self.states[items]

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self._ids:
            self._ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self._ids[key]

    def _reduced(self, node: int, ahead: str) -> list[int]:
        """``node`` and all tops that reductions with ``ahead`` as the next token make of it."""
        seen, todo = {node}, [node]
        while todo:
            top = todo.pop()
            for p in self.done[self.nodes[top][0]]:
                left, right = self.productions[p]
                if p and ahead in self.follow[left]:
                    base = top
                    for _ in right:
                        base = self.nodes[base][1]
                    new = self._node(self.go[self.nodes[base][0]][left], base)
                    if new not in seen:
                        seen.add(new)
                        todo.append(new)
        return sorted(seen)

    def shift(self, node: int, token: str) -> list[int]:
        """The tops after ``token``; a state that can only reduce does so at once."""
        out = []
        for top in self._reduced(node, token):
            to = self.go[self.nodes[top][0]].get(token)
            if to is None:
                continue
            new = self._node(to, top)
            while not self.go[self.nodes[new][0]] and len(self.done[self.nodes[new][0]]) == 1 and self.done[self.nodes[new][0]] != [0]:
                left, right = self.productions[self.done[self.nodes[new][0]][0]]
                for _ in right:
                    new = self.nodes[new][1]
                new = self._node(self.go[self.nodes[new][0]][left], new)
            out.append(new)
        return out

    def accepts(self, node: int) -> bool:
        return any(0 in self.done[self.nodes[top][0]] for top in self._reduced(node, "$"))


class Repair:
    """Steps of a set of tops, each made once. A set is a tuple of (node, cost over the least, rank of its audit)."""

    def __init__(self, weights: Weights = Weights(), productions=ROLES):
        self.weights, self.stacks = weights, Stacks(productions)
        self._steps: dict = {}
        self._ends: dict = {}
        self.tops = self._all_tops()

    def _all_tops(self) -> list[int]:
        """Every top a conversation can have between two rows."""
        seen, todo = {self.stacks.start}, [self.stacks.start]
        while todo:
            node = todo.pop()
            for token in self.stacks.tokens:
                for new in self.stacks.shift(node, token):
                    if new not in seen:
                        seen.add(new)
                        todo.append(new)
        return sorted(seen)

    def _inserted(self, node: int) -> dict[int, tuple[int, str]]:
        """The least (cost, edits) with which insertions alone lead from ``node`` to each top."""
        best = {node: (0, "")}
        todo = [node]
        while todo:
            at = todo.pop(0)
            cost, edits = best[at]
            for token in GIVEN:
                for new in self.stacks.shift(at, token):
                    entry = (cost + self.weights.insert, edits + "I")
                    if new not in best or entry < best[new]:
                        best[new] = entry
                        todo.append(new)
        return best

    def step(self, tops: tuple, initial: str, must_go: bool, truncated: bool):
        """(tops after a row, cost to add, for each of them the place of the top it came from and the edits)."""
        key = (tops, initial, must_go, truncated)
        if key not in self._steps:
            w, found = self.weights, {}
            extra = w.truncated if truncated else 0

            def offer(node: int, cost: int, rank: int, edits: str, at: int) -> None:
                entry = (cost, rank, edits, at)
                if node not in found or entry < found[node]:
                    found[node] = entry

            for at, (node, cost, rank) in enumerate(tops):
                for held, (more, edits) in self._inserted(node).items():
                    offer(held, cost + more + w.delete, rank, edits + "D", at)
                    if must_go:
                        continue
                    for new in self.stacks.shift(held, initial):
                        offer(new, cost + more + w.keep + extra, rank, edits + "K", at)
                    for token in GIVEN:
                        for new in self.stacks.shift(held, token):
                            offer(new, cost + more + w.rerole + extra, rank, edits + "R", at)
            least = min(e[0] for e in found.values())
            audits = {a: n for n, a in enumerate(sorted({(e[1], e[2]) for e in found.values()}))}
            ordered = sorted((n, *e) for n, e in found.items())
            after = tuple((n, cost - least, audits[rank, edits]) for n, cost, rank, edits, _ in ordered)
            self._steps[key] = after, least, tuple((at, edits) for *_, edits, at in ordered)
        return self._steps[key]

    def end(self, tops: tuple):
        """(cost to add, place of the top it ends from, insertions at the end) of the cheapest end."""
        if tops not in self._ends:
            ways = []
            for at, (node, cost, rank) in enumerate(tops):
                for held, (more, edits) in self._inserted(node).items():
                    if self.stacks.accepts(held):
                        ways.append((cost + more, rank, edits, at))
            cost, _, edits, at = min(ways)
            self._ends[tops] = cost, at, edits
        return self._ends[tops]

    def replay(self, audit: str, node: int | None = None) -> Iterator[tuple[str, str | None]]:
        """(edit, role it gives) one after another; send the initial of a kept row. Used by :func:`_lines`."""
        node = self.stacks.start if node is None else node
        for edit in audit:
            role = None
            if edit in "IR":
                token = next(t for t in GIVEN if self.stacks.shift(node, t))
                node, role = self.stacks.shift(node, token)[0], GIVEN[token]
                yield edit, role
            else:
                initial = yield edit, None
                if edit == "K":
                    node = self.stacks.shift(node, initial)[0]


class Run:
    """A parse of consecutive rows from one top; what it remembers is one reference for each row."""

    def __init__(self, repair: Repair, node: int | None = None):
        self.repair = repair
        self.tops = ((repair.stacks.start if node is None else node, 0, 0),)
        self.cost, self.trail = 0, []

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.tops, more, back = self.repair.step(self.tops, initial, must_go, truncated)
        self.cost += more
        self.trail.append(back)

    def audit(self, at: int) -> str:
        """The edits that lead to the top at place ``at``."""
        out = []
        for back in reversed(self.trail):
            at, edits = back[at]
            out.append(edits)
        return "".join(reversed(out))

    def finish(self) -> tuple[int, str]:
        cost, at, edits = self.repair.end(self.tops)
        return self.cost + cost, self.audit(at) + edits

    def ways(self) -> list[tuple[int, int, str]]:
        """(top, cost, audit) of all tops."""
        return [(node, self.cost + cost, self.audit(at)) for at, (node, cost, _) in enumerate(self.tops)]


def _lines(replay: Iterator, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits leave."""
    try:
        edit, role = next(replay)
        while True:
            sent = None
            if edit == "I":
                yield edit, role, ""
            else:
                own, text = next(rows)
                sent = own[:1]
                if edit != "D":
                    yield edit, role or own, text
            edit, role = replay.send(sent)
    except StopIteration:
        return


@dataclass
class Figures:
    """Counts of consecutive rows of a conversation that can be added up."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, other: Figures) -> None:
        """Take up rows that come after these."""
        if not other.rows:
            return
        if self.rows and self.last + other.first not in ("su", "ua", "au"):
            self.illegal += 1
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high
        self.first, self.last = self.first if self.rows else other.first, other.last
        for c in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + getattr(other, c))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_FIGURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("rows", "blank", "duplicate", "truncated", "illegal")]
    + [T.StructField(c, T.StringType()) for c in ("first", "last")]
    + [T.StructField(c, T.LongType()) for c in ("low", "high", "turns")]
)
_WAY = T.StructType([T.StructField("into", T.LongType()), T.StructField("out", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])


def _schema(conv: T.DataType) -> T.StructType:
    """Rows of three kinds: 'done' and 'part' of a conversation, and 'turn' of a part or of a repaired one."""
    fields = [("kind", T.StringType()), ("conv", conv), ("part", T.LongType()), ("place", T.LongType()), ("figures", _FIGURES), ("ways", T.ArrayType(_WAY))]
    fields += [("cost", T.LongType()), ("audit", T.StringType()), ("digest", T.StringType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


class _Out:
    """Rows of :func:`_schema`, handed on in batches of bounded size."""

    def __init__(self, conv: T.DataType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(_schema(conv))
        self.rows, self.size = [], 0

    def put(self, **row) -> None:
        self.rows.append(row)
        self.size += 200 + len(row.get("text") or "") + len(row.get("audit") or "") + sum(len(w["audit"]) for w in row.get("ways") or ())

    def full(self) -> bool:
        return self.size > 4 << 20

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.size = [], 0
        return batch


def _prepared(turns: DataFrame, conversations: DataFrame | None, names: tuple[str, str, str, str]) -> DataFrame:
    """Different rows with their number, whether they hold the first of their role and text, and ids without rows."""
    conv, turn, role, text = (F.col(c) for c in names)
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select(conv.alias("conv"), turn.cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = rows.select("*", wide_hash(31, F.col("role"), F.col("text")).alias("h1"), wide_hash(32, F.col("role"), F.col("text")).alias("h2"))
    first = rows.groupBy("conv", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("t"))
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("string")
    every = rows.select("conv", "turn", "h1", "h2", "role", "text", one.alias("n"), F.lit(False).alias("first"))
    every = every.unionByName(first.select("conv", F.col("t.turn").alias("turn"), "h1", "h2", none.alias("role"), none.alias("text"), (one - 1).alias("n"), F.lit(True).alias("first")))
    if conversations is not None:
        nothing = F.lit(None).cast("bigint")
        ids = conversations.select(F.col(names[0]).alias("conv")).distinct()
        every = every.unionByName(ids.select("conv", nothing.alias("turn"), nothing.alias("h1"), nothing.alias("h2"), none.alias("role"), none.alias("text"), (one - 1).alias("n"), F.lit(False).alias("first")))
    merged = every.groupBy("conv", "turn", "h1", "h2").agg(F.sum("n").alias("n"), F.max("first").alias("first"), F.max("role").alias("role"), F.max("text").alias("text"))
    ranged = merged.repartitionByRange("conv", "turn", "role", F.substring("text", 1, RANGE_CHARS))
    return ranged.sortWithinPartitions("conv", "turn", "role", "text").select("conv", "turn", "role", "text", "n", "first")


def _parsed(prepared: DataFrame, repair: Repair, turns: bool) -> DataFrame:
    """One pass over the sorted rows: whole conversations done, the others, at the tasks' edges or too long, as parts."""
    conv_type = prepared.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), _Out(conv_type)
        conv, figures, runs, held, size, place = None, None, [], [], 0, 0
        begun, edge, split = False, True, False  # edge: the conversation is the task's first

        def spill() -> None:
            nonlocal held, size, place
            for role, text in held:
                out.put(kind="turn", conv=conv, part=part, place=place, role=role, text=text)
                place += 1
            held, size = [], 0

        def close(last: bool) -> None:
            nonlocal split
            if edge or last or split:
                spill()
                ways = [{"into": into, "out": o, "cost": c, "audit": a} for into, r in runs for o, c, a in r.ways()]
                out.put(kind="part", conv=conv, part=part, place=-1, figures=vars(figures), ways=ways)
                return
            cost, audit = runs[0][1].finish()
            digest, sep = hashlib.sha256(), b""
            for at, (edit, role, text) in enumerate(_lines(repair.replay(audit), iter(held)), 1):
                digest.update(sep + f"{role}:{text}".encode())
                sep = b"\n"
                if turns:
                    out.put(kind="kept", conv=conv, part=part, place=at, edit=edit, role=role, text=text)
            out.put(kind="done", conv=conv, part=part, place=-1, figures=vars(figures), cost=cost, audit=audit, digest=digest.hexdigest())

        for batch in slices(batches, "text"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "n", "first"))):
                if not begun or row[0] != conv:
                    if begun:
                        close(False)
                        edge = False
                        if out.full():
                            yield out.take()
                    conv, figures, held, size, place, split, begun = row[0], Figures(), [], 0, 0, False, True
                    into = repair.tops if edge else [repair.stacks.start]
                    runs = [(node, Run(repair, node)) for node in into]
                _, turn, role, text, n, first = row
                if not n:
                    continue
                ink = text.rstrip(_SPACE)
                known = turn is not None
                for copy in range(n):
                    blank = not ink
                    duplicate = not blank and not (first and not copy)
                    truncated = not blank and not duplicate and ink[-1] not in ".!?"
                    figures.add(Figures(1, int(blank), int(duplicate), int(truncated), 0, role[:1], role[:1], turn, turn, int(known)))
                    for _, r in runs:
                        r.row(role[:1], blank or duplicate, truncated)
                    held.append((role, text))
                    size += len(text)
                    if edge or split or size > HELD_BYTES:
                        split = True
                        spill()
                        if out.full():
                            yield out.take()
        if begun:
            close(True)
        if out.rows:
            yield out.take()

    return prepared.mapInArrow(run, _schema(conv_type))


def _composed(parts: DataFrame, repair: Repair) -> DataFrame:
    """The parts of each conversation joined: a 'total' row, and a 'part' row with its top and edits for each part."""
    conv_type = parts.schema["conv"].dataType
    ordered = parts.repartition("conv").sortWithinPartitions("conv", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(conv_type)
        conv, begun, figures, tops, trail = None, False, None, None, None

        def close() -> None:
            ways = []
            for node, (cost, rank) in tops.items():
                for held, (more, edits) in repair._inserted(node).items():
                    if repair.stacks.accepts(held):
                        ways.append((cost + more, rank, edits, node))
            cost, _, edits, node = min(ways)
            chosen = []
            for part, back in reversed(trail):
                before, audit = back[node]
                chosen.append((part, before, audit))
                node = before
            chosen.reverse()
            chosen[-1] = (*chosen[-1][:2], chosen[-1][2] + edits)
            for part, into, audit in chosen:
                out.put(kind="part", conv=conv, part=part, place=-1, cost=into, audit=audit)
            out.put(kind="total", conv=conv, part=1 << 40, place=-1, figures=vars(figures), cost=cost, audit="".join(a for *_, a in chosen))

        for batch in batches:
            for row in batch.select(["conv", "part", "figures", "ways"]).to_pylist():
                if not begun or row["conv"] != conv:
                    if begun:
                        close()
                        if out.full():
                            yield out.take()
                    conv, begun, figures, tops, trail = row["conv"], True, Figures(), {repair.stacks.start: (0, 0)}, []
                figures.add(Figures(**row["figures"]))
                found: dict[int, tuple] = {}
                for w in row["ways"]:
                    if w["into"] in tops:
                        cost, rank = tops[w["into"]]
                        entry = (cost + w["cost"], rank, w["audit"], w["into"])
                        if w["out"] not in found or entry < found[w["out"]]:
                            found[w["out"]] = entry
                order = {a: n for n, a in enumerate(sorted({(e[1], e[2]) for e in found.values()}))}
                tops = {node: (e[0], order[e[1], e[2]]) for node, e in found.items()}
                trail.append((row["part"], {node: (e[3], e[2]) for node, e in found.items()}))
        if begun:
            close()
        if out.rows:
            yield out.take()

    return ordered.mapInArrow(run, _schema(conv_type))


def _joined(turns: DataFrame, composed: DataFrame, repair: Repair, kept: bool) -> DataFrame:
    """The repaired turns of conversations in parts, and their digests, from a stream of their rows in order.

    A SHA-256 is made byte after byte, so the rows of one conversation pass one task; they are not held there.
    """
    conv_type = turns.schema["conv"].dataType
    every = composed.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "part", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(conv_type)
        digest, sep, place, replay, edit = hashlib.sha256(), b"", 0, None, None

        def emit(conv, edit: str, role: str, text: str) -> None:
            nonlocal sep, place
            digest.update(sep + f"{role}:{text}".encode())
            sep, place = b"\n", place + 1
            if kept:
                out.put(kind="kept", conv=conv, place=place, edit=edit, role=role, text=text)

        def ahead(conv, sent: str | None = None, begin: bool = False) -> None:
            """On to the next edit that takes a row."""
            nonlocal edit
            edit = next(replay, None) if begin else _next(replay, sent)
            while edit is not None and edit[0] == "I":
                emit(conv, "I", edit[1], "")
                edit = _next(replay, None)

        for batch in slices(batches, "text"):
            for row in batch.select(["kind", "conv", "part", "figures", "cost", "audit", "role", "text"]).to_pylist():
                if row["kind"] == "part":
                    replay = repair.replay(row["audit"], row["cost"])
                    ahead(row["conv"], begin=True)
                elif row["kind"] == "turn":
                    what, role = edit
                    if what != "D":
                        emit(row["conv"], what, role or row["role"], row["text"])
                    ahead(row["conv"], row["role"][:1])
                else:
                    out.put(kind="done", conv=row["conv"], part=row["part"], place=-1, figures=row["figures"], cost=row["cost"], audit=row["audit"], digest=digest.hexdigest())
                    digest, sep, place = hashlib.sha256(), b"", 0
                if out.full():
                    yield out.take()
        if out.rows:
            yield out.take()

    return every.mapInArrow(run, _schema(conv_type))


def _next(replay: Iterator, sent: str | None):
    try:
        return replay.send(sent)
    except StopIteration:
        return None


def _all(turns: DataFrame, conversations: DataFrame | None, names: tuple[str, str, str, str], weights: Weights, kept: bool) -> DataFrame:
    repair = Repair(weights)
    parsed = cut(_parsed(_prepared(turns, conversations, names), repair, kept))
    composed = _composed(parsed.filter("kind = 'part'"), repair)
    split = _joined(parsed.filter("kind = 'turn'"), composed, repair, kept)
    return parsed.filter("kind in ('done', 'kept')").unionByName(split)


def repair(
    turns: DataFrame, conversations: DataFrame | None = None, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", weights: Weights = Weights()
) -> DataFrame:
    """One row for each conversation: its faults, the cheapest edits and a digest of the repaired turns.

    A row's first fault counts: blank (nothing but white space), duplicate (its role and text came before in the
    conversation), truncated (its last visible character is none of ``.!?``). Blank rows and duplicates are
    deleted. ``illegal`` counts neighbours whose initials are not su, ua or au, ``gaps`` the turn numbers that
    are left out. ``conversations`` names ids that are reported even if they have no rows: with zeros, no edits
    and the digest of an empty text. A null id is a conversation of its own.
    """
    done = _all(turns, conversations, (conv_id, turn, role, text), weights, False)
    f = F.col("figures")
    gaps = F.when(f["low"].isNull(), 0).otherwise(f["high"] - f["low"] + 1 - f["turns"]).cast("bigint")
    counts = [f[c].alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    return done.select(F.col("conv").alias(conv_id), gaps.alias("gaps"), *counts, "cost", "audit", F.col("digest").alias("repaired_sha256"))


def repaired_turns(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", weights: Weights = Weights()) -> DataFrame:
    """The turns of the repaired conversations: (conv_id, place, edit, role, text), ``place`` rising in order."""
    kept = _all(turns, None, (conv_id, turn, role, text), weights, True).filter("kind = 'kept'")
    return kept.select(F.col("conv").alias(conv_id), "place", "edit", F.col("role").alias(role), F.col("text").alias(text))


def damage(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by a hash of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one
    space, in the hashed text too.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv_id), space(turn)).cast("binary")) % 20
    words = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    rows = conversations.select(F.col(conv_id), F.col(turn), F.when(kind == 4, "user").otherwise(space(role)).alias(role), words.alias(text), kind.alias("_kind"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("_kind <> 0").select(conv_id, turn, role, text, copies.alias("_copy")).drop("_copy")
