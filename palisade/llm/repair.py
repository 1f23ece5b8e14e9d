"""Repair of the turn structure of conversations by a persistent audit DP.

A well-formed conversation has the role initials ``(s?(ua)+)?``.  Rows are
kept (free), given the role user or assistant (1), deleted (2) or joined by
inserted empty turns (5); blank rows and copies have to go, an unfinished row
that stays costs 5 more.  The cheapest edits win, and among those the audit
(the initials of the edits) that sorts first.

The search goes through the rows once with one best audit per state of the
pattern.  Audits are linked nodes that share their prefixes.  A node knows its
ancestors 1, 2, 4, ... steps up and a rolling hash of its letters, so two
audits of equal cost are compared by a search for their longest common prefix;
equal hashes are confirmed letter by letter.

Rows are dealt by conversation, sorted by Spark (which spills) and streamed.
What all live audits share is settled and leaves memory, so a conversation of
any length passes through a task without being held there; only a 16-byte
digest per distinct row stays, to know copies by.  It can't be cut in pieces
for several tasks: the digest of the repaired text is one SHA-256 chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import small_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
SPACE = b" \t\n\x0b\x0c\r"
LEGAL = (b"su", b"ua", b"au")

#: How far the pattern is: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, DONE = range(4)
_TO_USER = ((START, USER), (SYSTEM, USER), (DONE, USER))
_TO_ASSISTANT = ((USER, DONE),)
_MOVES = {b"s": ((START, SYSTEM),), b"u": _TO_USER, b"a": _TO_ASSISTANT}
_NAMES = {USER: b"user", DONE: b"assistant"}

AUDIT = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
         "repaired_sha256 string")
ROWS = "conv_id {id}, step long, edit string, turn long, role binary, text binary"


class Audits:
    """Edit sequences as nodes of a tree, each one letter longer than its parent; node 0 is the empty one."""

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 911382323):
        self.modulus, self.base = modulus, base
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def __len__(self) -> int:
        return len(self.letter)

    def add(self, parent: int, letter: str) -> int:
        up, k = [parent], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.modulus)
        self.up.append(up)
        return len(self.letter) - 1

    def lift(self, node: int, depth: int) -> int:
        """The ancestor at a depth."""
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _unequal(self, x: int, y: int) -> tuple[int, int] | None:
        """The first nodes whose letters differ on the ways to ``x`` and ``y``, found by walking."""
        found = None
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = x, y
            x, y = self.up[x][0], self.up[y][0]
        return found

    def _parting(self, x: int, y: int) -> tuple[int, int] | None:
        """The same by hashes, for nodes of one depth; what hashes call equal is confirmed."""
        if self.hash[x] == self.hash[y]:
            return self._unequal(x, y)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]):
                above, beside = self.up[x][k], self.up[y][k]
                if self.hash[above] != self.hash[beside]:
                    x, y = above, beside
        return self._unequal(self.up[x][0], self.up[y][0]) or (x, y)

    def compare(self, x: int, y: int) -> int:
        """Below, at or above 0 as the letters of ``x`` sort before, like or after those of ``y``."""
        depth = min(self.depth[x], self.depth[y])
        parted = self._parting(self.lift(x, depth), self.lift(y, depth))
        if parted:
            return -1 if self.letter[parted[0]] < self.letter[parted[1]] else 1
        return self.depth[x] - self.depth[y]

    def shared(self, x: int, y: int) -> int:
        """The deepest node on both ways."""
        depth = min(self.depth[x], self.depth[y])
        x, y = self.lift(x, depth), self.lift(y, depth)
        if x == y:
            return x
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.up[x][k] != self.up[y][k]:
                x, y = self.up[x][k], self.up[y][k]
        return self.up[x][0]

    def path(self, top: int, node: int) -> list[int]:
        """The nodes below ``top`` down to ``node``."""
        nodes = []
        while node != top:
            nodes.append(node)
            node = self.up[node][0]
        return nodes[::-1]

    def below(self, top: int, nodes: list[int]) -> tuple[Audits, list[int]]:
        """A tree of only the ways from ``top`` to ``nodes``, and where those are in it."""
        new, place = Audits(self.modulus, self.base), {top: 0}
        for node in nodes:
            for n in self.path(top, node):
                if n not in place:
                    place[n] = new.add(place[self.up[n][0]], self.letter[n])
        return new, [place[n] for n in nodes]


class Conversation:
    """The rows of one conversation, one after another."""

    def __init__(self, conv_id, settle_at: int = 4096, modulus: int = (1 << 61) - 1):
        self.conv_id = conv_id
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None
        self.seen: set[bytes] = set()
        self.audits, self.settle_at, self.limit = Audits(modulus), settle_at, settle_at
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._inserts()
        self.waiting: list[tuple] = []
        self.audit: list[str] = []
        self.at, self.digest, self.any = START, hashlib.sha256(), False
        self.step = 0

    def _offer(self, best: list, state: int, cost: int, parent: int, letter: str) -> None:
        held = best[state]
        if held is None or cost < held[0]:
            best[state] = cost, self.audits.add(parent, letter)
        elif cost == held[0]:
            node = self.audits.add(parent, letter)
            if self.audits.compare(node, held[1]) < 0:
                best[state] = cost, node

    def _inserts(self) -> None:
        for moves in (_TO_USER, _TO_ASSISTANT):
            for old, new in moves:
                if self.best[old]:
                    cost, node = self.best[old]
                    held = self.best[new]
                    if held is None or cost + COST[INSERT] <= held[0]:
                        self._offer(self.best, new, cost + COST[INSERT], node, INSERT)
        start, system, _, done = self.best
        # an assistant turn may be followed by all that may follow these two, for 2 at most more than from the start
        if done and start and done[0] + COST[DELETE] < start[0]:
            self.best[START] = None
        if done and system and done[0] < system[0]:
            self.best[SYSTEM] = None

    def add(self, turn, role: bytes, text: bytes) -> Iterator[tuple]:
        """Take the next row; gives the edited rows that are settled by now."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        row = hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()
        ends = text.rstrip(SPACE)[-1:]
        must_go = extra = 0
        if not ends:
            self.blank += 1
            must_go = 1
        elif row in self.seen:
            self.duplicate += 1
            must_go = 1
        elif ends not in b".!?":
            self.truncated += 1
            extra = TRUNCATED
        self.seen.add(row)
        self.waiting.append((turn, role, text))
        new: list = [None] * 4
        for state, held in enumerate(self.best):
            if held:
                self._offer(new, state, held[0] + COST[DELETE], held[1], DELETE)
        if not must_go:
            for moves, letter in ((_MOVES.get(initial, ()), KEEP), (_TO_USER + _TO_ASSISTANT, REROLE)):
                for old, state in moves:
                    if self.best[old]:
                        self._offer(new, state, self.best[old][0] + COST[letter] + extra, self.best[old][1], letter)
        self.best = new
        self._inserts()
        if len(self.audits) > self.limit:
            yield from self._settle()

    def _settle(self) -> Iterator[tuple]:
        """Decide what all live audits have in common and forget the rest of the tree."""
        live = [s for s in range(4) if self.best[s]]
        nodes = [self.best[s][1] for s in live]
        top = nodes[0]
        for node in nodes[1:]:
            top = self.audits.shared(top, node)
        yield from self._write(top)
        self.audits, moved = self.audits.below(top, nodes)
        for state, node in zip(live, moved, strict=True):
            self.best[state] = self.best[state][0], node
        self.limit = max(self.settle_at, 2 * len(self.audits))

    def _write(self, node: int) -> Iterator[tuple]:
        rows, letters = iter(self.waiting), [self.audits.letter[n] for n in self.audits.path(0, node)]
        for letter in letters:
            turn, role, text = (None, b"", b"") if letter == INSERT else next(rows)
            if letter in (REROLE, INSERT):
                self.at = DONE if self.at == USER else USER
                role = _NAMES[self.at]
            elif letter == KEEP:
                self.at = {b"s": SYSTEM, b"u": USER, b"a": DONE}[role[:1]]
            if letter != DELETE:
                self.digest.update(b"\n" * self.any + role + b":" + text)
                self.any = True
            yield self.conv_id, self.step, letter, turn, role, text
            self.step += 1
        self.audit.append("".join(letters))
        self.waiting = list(rows)

    def end(self) -> Iterator[tuple]:
        """Settle the rest; afterwards ``summary`` holds."""
        ends = [e for e in (self.best[START], self.best[DONE]) if e]
        self.cost, node = ends[0]
        if len(ends) == 2 and (ends[1][0] < self.cost or ends[1][0] == self.cost and self.audits.compare(ends[1][1], node) < 0):
            self.cost, node = ends[1]
        yield from self._write(node)

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
                self.digest.hexdigest())


def _stream(rows_wanted: bool, settle_at: int, id_type: pa.DataType):
    def pack(rows: list[tuple]) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()] if rows_wanted else [
            id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          [str(i) for i in range(len(types))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None

        def finish():
            edits = list(now.end())
            return edits if rows_wanted else [now.summary()]

        for batch in small_batches(batches):
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))
            for conv_id, turn, role, text, copies in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        held += finish()
                    now = Conversation(conv_id, settle_at)
                for _ in range(copies):
                    for edit in now.add(turn, role, text):
                        if rows_wanted:
                            held.append(edit)
                size += len(text) if rows_wanted else 1
                if held and (len(held) > 2000 or size > 8 << 20):
                    yield pack(held)
                    held, size = [], 0
        if now is not None:
            held += finish()
        if held:
            yield pack(held)
    return run


def _sorted(conversations: DataFrame, copies: str | None) -> DataFrame:
    many = F.lit(1) if copies is None else F.greatest(F.coalesce(F.col(copies), F.lit(1)), F.lit(0))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).cast("binary").alias("role"),
        F.coalesce("text", F.lit(" ")).cast("binary").alias("text"), many.cast("int").alias("copies"))
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _run(conversations: DataFrame, copies: str | None, settle_at: int, rows_wanted: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema["conv_id"].dataType
    schema = (ROWS if rows_wanted else AUDIT).format(id=kind.simpleString())
    return _sorted(conversations, copies).mapInArrow(_stream(rows_wanted, settle_at, to_arrow_type(kind)), schema)


def audit_conversations(conversations: DataFrame, copies: str | None = None, settle_at: int = 4096) -> DataFrame:
    """One row per ``conv_id``: its faults, the cost of the cheapest repair, the repair's audit and the digest of what it gives.

    ``conversations`` has ``conv_id, turn, role, text``; other columns are
    ignored.  Rows go by turn, nulls first; equal turns by role and text in
    UTF-8.  A null role or text is one space, a null ``conv_id`` an id like any
    other.  A row's first fault counts: blank, a copy (role and text seen
    earlier), truncated (the last character that isn't white space is none of
    ``.!?``).  ``illegal`` counts neighbours whose role initials are not su, ua
    or au; an empty role has none, is never legal and can't be kept.  ``copies`` names a
    column that says how often a row occurs (null: once, 0: not at all); a
    conversation without rows has zeros, an empty audit and the digest of
    nothing.  No rows at all: no rows.
    """
    return _run(conversations, copies, settle_at, False)


def repair_conversations(conversations: DataFrame, copies: str | None = None, settle_at: int = 4096) -> DataFrame:
    """The edits themselves: ``conv_id, step, edit, turn, role, text``, steps from 0.

    Without the rows whose ``edit`` is ``D`` these are the repaired
    conversations in order of ``step``.  Inserted turns have no ``turn`` and an
    empty text.  Everything else as in ``audit_conversations``.
    """
    edits = _run(conversations, copies, settle_at, True)
    return edits.withColumn("role", F.col("role").cast("string")).withColumn("text", F.col("text").cast("string"))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with seeded faults and a column ``copies``, to try a repair on.

    By crc32 of ``conv_id:turn`` modulo 20, nulls written as one space: 0
    drops a row (``copies`` 0), 1 empties its text, 2 removes ``.!?`` from it, 3
    repeats the row, 4 makes its role user.
    """
    def written(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat_ws(":", written("conv_id"), written("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
