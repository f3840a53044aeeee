"""Cheapest repair of conversations: a Viterbi pass whose survivors emit their edits once they share an ancestor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# a repaired conversation is empty, or an optional system row and then user and assistant rows by turns
EMPTY, SYSTEM, USER, ASSISTANT = "esua"
INITIALS = "sua"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FOLLOWS = {EMPTY: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # roles that may come next
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_OTHER = {USER: ASSISTANT, ASSISTANT: USER}
# any state does what another could at 12 more (two inserted rows and one deleted), so a survivor that much dearer never wins
_HOPELESS = INSERT + INSERT + DELETE
UNRESOLVED = 1 << 20  # bytes of unresolved rows after which every survivor carries a digest of its own

_BLANKS = " \t\n\x0b\x0c\r"
RESULT = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
          "n_rows long, most_unresolved long")


def _moves(state: str, initial: str, doomed: bool, truncated: bool) -> list[tuple[str, int, str]]:
    """(next state, cost, edits) of one row. An inserted row is put before a row that stays: before a deleted one it costs the same and reads later in ASCII."""
    out = [(state, DELETE, "D")]
    if doomed:
        return out
    for insert in (False, True):
        for to in INITIALS:
            if insert and (to == SYSTEM or _OTHER[to] not in _FOLLOWS[state]) or not insert and to not in _FOLLOWS[state]:
                continue
            cost = INSERT * insert + TRUNCATED * truncated
            if to == initial:
                out.append((to, cost, "I" * insert + "K"))
            if to != SYSTEM:
                out.append((to, cost + REROLE, "I" * insert + "R"))
    return out


@lru_cache(maxsize=1 << 16)
def _step(survivors: tuple[tuple[str, int], ...], initial: str, doomed: bool, truncated: bool):
    """One row: (survivors, what all of them cost more, (place of the ancestor, edits) of each).

    Survivors are (state, cost above the cheapest), in the order of their edits so far.
    All have edited the same rows and end with one, so none of these strings starts
    another, and ties between whole strings are ties between places, then between the
    row's edits.
    """
    best: dict[str, tuple] = {}
    for place, (state, cost) in enumerate(survivors):
        for to, more, edits in _moves(state, initial, doomed, truncated):
            found = (cost + more, place, edits)
            if to not in best or found < best[to]:
                best[to] = found
    least = min(c for c, _, _ in best.values())
    order = sorted((place, edits, c - least, state) for state, (c, place, edits) in best.items() if c - least <= _HOPELESS)
    return tuple((state, cost) for _, _, cost, state in order), least, tuple((place, edits) for place, edits, _, _ in order)


class _Node:
    """Edits of one row (or of several, when folded) in the tree of backpointers; ``refs`` counts its children."""

    __slots__ = ("parent", "edits", "state", "row", "refs", "digest")

    def __init__(self, parent, edits, state, row):
        self.parent, self.edits, self.state, self.row, self.refs, self.digest = parent, edits, state, row, 0, None


class _Digest:
    """sha256 of the repaired rows so far, joined by newlines."""

    __slots__ = ("sha", "some")

    def __init__(self, sha=None, some=False):
        self.sha, self.some = sha or hashlib.sha256(), some

    def copy(self) -> _Digest:
        return _Digest(self.sha.copy(), self.some)

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def apply(self, node: _Node) -> None:
        edits, state = node.edits, node.state
        if edits[0] == "I":
            self.add(_ROLE[_OTHER[state]], "")
        if edits[-1] == "K":
            self.add(*node.row)
        elif edits[-1] == "R":
            self.add(_ROLE[state], node.row[1])


class Repair:
    """One conversation, row by row; memory is that of the rows its survivors do not agree on."""

    def __init__(self):
        self.root = _Node(None, "", EMPTY, None)
        self.survivors, self.leaves = ((EMPTY, 0),), [self.root]
        self.cost, self.audit, self.digest = 0, [], _Digest()
        self.held = self.most = self.open = 0  # bytes and rows not emitted

    def row(self, role: str, text: str, initial: str, doomed: bool, truncated: bool) -> None:
        self.survivors, more, moves = _step(self.survivors, initial, doomed, truncated)
        self.cost += more
        old, row = self.leaves, (role, text)
        self.leaves = []
        for (state, _), (place, edits) in zip(self.survivors, moves):
            node = _Node(old[place], edits, state, row)
            old[place].refs += 1
            self.leaves.append(node)
        for node in old:
            while not node.refs and node is not self.root:  # no survivor descends from it
                node = node.parent
                node.refs -= 1
        self.held += len(text)
        self.open += 1
        if self.open > self.most:
            self.most = self.open
        if self.root.refs == 1:
            self._emit()
        if self.held > UNRESOLVED:
            self._fold()

    def _emit(self) -> None:
        """Edits that all survivors share: down from the root to the first node with several children, or to the only survivor."""
        path, node = [], self.leaves[0]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.refs == 1:
            self._emit_node(path.pop())
        if not path:
            self.held = 0

    def _emit_node(self, node: _Node) -> None:
        self.audit.append(node.edits)
        self.open -= len(node.edits) - node.edits.count("I")
        if node.digest is not None:
            self.digest = node.digest
        elif node.row is not None:
            self.digest.apply(node)
            self.held = max(0, self.held - len(node.row[1]))
        node.parent, self.root = None, node

    def _fold(self) -> None:
        """Gives every survivor a digest of its own and lets go of the rows; chains without branches become one node."""
        for leaf in self.leaves:
            path, node = [], leaf
            while node is not self.root and node.digest is None:
                path.append(node)
                node = node.parent
            digest = (self.digest if node is self.root else node.digest).copy()
            for n in reversed(path):
                digest.apply(n)
            leaf.digest = digest
        for leaf in self.leaves:
            node = leaf
            while node is not self.root:
                node.row, chain, up = None, [node.edits], node.parent
                while up is not self.root and up.refs == 1:
                    chain.append(up.edits)
                    up = up.parent
                node.edits, node.parent = "".join(reversed(chain)), up
                node = up
        self.held = 0

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the cheapest whole repair, the ASCII-least audit of equals."""
        closing = {EMPTY: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
        cost, place = min((cost + INSERT * closing[state], k) for k, (state, cost) in enumerate(self.survivors))
        state, path, node = self.survivors[place][0], [], self.leaves[place]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path:
            self._emit_node(path.pop())
        if state == SYSTEM:
            self.digest.add("user", "")
        if closing[state]:
            self.digest.add("assistant", "")
        return self.cost + cost, "".join(self.audit) + "I" * closing[state], self.digest.sha.hexdigest()


class _Conversation:
    """Counts of one conversation and its repair."""

    def __init__(self, conv_id):
        self.id, self.repair = conv_id, Repair()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.before = None

    def add(self, turn, role, text, code, first) -> None:
        initial, blank, cut = code[0], code[1] == "b", code[1] == "t"
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.rows += 1
        if blank:
            self.blank += 1
        elif not first:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        doomed = blank or not first
        self.repair.row(role, text, initial, doomed, cut and not doomed)

    def result(self) -> tuple:
        cost, audit, digest = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest, self.rows, self.repair.most


def _repair_stream(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, done = None, False, []
        for batch in batches:
            for conv_id, turn, role, is_row, text, code, times in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "is_row", "text", "code", "times"))):
                if now is None or conv_id != now.id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if not is_row:
                    first = True  # the row after this mark is the first with its role and text
                    continue
                for _ in range(times):
                    now.add(turn, role, text, code, first)
                    first = False
            if len(done) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def repair(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits that make its roles fit, and the sha256 of the repaired rows.

    Rows are taken by turn (nulls first), then role, then the md5 of role and text; a null role or text
    reads as one space. ``times`` says how often a row stands there (0: it only makes its
    conversation appear). A null conv_id is a conversation of its own. Rows that are repeated
    are duplicates of the first. A conversation without rows has zeros, an empty audit and the hash
    of the empty string; an empty table gives an empty one. Other columns, whatever their names, take no part.

    Texts are shuffled once. The first row of each role and text is found from hashes by an
    aggregate that combines before its shuffle, and arrives as a mark before that row. A conversation is a
    stream in one task, since its digest is one chain; the task holds the rows on which
    the survivors differ (``most_unresolved``, at most; their texts up to ``UNRESOLVED`` bytes) and the edits.
    """
    clean = F.rtrim(F.col("text"), F.lit(_BLANKS))
    initial = F.substring("role", 1, 1)
    data = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.lit(1) if times is None else times).cast("int").alias("times"))
    data = data.withColumn("code", F.concat(
        F.when(initial.isin(*INITIALS), initial).otherwise("-"),
        F.when(clean == "", "b").when(F.right(clean, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")))
    data = data.withColumn("hash", F.unhex(F.md5(F.concat_ws(":", "role", "text").cast("binary"))))
    marks = data.where("times > 0").select("conv", "role", "hash", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"))
    marks = marks.groupBy("conv", "role", "hash").agg(F.min("at").alias("at"))
    none = F.lit(None)
    marks = marks.select("conv", F.col("at.turn").alias("turn"), "role", "hash", F.lit(False).alias("is_row"), none.cast("string").alias("text"),
                         none.cast("string").alias("code"), none.cast("int").alias("times"))
    both = data.select("conv", "turn", "role", "hash", F.lit(True).alias("is_row"), "text", "code", "times").unionByName(marks)
    both = both.repartition("conv").sortWithinPartitions("conv", "turn", "role", "hash", "is_row").drop("hash")
    empty = rows.sparkSession.createDataFrame([], RESULT.format(id=dict(rows.dtypes)[conv_id])).schema
    return both.mapInArrow(_repair_stream(to_arrow_schema(empty)), empty).withColumnRenamed("conv_id", conv_id)


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults made by crc32 of ``conv_id:turn`` modulo 20, and how often each row stands there."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    case = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    out = rows.select("conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"),
                      F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                      F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("times"))
    return out, F.col("times")
