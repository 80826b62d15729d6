"""Repair of conversation structure by the cheapest edits, streamed.

Rows are dealt out by conversation and sorted by turn within a task, so a task sees every conversation in order and
holds one state: the costs of four positions of the role pattern. Each row adds one word of back pointers. Rows and
pointers of the conversation at hand are spooled, in memory while it is small and in an unnamed file of the task
beyond that, and are read back once its end is known. So a task's memory does not depend on a conversation's length.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Costs of the edits; a truncated row that stays adds one.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: Bytes of one conversation that are held in memory, and rows of pointers that are walked back at a time.
SPOOL, BLOCK = 8 << 20, 1 << 16
#: Edits in one batch of output.
ROWS = 4096

#: Positions: 0 before everything, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_DONE = (0, 3)
_NAME = {2: "user", 3: "assistant"}
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_FAR = 1 << 60
_OPS = "DKR"

_EDIT = pa.schema([
    ("conv_id", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()),
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
])
_EDIT_DDL = (
    "conv_id BIGINT, edit STRING, turn BIGINT, role STRING, text STRING, fault STRING, "
    "gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT"
)
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPORT_DDL = "conv_id BIGINT, " + ", ".join(f"{c} BIGINT" for c in _COUNTS) + ", audit STRING, repaired_sha256 STRING"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20; lost rows only name their conversation.

    0 loses the row, 1 empties the text, 2 takes its ``.!?`` away, 3 repeats the row, 4 makes the role user. A null is
    one blank, in the role, the text and what is hashed.
    """
    blank = F.lit(" ")
    hashed = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(hashed.cast("binary")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), times.alias("_one")).drop("_one")


class _Steps:
    """The cheapest ways one row further, of equal cost the one whose letters come first.

    No way to a position after a row is the beginning of a way to another one, so their letters are in a strict order,
    and it is enough to carry each position's rank. States repeat, so steps are remembered.
    """

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def take(self, costs: tuple, ranks: tuple, kind: tuple) -> tuple[tuple, tuple, int, int]:
        """Costs less their minimum, ranks, pointers of the four positions, and that minimum."""
        got = self.known.get((costs, ranks, kind))
        if got is None:
            got = self.known[costs, ranks, kind] = self._step(costs, ranks, *kind)
        return got

    def _step(self, costs, ranks, initial, must_go, cut):
        best: list = [None] * 4
        for x in range(4):
            if costs[x] >= _FAR:
                continue
            y, added = x, ""
            for k in range(3):
                ways = [("D", y, COST["D"])]
                if not must_go:
                    if (y, initial) in _KEEP:
                        ways.append(("K", _KEEP[y, initial], COST["K"] + cut))
                    ways.append(("R", _NEXT[y], COST["R"] + cut))
                for op, to, cost in ways:
                    way = (costs[x] + k * COST["I"] + cost, ranks[x], added + op, x, k, _OPS.index(op))
                    if best[to] is None or way < best[to]:
                        best[to] = way
                y, added = _NEXT[y], added + "I"
        least = min(w[0] for w in best if w)
        order = sorted((w[1], w[2], to) for to, w in enumerate(best) if w)
        rank = {to: i for i, (_, _, to) in enumerate(order)}
        pointers = sum((w[3] | w[4] << 2 | w[5] << 4) << (6 * to) for to, w in enumerate(best) if w)
        return tuple(w[0] - least if w else _FAR for w in best), tuple(rank.get(to, 9) for to in range(4)), pointers, least


class _Conversation:
    """The rows of one conversation so far, spooled, and the state after the last of them."""

    def __init__(self, conv_id: int | None, steps: _Steps):
        self.conv_id, self.steps, self.n = conv_id, steps, 0
        self.costs, self.ranks, self.base = (0, _FAR, _FAR, _FAR), (0, 9, 9, 9), 0
        self.rows, self.pointers, self.tail = tempfile.SpooledTemporaryFile(SPOOL), tempfile.SpooledTemporaryFile(SPOOL), array("I")
        self.count = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.n and self.initial + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.initial = initial
        if fault:
            self.count[fault] += 1
        kind = (initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), int(fault == "truncated"))
        self.costs, self.ranks, pointers, least = self.steps.take(self.costs, self.ranks, kind)
        self.base += least
        self.tail.append(pointers)
        if len(self.tail) == BLOCK:
            self._flush()
        pickle.dump((turn, role, text, fault), self.rows)
        self.n += 1

    def _flush(self) -> None:
        self.pointers.write(self.tail.tobytes())
        self.tail = array("I")

    def _walk_back(self, at: int) -> tempfile.SpooledTemporaryFile:
        """The inserts and the edit of every row, one byte each, from the position after the last row."""
        self._flush()
        chosen = tempfile.SpooledTemporaryFile(SPOOL)
        for start in range((self.n - 1) // BLOCK * BLOCK if self.n else 0, -1, -BLOCK):
            rows = min(BLOCK, self.n - start)
            block = array("I")
            self.pointers.seek(4 * start)
            block.frombytes(self.pointers.read(4 * rows))
            out = bytearray(rows)
            for i in range(rows - 1, -1, -1):
                way = block[i] >> (6 * at) & 63
                out[i] = way >> 2
                at = way & 3
            chosen.seek(start)
            chosen.write(bytes(out))
        chosen.seek(0)
        return chosen

    def edits(self) -> Iterator[tuple]:
        """edit, turn, role, text, fault in order; the counts are whole after the last one."""
        ends = []
        for x in range(4):
            y = x
            for k in range(3):
                if self.costs[x] < _FAR and y in _DONE:
                    ends.append((self.costs[x] + k * COST["I"], self.ranks[x], k, x))
                y = _NEXT[y]
        cost, _, more, x = min(ends)
        self.count["cost"] = self.base + cost
        if self.low is not None:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        chosen, at = self._walk_back(x), 0
        self.rows.seek(0)
        for way in chain.from_iterable(iter(lambda: chosen.read(BLOCK), b"")):
            for _ in range(way & 3):
                at = _NEXT[at]
                yield "I", None, _NAME[at], "", None
            turn, role, text, fault = pickle.load(self.rows)
            op = _OPS[way >> 2]
            if op == "K":
                at = _KEEP[at, role[:1]]
            elif op == "R":
                at = _NEXT[at]
                role = _NAME[at]
            yield op, turn, role, text, fault
        for _ in range(more):
            at = _NEXT[at]
            yield "I", None, _NAME[at], "", None
        for file in (chosen, self.rows, self.pointers):
            file.close()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, now, out = _Steps(), None, []

    def finish(of: _Conversation) -> Iterator[tuple]:
        for edit in of.edits():
            yield (of.conv_id, *edit, *[None] * 6)
        yield (of.conv_id, *[None] * 5, *of.count.values())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDIT)], schema=_EDIT)

    for batch in chain(batches, [None]):
        rows = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))) if batch is not None else [(0, 0, None, None, None, None)]
        for conv_id, turn, role, text, fault, lost in rows:
            end = lost is None
            if now is not None and (end or conv_id != now.conv_id):
                for row in finish(now):
                    out.append(row)
                    if len(out) == ROWS:
                        yield packed(out)
                        out = []
                now = None
            if end:
                continue
            now = now or _Conversation(conv_id, steps)
            if not lost:
                now.add(turn, role, text, fault)
    if out:
        yield packed(out)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text, fault in order, then a row without an edit that has the counts of the conversation.

    turns: conv_id, turn, role, text, lost, as ``damage`` gives them. Rows are taken by turn (null first), then role
    and text. The first fault of a row counts: blank without a character that is no ASCII white space, duplicate if
    role and text stood earlier, truncated if its last such character is none of ``.!?``. Edits: K keeps a row, R
    gives it the role user or assistant, D deletes it (always for blank and duplicate ones), I inserts an empty user or
    assistant turn; K, R and I together form the repaired conversation, whose role initials match ``(s?(ua)+)?``. Of
    the cheapest edits, those whose letters come first are taken. gaps are turn numbers missing between the first and
    the last, illegal are neighbours whose role initials are none of su, ua, au. A null conv_id is a conversation of its
    own, a null role or text is empty. Further columns are not looked at.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), "lost").repartition("conv_id")
    # The same partitioning serves this window: every row of a conversation is in the task already.
    earlier = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("nth", F.row_number().over(earlier))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("nth") > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    rows = rows.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
    return rows.select("conv_id", "turn", "role", "text", "fault", "lost").mapInArrow(_repair, _EDIT_DDL)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, state, empty = [], hashlib.sha256(), True
    for batch in batches:
        out = []
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for i, edit in enumerate(columns["edit"]):
            if edit is None:
                out.append((columns["conv_id"][i], *[columns[c][i] for c in _COUNTS], "".join(audit), state.hexdigest()))
                audit, state, empty = [], hashlib.sha256(), True
                continue
            audit.append(edit)
            if edit != "D":
                state.update(f"{'' if empty else chr(10)}{columns['role'][i]}:{columns['text'][i]}".encode())
                empty = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPORT)], schema=_REPORT)


def report(edits: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the edits of ``repair``, in the same tasks.

    audit has the letters of the edits, repaired_sha256 is that of the repaired rows as ``role:text``, joined by newlines.
    """
    return edits.mapInArrow(_summed, _REPORT_DDL)
