"""Conversations damaged by rule, checked, and repaired with the cheapest edits.

The edits of a conversation form a path through (turn, role state), the states
being: nothing yet, after a system turn, after a user turn, after an assistant
turn. Costs-to-go are swept backward, but vectors are kept only at every
sqrt(n)-th turn; walking forward, each block's vectors are computed again from
the checkpoint behind it, and the walk takes the ASCII-least edit that is tight.
A letter fixes the next state, so the letters determine the repaired turns.

A conversation is one sequence: its turns meet in one task, sorted on disk, and
stream through it. Memory holds one byte and one 16-byte digest a turn, the
checkpoints, and 16 MB of text; longer conversations spool their texts to a
temporary file of the task that ends with the conversation.

Defined results: nulls are spelled as one space, in the damage key too; a null
conv_id is a conversation of its own; turns with equal numbers are ordered by
role, then text; repeated rows are turns too, later ones duplicates. A
conversation without turns after damage costs nothing. An empty table gives no
rows. Columns beyond the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}                       # adjacent role initials su, ua, au
FOLLOWS = (USER, USER, ASSISTANT, USER)                # the role that an insertion or a rerole gives in each state
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, LEFT_TRUNCATED = 3, 2, 2, 1
END = (0, 4, 2, 0)                                     # costs-to-go of the states after the last turn
SPOOL_BYTES = 16 << 20
FLUSH = 4096

SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
TURNS = "conv_id long, position long, edit string, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) after damage; a dropped row stays as a trace with ``there`` false."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    text = (F.when(code == 1, "").when(code == 2, F.regexp_replace(spelled("text"), "[.!?]", ""))
            .when(code != 0, spelled("text")))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, "user").when(code != 0, spelled("role")).alias("role"), text.alias("text"),
        (code != 0).alias("there"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that ``repairs`` and ``repaired_turns`` take."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                spelled("role"), spelled("text"), F.lit(True).alias("there"))


# --- one conversation ---------------------------------------------------------

def _moves(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the (letter, cost, next state) that use up a turn of this role and fault, in ASCII order."""
    role, fault = divmod(code, 4)
    extra = LEFT_TRUNCATED * (fault == TRUNCATED)
    out = []
    for state in range(4):
        moves = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            if role + 1 == FOLLOWS[state] or (state == START and role == 0):
                moves.append(("K", extra, role + 1))
            moves.append(("R", REROLE + extra, FOLLOWS[state]))
        out.append(moves)
    return out


MOVES = [_moves(code) for code in range(16)]


def _before(code: int, after: tuple) -> tuple:
    """Costs-to-go in front of a turn from those behind it."""
    s, y, u, a = (min(cost + after[to] for _, cost, to in moves) for moves in MOVES[code])
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(s, INSERT + u), min(y, INSERT + u), u, a


def cheapest(codes: bytes) -> Iterator[tuple[str, int]]:
    """The (letter, state reached) of the ASCII-least cheapest edits; the first item is ("", cost)."""
    n = len(codes)
    step = math.isqrt(n) + 1
    kept, vector = {}, END
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0:
            kept[i + 1] = vector
        vector = _before(codes[i], vector)
    yield "", vector[START]
    state, first = START, 0
    while first < n:
        last = min(first + step, n)
        block = [END if last == n else kept[last]]
        for i in range(last - 1, first - 1, -1):
            block.append(_before(codes[i], block[-1]))
        block.reverse()
        i = first
        while i < last:
            here, after = block[i - first], block[i - first + 1]
            insertion = ("I", INSERT, FOLLOWS[state])
            for letter, cost, to in sorted([*MOVES[codes[i]][state], insertion]):
                if cost + (here if letter == "I" else after)[to] == here[state]:
                    break
            state = to
            i += letter != "I"
            yield letter, state
        first = last
    while END[state]:
        state = FOLLOWS[state]
        yield "I", state


class _Texts:
    """A queue of (role, text) of one conversation; beyond a size it lies in a temporary file."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)

    def put(self, role: str, text: str) -> None:
        role, text = role.encode(), text.encode()
        self.file.write(struct.pack("<QQ", len(role), len(text)) + role + text)

    def read(self) -> Iterator[tuple[str, str]]:
        self.file.seek(0)
        while head := self.file.read(16):
            role, text = struct.unpack("<QQ", head)
            yield self.file.read(role).decode(), self.file.read(text).decode()

    def clear(self) -> None:
        if self.file.tell() > SPOOL_BYTES:
            self.file.close()
            self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        else:
            self.file.seek(0)
            self.file.truncate()


def _role(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


class _Conversation:
    """What is gathered of the conversation that is streaming by."""

    def __init__(self):
        self.texts = _Texts()
        self.start(None)

    def start(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.seen = conv_id, bytearray(), set()
        self.turns, self.lowest, self.highest = 0, None, None
        self.faults, self.illegal = [0] * 4, 0
        self.texts.clear()

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.highest:
            self.turns, self.highest = self.turns + 1, turn
            self.lowest = turn if self.lowest is None else self.lowest
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        bare = text.rstrip(BLANKS)
        fault = (BLANK if not bare else DUPLICATE if digest in self.seen
                 else NO_FAULT if bare[-1] in ".!?" else TRUNCATED)
        self.seen.add(digest)
        kind = _role(role)
        if self.codes:
            self.illegal += (self.codes[-1] // 4, kind) not in LEGAL
        self.codes.append(4 * kind + fault)
        self.faults[fault] += 1
        self.texts.put(role, text)

    def repaired(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) in order; deleted turns have neither."""
        edits, turns = cheapest(bytes(self.codes)), self.texts.read()
        next(edits)
        for letter, state in edits:
            role, text = next(turns) if letter != "I" else (None, "")
            if letter == "D":
                role = text = None
            elif letter != "K":
                role = NAMES[state]
            yield letter, role, text

    def summary(self) -> tuple:
        cost = next(cheapest(bytes(self.codes)))[1] if self.codes else 0
        digest, audit, first = hashlib.sha256(), [], True
        for letter, role, text in self.repaired() if self.codes else ():
            audit.append(letter)
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
                cost, "".join(audit), digest.hexdigest())


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[_Conversation]:
    """Each conversation of a sorted partition, complete."""
    now, open_ = _Conversation(), False
    for batch in batches:
        for conv_id, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_ or conv_id != now.conv_id:
                if open_:
                    yield now
                now.start(conv_id)
                open_ = True
            if there:
                now.add(turn, role, text)
    if open_:
        yield now


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _in_order(rows: DataFrame) -> DataFrame:
    return (rows.select("conv_id", "turn", "role", "text", "there").repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"))


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired turns."""
    schema = _arrow(SUMMARY)

    def run(batches):
        yield from _batched((c.summary() for c in _stream(batches)), schema)
    return _in_order(rows).mapInArrow(run, SUMMARY)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: (conv_id, position, edit, role, text), positions from 0."""
    schema = _arrow(TURNS)

    def turns(batches):
        for c in _stream(batches):
            kept = (x for x in c.repaired() if x[1] is not None) if c.codes else ()
            for position, (letter, role, text) in enumerate(kept):
                yield c.conv_id, position, letter, role, text

    def run(batches):
        yield from _batched(turns(batches), schema)
    return _in_order(rows).mapInArrow(run, TURNS)
