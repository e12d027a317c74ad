"""Conversation structure repair by a square-root checkpointed DP.

Repairing turns a conversation's turns into role initials ``(s?(ua)+)?`` by the
cheapest edits: Keep 0, Rerole 3, Delete 4 (required for blank and duplicate
turns), Insert 3, and 3 more for a truncated turn that stays. Four states (nothing yet, after
s, after u, after a) and one backward cost vector per turn decide it.

Plan. Damage, faults and the first occurrence of a text are column
expressions; equal turns are counted before anything else is shuffled, and the first
occurrence comes from partial minima, joined on keys that are unique on both
sides. Then each conversation is streamed through its task in order, twice
from one sorted shuffle: first one byte per turn (fault and role), then the
turns with their texts. Between the two the backward pass keeps the cost
vectors of every k-th turn only, k being the square root of the turns; walking
forward, each block's vectors are computed again from its checkpoint, and the ASCII-least
tight edit is taken. A task holds a byte and a letter per turn of one
conversation (the letters are the result) and one batch of texts, never a
conversation's texts; a text's digest is sequential by nature, so a
conversation is not split further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK = r"[^\x20\x09-\x0D]"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state behind an inserted or reroled turn, and its role.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: State behind a kept turn by state and initial (s, u, a, other); None: not allowed.
_KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: Of a turn's code: initial in bits 0-1, delete only in bit 2, truncated in bit 3.
_DELETE_ONLY, _SHORT = 4, 8
_NEVER = 1 << 60
#: Role of a reroled turn by the state behind it.
_REROLED = {2: "user", 3: "assistant"}
#: Adjacent initials su, ua, au.
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs with inserted turns before the next one (two at most are useful)."""
    for _ in range(2):
        v = [min(c, INSERT + v[_NEXT[q]]) for q, c in enumerate(v)]
    return tuple(v)


_END = _closed([0, _NEVER, _NEVER, 0])


def _options(code: int, q: int, after: tuple[int, ...]) -> tuple[int, int, int]:
    """Costs of deleting, keeping and reroling a turn in state ``q``."""
    gone = DELETE + after[q]
    if code & _DELETE_ONLY:
        return gone, _NEVER, _NEVER
    short = TRUNCATED if code & _SHORT else 0
    kept = _KEEP[q][code & 3]
    return gone, _NEVER if kept is None else short + after[kept], short + REROLE + after[_NEXT[q]]


def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return _closed([min(_options(code, q, after)) for q in range(4)])


class Repair:
    """Cheapest edits of one conversation: ``cost`` from the backward pass, then
    ``step()`` for each turn in order and ``rest()`` at the end."""

    def __init__(self, codes: bytes | bytearray):
        self.codes, self.block = codes, max(isqrt(len(codes)), 1)
        self.checkpoints, v = {len(codes): _END}, _END
        for i in range(len(codes) - 1, -1, -1):
            v = _before(codes[i], v)
            if i % self.block == 0:
                self.checkpoints[i] = v
        self.cost, self.state, self.at = v[0], 0, 0
        self.held: list[tuple[int, ...]] = []

    def _after(self, i: int) -> tuple[int, ...]:
        """Cost vector of position ``i``, from the block's vectors computed again."""
        lo = (self.at // self.block) * self.block
        if not self.held or self.at == lo:
            hi = min(lo + self.block, len(self.codes))
            self.held = [self.checkpoints[hi]]
            for k in range(hi - 1, lo - 1, -1):
                self.held.append(_before(self.codes[k], self.held[-1]))
            self.held.reverse()
        return self.held[i - lo]

    def step(self) -> tuple[list[str], str]:
        """Roles of the turns inserted before the next turn and, as letters in
        their ASCII-least order, all edits up to that turn's own."""
        code, inserted, letters = self.codes[self.at], [], ""
        here, after = self._after(self.at), self._after(self.at + 1)
        while True:
            gone, kept, reroled = _options(code, self.state, after)
            left = here[self.state]
            if gone == left:
                letters += "D"
            elif left == INSERT + here[_NEXT[self.state]]:
                inserted.append(_ROLE[self.state])
                letters += "I"
                self.state = _NEXT[self.state]
                continue
            elif kept == left:
                letters, self.state = letters + "K", _KEEP[self.state][code & 3]
            else:
                letters, self.state = letters + "R", _NEXT[self.state]
            self.at += 1
            return inserted, letters

    def rest(self) -> list[str]:
        """Roles of the turns inserted behind the last one."""
        roles = []
        while _END[self.state]:
            roles.append(_ROLE[self.state])
            self.state = _NEXT[self.state]
        return roles


# --- turns and their faults ---------------------------------------------------

def damaged(turns: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, text after damage by crc32(``conv_id:turn``) % 20
    (a null counts as one space there and as role or text): 0 drops the turn, 1
    empties its text, 2 takes ``.!?`` out of it, 3 gives it twice, 4 makes it the
    user's. ``copies`` is the number of times the row stands there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """Equal turns as one row with ``copies``, whether their text is the first
    of its role in the conversation, and the code of the first copy."""
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    same = ["conv_id", "turn", "role", "digest"]
    once = keyed.groupBy(*same).agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    # A null turn comes first.
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = (keyed.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("least"))
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                     F.col("least.turn").alias("t"), F.lit(True).alias("is_first")))
    found = once.join(first, once["conv_id"].eqNullSafe(first["c"]) & once["turn"].eqNullSafe(first["t"])
                      & (once["role"] == first["r"]) & (once["digest"] == first["d"]), "left")
    words = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5))
    blank = ~F.col("text").rlike(BLANK)
    initial = (F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1)
               .when(F.col("role").startswith("a"), 2).otherwise(3))
    fault = (F.when(blank, "b").when(F.col("is_first").isNull(), "d")
             .when(~F.substring(words, -1, 1).isin(".", "!", "?"), "t").otherwise(""))
    return found.select("conv_id", "turn", "role", "text", "digest", "copies", initial.alias("initial"), fault.alias("fault"))


# --- the stream ---------------------------------------------------------------

_COLUMNS = ["conv_id", "phase", "turn", "role", "text", "copies", "initial", "fault"]


def _stream(turns: DataFrame, damage: bool) -> DataFrame:
    """Each conversation's marker (phase 0), its turns without texts (1) and
    with texts (2), in one task and in order. Markers keep conversations of
    which no turn is left."""
    rows = _faults(damaged(turns) if damage else turns.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.lit(1).cast("long").alias("copies")))
    turn_type = dict(turns.dtypes)["turn"]
    marker = turns.select("conv_id").distinct().selectExpr(
        "conv_id", "0 AS phase", f"CAST(NULL AS {turn_type}) AS turn", "'' AS role", "'' AS text", "0L AS copies",
        "3 AS initial", "'' AS fault", "'' AS digest")
    both = rows.select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("phase"), "turn", "role", "text", "copies",
                       "initial", "fault", "digest").withColumn("text", F.when(F.col("phase") == 2, F.col("text")).otherwise(""))
    return (marker.unionByName(both).repartition("conv_id")
            .sortWithinPartitions("conv_id", "phase", F.asc_nulls_first("turn"), "role", "digest").select(*_COLUMNS))


class Walk:
    """One conversation's rows, taken in order; ``emit(conv_id, edit, turn, role,
    text)`` gets the turns of the repaired conversation as they come."""

    def __init__(self, conv_id, emit: Callable):
        self.conv_id, self.emit = conv_id, emit
        self.codes, self.initials, self.letters = bytearray(), bytearray(), []
        self.repair: Repair | None = None
        self.least = self.most = None
        self.distinct = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}

    def take(self, phase: int, turn, role: str, text: str, copies: int, initial: int, fault: str) -> None:
        if phase == 1:
            self.faults[fault] += 1
            self.faults["b" if fault == "b" else "d"] += copies - 1
            self.codes.append(initial | (_DELETE_ONLY if fault in ("b", "d") else 0) | (_SHORT if fault == "t" else 0))
            self.codes.extend(bytes([initial | _DELETE_ONLY]) * (copies - 1))
            self.initials.extend(bytes([initial]) * copies)
            if turn is not None and turn != self.most:
                self.least = turn if self.least is None else self.least
                self.most, self.distinct = turn, self.distinct + 1
        elif phase == 2:
            self.repair = self.repair or Repair(self.codes)
            for _ in range(copies):
                inserted, letters = self.repair.step()
                self.letters.append(letters)
                for name in inserted:
                    self.emit(self.conv_id, "I", None, name, "")
                if letters[-1] == "K":
                    self.emit(self.conv_id, "K", turn, role, text)
                elif letters[-1] == "R":
                    self.emit(self.conv_id, "R", turn, _REROLED[self.repair.state], text)

    def end(self) -> tuple:
        """The conversation's report."""
        for name in self.repair.rest() if self.repair else ():
            self.letters.append("I")
            self.emit(self.conv_id, "I", None, name, "")
        illegal = sum(pair not in _LEGAL for pair in zip(self.initials, self.initials[1:]))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (self.conv_id, gaps, self.faults["b"], self.faults["d"], self.faults["t"], illegal,
                self.repair.cost if self.repair else 0, "".join(self.letters))


def _walked(batches: Iterator[pa.RecordBatch], emit: Callable) -> Iterator[tuple | None]:
    """Walks sorted rows: None after each row, a report after each conversation."""
    walk = None
    for batch in batches:
        for conv_id, *row in zip(*[batch.column(c).to_pylist() for c in _COLUMNS]):
            if walk is None or conv_id != walk.conv_id:
                if walk is not None:
                    yield walk.end()
                walk = Walk(conv_id, emit)
            walk.take(*row)
            yield None
    if walk is not None:
        yield walk.end()


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + size(row)
        if weight > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repair_report(turns: DataFrame, damage: bool = True) -> DataFrame:
    """One row for every conv_id of ``turns`` (a null one too): ``conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``turns`` (conv_id, turn bigint, role, text) are damaged first unless
    ``damage`` is false. They are taken by turn, nulls first, then by role
    and the text's SHA-256, so ties and repeated rows always come out alike;
    equal rows are duplicates of the first. A null role or text is one space: no initial of
    s, u, a, and blank. A conversation without turns has zeros, an empty audit
    and the digest of the empty text. An empty table gives an empty result;
    other columns are neither read nor returned."""
    schema = pa.schema([pa.field("conv_id", _arrow(turns, "conv_id")), *[(c, pa.int64()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = None

        def emit(_conv_id, _edit, _turn, role, text):
            nonlocal digest
            if digest is None:
                digest = hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())

        def rows():
            nonlocal digest
            for found in _walked(batches, emit):
                if found is not None:
                    yield (*found, (digest or hashlib.sha256()).hexdigest())
                    digest = None

        yield from _batches(rows(), schema, lambda r: len(r[7]))

    id_type = dict(turns.dtypes)["conv_id"]
    return _stream(turns, damage).mapInArrow(report, f"conv_id {id_type}, {REPORT}, repaired_sha256 string")


def repaired_turns(turns: DataFrame, damage: bool = False) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0), ``edit`` (K, R
    or I), ``turn`` (null if inserted), ``role, text``. Conversations of which
    nothing stays have no rows; nulls, ties and empty tables as in
    ``repair_report``."""
    schema = pa.schema([pa.field("conv_id", _arrow(turns, "conv_id")), ("place", pa.int64()), ("edit", pa.string()),
                        ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []

        def rows():
            place = 0
            for found in _walked(batches, lambda *turn: made.append(turn)):
                for conv_id, *turn in made:
                    yield (conv_id, place, *turn)
                    place += 1
                made.clear()
                if found is not None:
                    place = 0

        yield from _batches(rows(), schema, lambda r: len(r[5]))

    id_type = dict(turns.dtypes)["conv_id"]
    return _stream(turns, damage).mapInArrow(
        repaired, f"conv_id {id_type}, place bigint, edit string, turn bigint, role string, text string")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
