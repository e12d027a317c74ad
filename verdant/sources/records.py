"""Records of delimited text whose quoted fields may hold line breaks, read in splits.

A split can't know whether its first line begins within quotes. Every line is
therefore a function of two states (outside or inside a quoted field): it
keeps the state, flips it, or ends in one state whatever came before. (1) A
first pass composes these functions over each split; (2) the functions of a
file's splits, in order, give the state in which each split starts (a row per
split); (3) each split then joins its own lines to records from its first true
record on. What is left over, at most two pieces of a record per split, meets by file
and record. No task reads more than its split, however large the file.

The state runs along the lines of a split in order, which no column expression
can say; those two passes are Arrow maps, the first over flags only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A longer record is an error: a quote was opened and never closed.
MAX_RECORD_BYTES = 64 << 20
WHOLE, HEAD, INNER, TAIL = 0, 1, 2, 3
_LOW_BITS = (1 << 33) - 1


def escaped(sep: str) -> str:
    """A delimiter within a regular expression."""
    return "\\t" if sep == "\t" else "\\" + sep if sep in "|.^$*+?()[]{}\\-" else sep


def path_key(path: str) -> Column:
    """A file's path as a number (one form for file:/ and file:///, blanks escaped or not)."""
    plain = F.regexp_replace(F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/"), "%20", " ")
    return F.xxhash64(plain)


def text_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Lines in the order of their split: ``value, _file, _block, _place`` and
    whether a field opens and stays open if the line starts outside quotes
    (``opens``) and inside them (``stays``)."""
    s = escaped(sep)
    quoted = r'"[^"]*+(?:""[^"]*+)*+"[^%s]*+' % s
    rest = r'(?:%s(?:%s|[^"%s][^%s]*+|))*+$' % (s, quoted, s, s)
    outside = r'^(?:%s|[^"%s][^%s]*+|)%s' % (quoted, s, s, rest)
    inside = r'^[^"]*+(?:""[^"]*+)*+"[^%s]*+%s' % (s, rest)
    has = F.instr("value", '"') > 0
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"), "value", path_key("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    return lines.select(
        "value", "_file", "_block", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias("_place"),
        (has & ~F.col("line").rlike(outside)).alias("opens"), (~has | ~F.col("line").rlike(inside)).alias("stays"))


def any_open_quotes(lines: DataFrame) -> bool:
    return bool(lines.where("opens").select(F.lit(1)).limit(1).collect())


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, block, first row, end row) of the splits in a batch."""
    file, block = batch.column("_file").to_numpy(), batch.column("_block").to_numpy()
    if len(file):
        begin = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])]))
        for lo, hi in zip(begin, [*begin[1:], len(file)]):
            yield int(file[lo]), int(block[lo]), int(lo), int(hi)


def _flags(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))


def _along(opens: np.ndarray, stays: np.ndarray, start: bool) -> np.ndarray:
    """State after each line: that of the last line which ends in one state
    whatever came before, flipped as often as lines since then flip it."""
    n = len(opens)
    fixed, flips = opens == stays, np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
    at = np.maximum(last, 0)
    base = np.where(last >= 0, opens[at], start)
    since = np.where(last >= 0, flips - flips[at], flips) if n else flips
    return base ^ (since % 2 == 1)


def _split_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its end state from either start."""
    now, ends = None, (False, True)
    rows = []
    for batch in batches:
        for file, block, lo, hi in _runs(batch):
            if (file, block) != now:
                if now:
                    rows.append((*now, *ends))
                now, ends = (file, block), (False, True)
            opens, stays = _flags(batch, lo, hi)
            ends = tuple(bool(_along(opens, stays, e)[-1]) for e in ends)
    if now:
        rows.append((*now, *ends))
    cols = list(zip(*rows)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
                                     names=["_file", "_block", "from_out", "from_in"])


def split_starts(lines: DataFrame) -> DataFrame:
    """``_file, _block, inside``: the state in which each split starts."""
    of = lines.select("_file", "_block", "opens", "stays").mapInArrow(
        _split_functions, "_file bigint, _block bigint, from_out boolean, from_in boolean")
    # A task may hold a split in pieces only if Spark cut it: each piece has its own block.
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_out") == F.col("from_in")
    flips = of.withColumn("flip", (F.col("from_out") & ~F.col("from_in")).cast("int"))
    upto = Window.partitionBy("_file").orderBy("_block")
    flips = flips.withColumn("flips", F.sum("flip").over(upto))
    last = F.last(F.when(fixed, F.struct("from_out", "flips")), ignorenulls=True).over(before)
    placed = flips.withColumn("last", last).withColumn("before", F.coalesce(F.sum("flip").over(before), F.lit(0)))
    odd = (F.col("before") - F.coalesce(F.col("last.flips"), F.lit(0))) % 2 == 1
    return placed.select("_file", "_block", (F.coalesce(F.col("last.from_out"), F.lit(False)) != odd).alias("inside"))


class _Split:
    """Joins the lines of one split, handed over in pieces, to records."""

    def __init__(self, file: int, block: int, inside: bool):
        self.file, self.block, self.state = file, block, inside
        self.kind = INNER if inside else HEAD  # of the open piece, if any
        self.header = block == 0  # still to come
        self.open: list[str] = []
        self.place = self.bytes = 0

    def _out(self, text: str, place: int, part: int):
        if not text.strip() and part == WHOLE:
            return None
        if self.header:  # the file's first record
            self.header = False
            return None if part == WHOLE else (text, self.file, self.block, place, -part)
        return text, self.file, self.block, place, part

    def take(self, texts: list[str], places: np.ndarray, opens: np.ndarray, stays: np.ndarray) -> Iterator[tuple]:
        after = _along(opens, stays, self.state)
        for text, place, inside in zip(texts, places.tolist(), after.tolist()):
            if not self.state:
                self.open, self.kind, self.place, self.bytes = [], HEAD, place, 0
            self.open.append(text)
            self.bytes += len(text)
            if self.bytes > MAX_RECORD_BYTES:
                raise ValueError(f"a quoted field of more than {MAX_RECORD_BYTES} bytes: a quote is not closed")
            if not inside:
                if row := self._out("\n".join(self.open), self.place, TAIL if self.kind == INNER else WHOLE):
                    yield row
                self.open, self.kind = [], HEAD
            self.state = inside

    def end(self) -> Iterator[tuple]:
        if self.open and (row := self._out("\n".join(self.open), self.place, self.kind)):
            yield row


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string()), ("_file", pa.int64()), ("_block", pa.int64()), ("_place", pa.int64()),
                        ("part", pa.int32())])
    split = None

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    for batch in batches:
        rows = []
        for file, block, lo, hi in _runs(batch):
            if split is None or (split.file, split.block) != (file, block):
                if split is not None:
                    rows += split.end()
                split = _Split(file, block, batch.column("inside")[lo].as_py())
            rows += split.take(batch.column("value").slice(lo, hi - lo).to_pylist(),
                               batch.column("_place").slice(lo, hi - lo).to_numpy(), *_flags(batch, lo, hi))
        yield made(rows)
    if split is not None:
        yield made(list(split.end()))


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``record, _file, _block, _place`` of every record but each file's first
    (its header). Blank records are left out, and so is a last record whose
    quote never closes. A record longer than MAX_RECORD_BYTES is an error."""
    lines = text_lines(spark, path, sep)
    joined = lines.join(split_starts(lines).withColumnsRenamed({"_file": "_f", "_block": "_b"}),
                        (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).drop("_f", "_b")
    # In order again, should Spark have shuffled for the join; nothing is moved if it has not.
    joined = joined.sortWithinPartitions("_file", "_block", "_place")
    parts = joined.select("value", "_file", "_block", "_place", "opens", "stays", "inside").mapInArrow(
        _join_lines, "record string, _file bigint, _block bigint, _place bigint, part int")
    whole = parts.where(f"part = {WHOLE}").drop("part")
    # A split's tail comes before its head; a piece of a header is negative.
    pieces = parts.where(f"part != {WHOLE}").withColumn("kind", F.abs("part"))
    order = Window.partitionBy("_file").orderBy("_block", F.col("kind") == HEAD)
    pieces = pieces.withColumn("n", F.sum((F.col("kind") == HEAD).cast("int")).over(order))
    crossing = pieces.groupBy("_file", "n").agg(
        F.array_sort(F.collect_list(F.struct("_block", "record"))).alias("p"), F.sum(F.length("record")).alias("bytes"),
        F.min_by("_block", F.struct("_block")).alias("_block"), F.min_by("_place", F.struct("_block")).alias("_place"),
        F.max((F.col("kind") == TAIL).cast("int")).alias("closed"), F.min("part").alias("least"))
    too_long = F.raise_error(F.lit(f"a quoted field of more than {MAX_RECORD_BYTES} bytes: a quote is not closed"))
    text = F.when(F.col("bytes") > MAX_RECORD_BYTES, too_long.cast("string")).otherwise(
        F.array_join(F.transform("p", lambda x: x["record"]), "\n"))
    crossing = crossing.where("closed = 1 AND least > 0").select(text.alias("record"), "_file", "_block", "_place")
    return whole.unionByName(crossing)
