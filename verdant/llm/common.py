"""Shared pieces of the text operators: inputs, lineage cuts, checked
broadcasts, and word splitting and hashing over Arrow buffers with numpy."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.session import checkpoint_root

#: Rows up to which a small side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: Settings of Arrow batches: Spark's default and the bound set in its place.
ARROW_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
                "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}
#: Text bytes that a task turns into numpy arrays at once.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by
    ``spark.checkpoint.dir``: computes ``df`` once, cuts its lineage and
    survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (call on a
    cut table); otherwise unchanged, and the join shuffles both sides."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).collect()) <= limit else df


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1, ... so that names of an operator's
    own can't clash with them, and the new names of ``columns``; ``toDF`` with
    the old names at the end brings these back."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in columns]


# --- words ------------------------------------------------------------------

def _byte_table(pred) -> np.ndarray:
    return np.array([pred(b) for b in range(256)], dtype=bool)


#: Bytes of words ``[^\x20\x09-\x0D]+``; every byte of a non-ASCII character counts.
WORD_BYTES = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (applied after lower-casing A-Z).
ALNUM_BYTES = _byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_R = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POW.get(kind)
    if have is None or len(have) < n:
        base = _R if kind == "up" else pow(_R, -1, 1 << 64)
        seq = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        seq[0] = 1
        have = _POW[kind] = np.cumprod(seq, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def order_within(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by (group, value) for small whole groups in ascending order: one
    sort of 64-bit keys that hold the group and the value's high bits, and the
    exact two-key sort where those bits leave a tie between unequal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    bits = max(int(group[-1]).bit_length(), 1)
    key = (group.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits))
    order = np.argsort(key)
    sorted_key, sorted_value = key[order], value[order]
    if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_value[1:] != sorted_value[:-1])).any():
        return np.lexsort((value, group))
    return order


class Words(NamedTuple):
    row: np.ndarray    # row of each word, ascending
    start: np.ndarray  # byte positions in the chunk's data
    end: np.ndarray
    hash: np.ndarray   # uint64, equal for equal words everywhere


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hash of each span of bytes (or code points): differences
    of one running polynomial sum, shifted back to position 0, then mixed."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    terms = total[1:]
    terms[:] = data
    terms += np.uint64(1)
    terms *= _powers("up", n)[:n]
    np.cumsum(terms, out=terms)
    return mix((total[end] - total[start]) * _powers("down", n + 1)[start] + (end - start).astype(np.uint64))


def split_words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> Words:
    """Words of every row; no word crosses a row bound."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    first = bounds[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    last = bounds[1:]
    after[last[last > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    return Words(row, start, end, span_hashes(data, start, end))


def span_indices(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Indices of the elements of all spans, one span after the other."""
    size = end - start
    first = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return first + np.arange(len(first))


def text_array(col) -> pa.Array:
    """Column as large UTF-8 array; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_utf8())
    return pc.fill_null(col, "") if col.null_count else col


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds) over slices of about
    ``max_bytes``; one longer text is a slice of its own."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def shingles(words: Words, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each row, sorted by (row, hash):
    (hashes, row bounds). A row of fewer than k words, but not none, has one
    shingle of all its words; a row without words has none."""
    bounds = np.searchsorted(words.row, np.arange(rows + 1))
    count = np.diff(bounds)
    h = words.hash
    n = len(h) - k + 1
    row, hashed = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 0:
        acc = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            acc = acc * np.uint64(_R) + h[j:j + n]
        whole = words.row[:n] == words.row[k - 1:]
        row, hashed = words.row[:n][whole], acc[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        tail = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            tail[has] = tail[has] * np.uint64(_R) + h[(bounds[short] + j)[has]]
        row = np.concatenate([row, short])
        hashed = np.concatenate([hashed, tail + count[short].astype(np.uint64)])
    hashed = mix(hashed)
    if len(short):  # rows in ascending order again
        order = np.argsort(row, kind="stable")
        row, hashed = row[order], hashed[order]
    order = order_within(row, hashed)
    row, hashed = row[order], hashed[order]
    if len(row):
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
        row, hashed = row[keep], hashed[keep]
    return hashed, np.searchsorted(row, np.arange(rows + 1))


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers (once per
    context, by Spark's own file distribution), for sessions that were not
    started with it on their Python path, and bound what goes between Spark and
    a worker at once, unless the session has a bound of its own: whole texts
    in batches of Spark's default size take hundreds of megabytes of an executor."""
    import shutil
    import tempfile
    from pathlib import Path

    for name, (default, bound) in ARROW_BOUNDS.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, bound)
    sc = spark.sparkContext
    if not getattr(sc, "_verdant_shipped", False):
        package = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp(prefix="verdant-zip-"))
        sc.addPyFile(shutil.make_archive(str(made / package.name), "zip", package.parent, package.name))
        sc._verdant_shipped = True
    return spark
