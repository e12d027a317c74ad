"""Benchmark decontamination by suffix arrays over shards of the documents.

The benchmark is the query side: its words (ids of 64-bit word hashes) are
sent to all tasks in blocks of bounded size. Every task cuts its documents
into shards of a few hundred thousand words, builds the shard's suffix array and
binary-searches *every* benchmark suffix in it, one word deeper at a time,
until its interval is empty: that gives the longest verbatim match of each
suffix and, from the interval at window depth, all places of the window.
Suffixes with the same words up to their items' ends, such as equal short
answers, are searched once and stand for all items that hold them.
Documents are read once per block and never shuffled; with one block (the
usual case) a document's row is finished in its map task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import ALNUM_BYTES, LOWER, chunks, cut, span_hashes, span_indices, split_words, text_array

WINDOW = 10
#: Bytes of benchmark text broadcast at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 32 << 20
#: Text bytes of a shard (one longer document is a shard of its own).
SHARD_BYTES = 2 << 20
_ORDERED = 27  # words by which a shard's suffixes are ordered


class Block(NamedTuple):
    """Benchmark words, and its distinct suffixes: their first words, the words
    left in their items, whether that is the whole item, and the items of each."""
    hash: np.ndarray
    at: np.ndarray
    left: np.ndarray
    whole: np.ndarray
    items: np.ndarray   # item numbers, suffix by suffix
    first: np.ndarray   # of a suffix among them
    names: list         # item ids as strings


def _folded_words(texts: pa.Array, max_bytes: int):
    for lo, hi, data, bounds in chunks(texts, max_bytes):
        yield lo, hi, split_words(LOWER[data], bounds, ALNUM_BYTES)


def _block(names: list, texts: list) -> Block:
    hashes, items = [], []
    for lo, _, w in _folded_words(pa.array(texts, type=pa.large_utf8()), SHARD_BYTES):
        hashes.append(w.hash)
        items.append(w.row + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.concatenate(items) if items else np.zeros(0, np.int64)
    size = np.bincount(item, minlength=len(names))
    end = np.concatenate([[0], np.cumsum(size)])[item + 1]
    left = end - np.arange(len(h))
    whole = left == size[item]
    # A suffix is its words, and whether it is a whole item (short ones are windows then).
    digest = span_hashes(h, np.arange(len(h)), end) ^ whole.astype(np.uint64)
    _, at, group = np.unique(digest, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([group, item]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
    return Block(h, at, left[at], whole[at], pairs[1], np.searchsorted(pairs[0], np.arange(len(at) + 1)), names)


def suffix_array(ids: np.ndarray, stop: np.ndarray, depth: int = _ORDERED) -> np.ndarray:
    """Suffixes of ``ids`` (>= 1) ordered by at least their first ``depth``
    words: ranks of k words give ranks of 3k (2k in a shard too large for
    three ranks to share 63 bits). ``stop`` is the end of each position's document: what lies
    behind counts as 0, so no order or match crosses documents."""
    n = len(ids)
    at = np.arange(n)
    times, bits = (3, 21) if n < (1 << 21) - 1 else (2, 31)
    rank, k = ids.astype(np.int64), 1
    while k < depth and n:
        key = rank << (bits * (times - 1))
        for step in range(1, times):
            there = at + step * k
            ok = there < stop
            key[ok] |= rank[there[ok]] << (bits * (times - 1 - step))
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= times
        if new[-1] == n:
            break
    return np.argsort(rank, kind="stable")


def _search(ids, stop, sa, qids, at, left):
    """For each depth up to _ORDERED the query suffixes (words ``qids`` from
    ``at``, ``left`` of them) that still match and their intervals in ``sa``: the
    depth at which a suffix is last listed is its longest match (longer ones
    are followed place by place by the caller)."""
    n, m = len(sa), len(at)
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    live = np.flatnonzero(qids[at] > 0)
    intervals = {}
    for depth in range(_ORDERED):
        live = live[left[live] > depth]
        if not len(live):
            break
        want = qids[at[live] + depth]
        ends = []
        for upper in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (go := a < b).any():
                mid = (a + b) >> 1
                pos = sa[np.minimum(mid, n - 1)] + depth
                have = np.where(pos < stop[sa[np.minimum(mid, n - 1)]], ids[np.minimum(pos, n - 1)], 0)
                right = go & ((have <= want) if upper else (have < want))
                a = np.where(right, mid + 1, a)
                b = np.where(go & ~right, mid, b)
            ends.append(a)
        lo[live], hi[live] = ends
        live = live[(ends[0] < ends[1]) & (want > 0)]
        intervals[depth + 1] = (live, lo[live].copy(), hi[live].copy())
    return intervals


def _places(interval, sa):
    """All (query suffix, position) of an interval set, flat."""
    live, lo, hi = interval
    count = hi - lo
    which = np.repeat(live, count)
    first = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return which, sa[first + np.arange(len(which))]


def _shard_hits(words, rows: int, block: Block, window: int):
    """(row, first word, end word, suffix, longest match) of every occurrence."""
    h = words.hash
    if not len(h) or not len(block.hash):
        return [np.zeros(0, np.int64)] * 5
    vocabulary, ids = np.unique(h, return_inverse=True)
    ids = ids + 1
    bounds = np.searchsorted(words.row, np.arange(rows + 1))
    stop = bounds[words.row + 1]
    at = np.minimum(np.searchsorted(vocabulary, block.hash), len(vocabulary) - 1)
    qids = np.where(vocabulary[at] == block.hash, at + 1, 0)
    sa = suffix_array(ids, stop)
    intervals = _search(ids, stop, sa, qids, block.at, block.left)
    found = []
    for length in sorted(intervals):
        live = intervals[length][0]
        pick = block.left[live] >= window if length == window else block.whole[live] & (block.left[live] == length) & (length < window)
        if pick.any():
            which, pos = _places(tuple(x[pick] for x in intervals[length]), sa)
            found.append((which, pos, np.full(len(pos), length)))
    if not found:
        return [np.zeros(0, np.int64)] * 5
    which, pos, length = (np.concatenate(x) for x in zip(*found))
    # Longest verbatim match from each place, beyond the ordered depth too.
    longest, more = length.copy(), np.arange(len(pos))
    while len(more):
        q, p, d = which[more], pos[more], longest[more]
        ok = (d < block.left[q]) & (p + d < stop[p])
        more = more[ok]
        q, p, d = q[ok], p[ok], d[ok]
        more = more[qids[block.at[q] + d] == ids[p + d]]
        longest[more] += 1
    row = words.row[pos]
    first = pos - bounds[row]
    return [row, first, first + length, which, longest]


def _items_of(row: np.ndarray, suffix: np.ndarray, block: Block, rows: int) -> list[list[str]]:
    """Sorted distinct item ids of each row, from its distinct suffixes."""
    pairs = np.unique(np.stack([row, suffix]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    begin, end = block.first[pairs[1]], block.first[pairs[1] + 1]
    item, owner = block.items[span_indices(begin, end)], np.repeat(pairs[0], end - begin)
    cutat = np.searchsorted(owner, np.arange(rows + 1))
    return [sorted({block.names[i] for i in np.unique(item[cutat[r]:cutat[r + 1]])}) for r in range(rows)]


def _covered(row, first, end, counts):
    """Per row the number of words inside any of its spans."""
    base = np.concatenate([[0], np.cumsum(counts)])
    mark = np.zeros(base[-1] + 1, np.int64)
    np.add.at(mark, base[row] + first, 1)
    np.add.at(mark, base[row] + end, -1)
    hit = np.cumsum(mark[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[base[1:]] - total[base[:-1]]


def _digest(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _finished(id_type: str) -> str:
    return (f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
            "contaminated boolean, items array<string>, longest bigint, longest_at bigint")


def _rows(ids: pa.Array, counts, row, first, end, longest, items: list[list[str]]) -> pa.RecordBatch:
    n = len(counts)
    hit = _covered(row, first, end, counts)
    most, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    order = np.lexsort((-first, longest))
    most[row[order]] = longest[order]
    place[row[order]] = first[order]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
         pa.array([_digest(x) for x in items], pa.string()), pa.array(hit > 0), pa.array(items, pa.list_(pa.string())),
         pa.array(most, pa.int64()), pa.array(place, pa.int64(), mask=place < 0)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "longest", "longest_at"])


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """Item ids (as strings) and texts in lists of at most about ``block_bytes``
    (one longer item is a block of its own), streamed to the driver."""
    names, texts, held = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        size = len(r["t"].encode())
        if names and held + size > block_bytes:
            yield names, texts
            names, texts, held = [], [], 0
        names.append(r["i"])
        texts.append(r["t"])
        held += size
    if names:
        yield names, texts


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated`` and ``items`` (ids whose windows occur), ``longest`` and
    ``longest_at`` (words and first word of the longest verbatim match; the
    first such place; 0 and null without a hit).

    A-Z is lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of whole
    texts. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. Matches never cross documents.
    Null texts have no words; items without words match nothing; items with
    the same id count once, a null item id is the empty string. Repeated rows
    come back as often as they came in; an empty benchmark leaves every
    document clean. Other columns are neither read nor returned."""
    if not 0 < window <= _ORDERED:
        raise ValueError(f"window must be from 1 to {_ORDERED} words")
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(_block(*b)) for b in benchmark_blocks(benchmark, item_id, item_text, block_bytes)]
    blocks = blocks or [sc.broadcast(_block([], []))]

    def in_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks[0].value
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, w in _folded_words(text_array(batch.column("text")), SHARD_BYTES):
                row, first, end, suffix, longest = _shard_hits(w, hi - lo, block, window)
                yield _rows(ids.slice(lo, hi - lo), np.bincount(w.row, minlength=hi - lo), row, first, end, longest,
                            _items_of(row, suffix, block, hi - lo))

    if len(blocks) == 1:
        return src.mapInArrow(in_map, _finished(id_type))
    return _by_blocks(cut(src.withColumn("row", F.monotonically_increasing_id())), id_type, blocks, window)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window (see
    ``contamination``); all columns stay. Each benchmark block is one filter."""
    sc = docs.sparkSession.sparkContext
    out = docs
    for names, texts in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        shared = sc.broadcast(_block(names, texts))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, w in _folded_words(text_array(batch.column(text_col)), SHARD_BYTES):
                    clean = np.ones(hi - lo, bool)
                    clean[_shard_hits(w, hi - lo, shared.value, window)[0]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out


def _by_blocks(src: DataFrame, id_type: str, blocks: list, window: int) -> DataFrame:
    """The same for a benchmark of many blocks: each block gives a row per
    document with the places of its hits, each place once, and its items; a
    document's rows meet by its number."""
    spans_type = (f"row bigint, doc_id {id_type}, n_words bigint, first array<bigint>, end array<bigint>, "
                  "longest array<bigint>, items array<string>")

    def of(block):
        def spans(batches):
            b = block.value
            for batch in batches:
                ids, key = batch.column("doc_id"), batch.column("row")
                for lo, hi, w in _folded_words(text_array(batch.column("text")), SHARD_BYTES):
                    row, first, end, suffix, longest = _shard_hits(w, hi - lo, b, window)
                    items = _items_of(row, suffix, b, hi - lo)
                    # Each place once, with its longest match.
                    order = np.lexsort((-longest, end, first, row))
                    row, first, end, longest = (x[order] for x in (row, first, end, longest))
                    new = np.ones(len(row), bool)
                    new[1:] = (np.diff(np.stack([row, first, end])) != 0).any(axis=0)
                    at = pa.array(np.searchsorted(row[new], np.arange(hi - lo + 1)).astype(np.int32))
                    listed = [pa.ListArray.from_arrays(at, pa.array(x[new].astype(np.int64))) for x in (first, end, longest)]
                    yield pa.RecordBatch.from_arrays(
                        [key.slice(lo, hi - lo), ids.slice(lo, hi - lo), pa.array(np.bincount(w.row, minlength=hi - lo), pa.int64()),
                         *listed, pa.array(items, pa.list_(pa.string()))],
                        names=["row", "doc_id", "n_words", "first", "end", "longest", "items"])
        return spans

    parts = [src.mapInArrow(of(b), spans_type) for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)

    def finish(pdf):
        first, end, longest = (np.concatenate([np.asarray(x, np.int64) for x in pdf[c]]) for c in ("first", "end", "longest"))
        items = sorted({i for x in pdf["items"] for i in x})
        out = _rows(pa.array(pdf["doc_id"].iloc[:1]), np.array([int(pdf["n_words"].iat[0])]), np.zeros(len(first), np.int64),
                    first, end, longest, [items])
        return out.to_pandas()

    return every.groupBy("row").applyInPandas(finish, _finished(id_type))
