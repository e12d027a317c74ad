"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of its character 3- to 5-grams (with word ends) and itself,
hashed into a table of vectors; a window of four words is the mean of its
grams' vectors and goes through a linear softmax. Vectors and softmax are
trained jointly (Adagrad, numpy) on labelled documents: first on windows spread
over each document, then in turns on the window that the model itself finds
worst in each document, so a single toxic word in a long clean text is seen.
A document's score is that of its worst window. Misspelt and inflected forms
share grams, and so vectors, with the forms that were labelled.

Training takes place in one task over a bounded sample (``TRAIN_DOCS``
labelled documents), whose texts it reads batch by batch and holds as word
codes; the driver gets the folded model only (one float per gram bucket, 2 MB).
Scoring is one map over all documents with that model as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import WORD_BYTES, chunks, mix, span_hashes, span_indices, split_words, text_array

#: Labelled documents that training uses at most (about; chosen by a hash of the id).
TRAIN_DOCS = 8_000
BUCKETS = 1 << 19
DIM = 16
WINDOW = 4
GRAMS = (3, 4, 5)
THRESHOLD = 0.7
_SEED = 7
_BLOCK_WORDS = 200_000


def _word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram bucket, word) of every gram of the given words."""
    spaced = np.full(int((end - start).sum()) + len(start) + 1, 32, np.uint8)
    at = 1 + np.concatenate([[0], np.cumsum(end - start + 1)])[:-1]
    spaced[span_indices(at, at + end - start)] = data[span_indices(start, end)]
    points = np.frombuffer(spaced.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    gaps = np.flatnonzero(points == 32)  # words hold no blank; one blank before and after each
    first, last = gaps[:-1], gaps[1:]
    wide = points.astype(np.uint64)
    word = np.repeat(np.arange(len(first)), last - first)
    ends = np.repeat(last + 1, last - first)
    grams, owner = [span_hashes(points, first, last + 1)], [np.arange(len(first))]
    for n in GRAMS:
        size = len(wide) - n + 1
        if size <= 0:
            continue
        acc = np.full(size, n, np.uint64)
        for j in range(n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + wide[j:j + size]
        size = min(size, len(word))
        inside = np.flatnonzero(np.arange(size) + n <= ends[:size])
        grams.append(mix(acc[inside]))
        owner.append(word[inside])
    return (np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(owner)


def _distinct(data: np.ndarray, bounds: np.ndarray):
    """Words of the rows, their distinct hashes, and each word's distinct index."""
    w = split_words(data, bounds, WORD_BYTES)
    hashes, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return w, hashes, at, inverse


def _windows(bounds: np.ndarray, size: int = WINDOW):
    """(row, first word, end word) of all windows; a shorter row is one window."""
    count = np.diff(bounds)
    per = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), per)
    first = span_indices(bounds[:-1], bounds[:-1] + per)
    return row, first, np.minimum(first + size, bounds[1:][row])


class Model(NamedTuple):
    weight: np.ndarray  # per gram bucket: vector times softmax difference
    bias: float


class _Sample:
    """Labelled texts, given in parts, as distinct words with their grams, and word codes."""

    def __init__(self, parts: Iterable[pa.Array]):
        known, grams, sizes, codes, counts = np.zeros(0, np.uint64), [], [], [], []
        for lo, hi, data, bounds in (piece for part in parts for piece in chunks(text_array(part))):
            w, hashes, at, inverse = _distinct(data, bounds)
            new = ~np.isin(hashes, known)
            g, owner = _word_grams(data, w.start[at[new]], w.end[at[new]])
            order = np.argsort(owner, kind="stable")
            grams.append(g[order])
            sizes.append(np.bincount(owner, minlength=int(new.sum())))
            known = np.concatenate([known, hashes[new]])
            order = np.argsort(known)
            codes.append(order[np.searchsorted(known, hashes, sorter=order)][inverse].astype(np.int32))
            counts.append(np.bincount(w.row, minlength=hi - lo))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.grams, self.size = join(grams, np.int32), join(sizes, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = join(codes, np.int32)
        self.bounds = np.concatenate([[0], np.cumsum(join(counts, np.int64))]).astype(np.int64)

    def worst(self, most: int, weight: np.ndarray | None = None, rng=None) -> tuple[np.ndarray, ...]:
        """(row, first word, end word, rank) of the ``most`` windows of each row
        with the highest mean gram weight, or of random ones; block by block."""
        per_word = None if weight is None else np.add.reduceat(weight[self.grams], self.first[:-1]).astype(np.float64)
        out, lo, rows = [], 0, len(self.bounds) - 1
        while lo < rows:
            hi = min(max(lo + 1, int(np.searchsorted(self.bounds, self.bounds[lo] + _BLOCK_WORDS))), rows)
            codes = self.codes[self.bounds[lo]:self.bounds[hi]]
            row, begin, end = _windows(self.bounds[lo:hi + 1] - self.bounds[lo])
            score = rng.random(len(row)) if weight is None else _means(per_word[codes], self.size[codes], begin, end)
            order, rank = _worst(row, score, most)
            out.append((row[order] + lo, begin[order] + self.bounds[lo], end[order] + self.bounds[lo], rank))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*out))

    def bag(self, b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, number of its window) of the given windows, window by window."""
        codes = self.codes[span_indices(b, e)]
        which = np.repeat(np.arange(len(b)), e - b)
        return (self.grams[span_indices(self.first[codes], self.first[codes + 1])], np.repeat(which, self.size[codes]))


def _means(value, count, begin, end):
    total, n = np.concatenate([[0.0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(count)])
    return (total[end] - total[begin]) / np.maximum(n[end] - n[begin], 1)


def _worst(row: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` highest windows of each row, and their ranks from 0."""
    order = np.lexsort((-score, row))
    ranked = row[order]
    place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    return order[place < most], place[place < most]


def train(texts: list[str] | pa.Array | pa.ChunkedArray, labels: list[int], turns: int = 8, rate: float = 0.3) -> Model:
    """Vectors and softmax from labelled texts; deterministic. Without texts of
    both labels the model knows only how frequent label 1 is."""
    return _train(_Sample([pa.array(texts, type=pa.large_utf8()) if isinstance(texts, list) else texts]),
                  np.asarray(labels, dtype=np.int64), turns, rate)


def _train(sample: _Sample, y: np.ndarray, turns: int = 8, rate: float = 0.3) -> Model:
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    prior = float(np.log(base / (1 - base)))
    if len(np.unique(y)) < 2 or not len(sample.codes):
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(_SEED)
    vectors = np.empty((BUCKETS, DIM), np.float32)
    for lo in range(0, BUCKETS, 1 << 14):  # by parts: the random numbers are twice as wide
        vectors[lo:lo + (1 << 14)] = rng.standard_normal((len(vectors[lo:lo + (1 << 14)]), DIM)) * 0.05
    seen = np.full(BUCKETS, 1e-6, np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias, held = np.array([0.0, prior], np.float32), np.full((DIM + 1, 2), 1e-6, np.float32)
    heavier = float(np.sqrt((len(y) - y.sum()) / y.sum()))
    for turn in range(turns):
        if turn < 2:  # windows spread over the documents
            row, begin, end, _ = sample.worst(12, rng=rng)
        else:  # the worst window, and the worst three of documents without the label
            row, begin, end, rank = sample.worst(3, vectors @ (soft[:, 1] - soft[:, 0]))
            row, begin, end = (x[(rank == 0) | (y[row] == 0)] for x in (row, begin, end))
        mixed = rng.permutation(len(row))
        for lo in range(0, len(mixed), 256):
            part = mixed[lo:lo + 256]
            gram, which = sample.bag(begin[part], end[part])
            count = np.bincount(which, minlength=len(part)).astype(np.float32)[:, None]
            starts = np.searchsorted(which, np.arange(len(part)))
            mean = np.add.reduceat(vectors[gram], starts) / count
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            label = y[row[part]]
            p[np.arange(len(part)), label] -= 1
            p *= np.where(label == 1, heavier, 1.0).astype(np.float32)[:, None]
            back = (p @ soft.T) / count
            grad = np.concatenate([mean.T @ p, p.sum(0, keepdims=True)]) / len(part)
            held += grad ** 2
            step = rate * grad / np.sqrt(held)
            order = np.argsort(gram, kind="stable")
            ids, at = np.unique(gram[order], return_index=True)
            pull = np.add.reduceat(back[which[order]], at)
            seen[ids] += (pull ** 2).mean(1)
            vectors[ids] -= rate * pull / np.sqrt(seen[ids])[:, None]
            soft -= step[:-1]
            bias -= step[-1]
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of the batches' rows (_y, _text); without rows, none."""
    labels: list[np.ndarray] = []

    def texts() -> Iterator[pa.Array]:
        for batch in batches:
            labels.append(batch.column("_y").to_numpy() > 0)
            yield batch.column("_text")

    sample = _Sample(texts())
    if labels:
        model = _train(sample, np.concatenate(labels).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])],
                                         names=["weight", "bias"])


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Score of the worst window of each text; a text without words gets the bias alone."""
    out = np.zeros(len(texts))
    for lo, hi, data, bounds in chunks(texts):
        w, _, at, inverse = _distinct(data, bounds)
        worst = np.zeros(hi - lo)
        if len(w.row):
            gram, owner = _word_grams(data, w.start[at], w.end[at])
            value = np.bincount(owner, weights=model.weight[gram], minlength=len(at))
            count = np.bincount(owner, minlength=len(at))
            row, begin, end = _windows(np.searchsorted(w.row, np.arange(hi - lo + 1)))
            mean = _means(value[inverse], count[inverse], begin, end)
            has = np.unique(row)
            worst[has] = np.maximum.reduceat(mean, np.searchsorted(row, has))
        out[lo:hi] = worst
    return np.round(1 / (1 + np.exp(-(out + model.bias))), 9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", held_out=None, limit: int = TRAIN_DOCS) -> Model:
    """Train on about ``limit`` labelled documents at most, chosen by a hash of
    the id, in one task; ``held_out`` (condition on the label's id column) keeps rows out.
    Rows without id or label don't count; an id labelled twice takes the larger label."""
    key = F.col(f"`{id_col}`")
    rows = labels.select(key.alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where(
        "_id IS NOT NULL AND _y IS NOT NULL")
    if held_out is not None:
        rows = rows.where(~held_out(F.col("_id")))
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"))
    share = limit / max(limit, rows.count())
    rows = rows.where(F.pmod(F.xxhash64("_id", F.lit(_SEED)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about ``limit`` rows: a bounded side.
    found = (docs.select(key.alias("_id"), F.col(f"`{text_col}`").alias("_text"))
             .join(F.broadcast(rows), "_id").where("_text IS NOT NULL")
             .dropDuplicates(["_id"]).repartition(1).sortWithinPartitions("_id").select("_y", "_text"))
    made = found.mapInArrow(_trained, "weight binary, bias double").collect()
    return Model(np.frombuffer(made[0]["weight"], np.float32), made[0]["bias"]) if made else train([], [])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``)
    appended as ``doc_id, score, predicted``: one row per row, in whole texts.
    Null and wordless texts score the model's bias. Scores depend on the text
    alone. An empty table gives an empty result; other columns are not read."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score_texts(text_array(batch.column("text")), m), pa.float64())],
                names=["doc_id", "score"])

    scored = src.mapInArrow(score, f"doc_id {dict(src.dtypes)['doc_id']}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def in_held_out(key):
    """crc32 of the id as text leaves remainder 1 by 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(text_array(batch.column(text_col)), shared.value) < threshold))

    return docs.mapInArrow(keep, docs.schema)
