"""N-gram Jaccard join by MinHash banding, verified on whole shingle sets.

Plan. (1) One pass over the texts gives each row a digest of its text and its
band hashes; rows with one digest are one class (a group of copies is reduced
map-side before anything else). (2) Class ids shuffle on band hashes; every
class of a bucket is linked to the bucket's smallest class only, and the
connected components of those links are the candidate clusters. (3) The texts
of clusters of two or more classes go to their cluster, a large cluster being
dealt to pairs of blocks of bounded size, and *all* pairs within a cluster are
verified on their full shingle sets by matrix products over the shared
shingles. A task returns one row per class (its number of links and the
smallest class it is joined to), never the pairs. (4) Components of the
verified links are the near-duplicate classes.

Work and memory. Band rows are 16 bytes per class and band. A cluster of n
texts is replicated n / BLOCK_DOCS times, so verification of one group of
near copies with *different* texts is quadratic in that group; exact link
counts cannot be had for less, while copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import chunks, cut, mix, numbered, shingles, span_indices, split_words, text_array
from verdant.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 256
#: A block of a cluster holds about so many texts and bytes at most.
BLOCK_DOCS = 128
BLOCK_BYTES = 1 << 20
_COLUMNS = 4096
_HELD_BYTES = 8 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL,
                 max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective band (most rows) whose number of
    bands for the target recall at ``threshold`` fits in ``max_hashes``; an
    error if none does."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"a recall of {recall} at {threshold} needs more than {max_hashes} hashes")
    return best


def _band_hashes(texts: pa.Array, words: int, bands: int, rows: int) -> list[np.ndarray]:
    rng = np.random.default_rng(20240517)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out: list[np.ndarray] = []
    for lo, hi, data, bounds in chunks(texts):
        found, at = shingles(split_words(data, bounds), hi - lo, words)
        full = np.flatnonzero(np.diff(at))
        sign = np.zeros((bands, len(full)), dtype=np.uint64)
        if len(full):
            starts = at[:-1][full]
            for k in range(bands * rows):
                least = np.minimum.reduceat(found * a[k] + b[k], starts)
                band = k // rows
                sign[band] = mix(sign[band] ^ least) + np.uint64(band + 1)
        per = np.zeros(hi - lo, dtype=np.int64) - 1
        per[full] = np.arange(len(full))
        cols = sign.T.view(np.int64)
        out += [cols[i] if i >= 0 else cols[:0].ravel() for i in per]
    return out


def _links(flat: np.ndarray, at: np.ndarray, block: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Which of the sets ``flat[at[i]:at[i + 1]]`` are linked (symmetric)."""
    n = len(at) - 1
    size = np.diff(at)
    order = np.argsort(flat, kind="stable")
    sorted_flat = flat[order]
    new = np.concatenate([[True], sorted_flat[1:] != sorted_flat[:-1]])[:len(order)]
    col = np.cumsum(new) - 1
    shared = (np.bincount(col) > 1)[col] if len(col) else new
    doc = np.repeat(np.arange(n), size)[order][shared]
    col = np.cumsum(new[shared]) - 1
    common = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, _COLUMNS):
        lo, hi = np.searchsorted(col, [first, first + _COLUMNS])
        inc = np.zeros((n, int(col[hi - 1]) - first + 1), dtype=np.float32)
        inc[doc[lo:hi], col[lo:hi] - first] = 1
        common += inc @ inc.T
    linked = (common > 0) & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6)
    np.fill_diagonal(linked, False)
    if across:
        linked &= block[:, None] != block[None, :]
    return linked


def _verdict(linked: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Node, number of links, smallest joined node and whether a link goes to an
    earlier row, of every linked row."""
    n = len(node)
    head = np.arange(n)
    while True:  # first linked row, followed to the end
        least = np.minimum(head, np.where(linked, head[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == head).all():
            break
        head = least
    links = linked.sum(axis=1)
    has = links > 0
    return node[has], links[has], node[head[has]], np.tril(linked, -1).any(axis=1)[has]


def verified(texts: DataFrame, words: int, threshold: float, order: list[str]) -> DataFrame:
    """Rows (root, bi, bj, node, block, text and the columns of ``order``) of
    blocks and pairs of blocks -> per block and linked text the number of its
    links, a text it is joined to, and whether a linked one comes earlier in
    ``order``. Tasks stream over their rows in order of the groups."""
    group = ["root", "bi", "bj"]
    columns = [*group, "node", "block", "text"]

    def check(rows: pa.Table) -> pa.RecordBatch:
        sets, at = [], [0]
        for lo, hi, data, bounds in chunks(text_array(rows["text"])):
            found, ends = shingles(split_words(data, bounds), hi - lo, words)
            sets.append(found)
            at += (ends[1:] + at[-1]).tolist()
        flat, at = np.concatenate(sets), np.array(at)
        node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
        keys = np.stack([rows[c].to_numpy() for c in group])
        begin = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        out = []
        for lo, hi in zip(begin, [*begin[1:], len(node)]):
            _, once = np.unique(node[lo:hi], return_index=True)  # repeated rows of one text
            if len(once) > 1:
                pick = lo + np.sort(once)
                held = span_indices(at[pick], at[pick + 1])
                bounds = np.concatenate([[0], np.cumsum(at[pick + 1] - at[pick])])
                linked = _links(flat[held], bounds, block[pick], keys[1, lo] != keys[2, lo], threshold)
                if linked.any():
                    out.append(_verdict(linked, node[pick]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols[:3]] + [pa.array(cols[3])],
                                          names=["node", "links", "head", "earlier"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(columns)
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.nbytes < _HELD_BYTES:
                continue
            last = [held[c][-1].as_py() for c in group]
            same = np.logical_and.reduce([held[c].to_numpy() == v for c, v in zip(group, last)])
            whole = int(same.argmax())
            if whole:
                yield check(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield check(held.combine_chunks())

    return (texts.repartition(*group).sortWithinPartitions(*group, *order)
            .select(*columns).mapInArrow(stream, VERIFIED))


VERIFIED = "node bigint, links bigint, head bigint, earlier boolean"


def in_blocks(clusters: DataFrame) -> DataFrame:
    """Rows (node, root, bytes, ...) with their block, of at most about
    BLOCK_DOCS texts and BLOCK_BYTES, and their cluster's number of blocks k."""
    blocks = clusters.groupBy("root").agg(F.greatest(
        F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).alias("k"))
    return clusters.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")))


def in_block_pairs(texts: DataFrame) -> DataFrame:
    """Every row once for each pair (bi, bj) of blocks that holds its block."""
    other = F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("long")))
    return texts.withColumn("other", other).withColumn("bi", F.least("block", "other")).withColumn(
        "bj", F.greatest("block", "other")).drop("other", "k")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def _verdicts(keyed: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    """One row per distinct text: ``key, rep`` (its smallest id), ``class_id,
    n_links, n_copies, is_head``."""
    bands, rows = choose_bands(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column("text"))
            hashes = _band_hashes(texts, words, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(hashes, type=pa.list_(pa.int64())),
                 pa.array(np.diff(np.asarray(texts.buffers()[1]).view(np.int64)[texts.offset:texts.offset + len(texts) + 1]))
                 if len(texts) else pa.array([], pa.int64())],
                names=["doc_id", "key", "bands", "bytes"])

    id_type = dict(keyed.dtypes)["doc_id"]
    signed = keyed.mapInArrow(sign, f"doc_id {id_type}, key binary, bands array<bigint>, bytes bigint")
    classes = cut(signed.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"),
        F.first("bands").alias("bands"), F.first("bytes").alias("bytes"),
    ).withColumn("node", F.monotonically_increasing_id()))

    banded = classes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = banded.join(heads, "band").where("node != head").selectExpr("node AS a", "head AS b")
    clusters = cut(connected_components(near))

    sized = clusters.join(classes.select("node", "key", "rep", "bytes"), "node")
    members = in_blocks(sized).select("node", "root", "k", "block", "key", "rep")
    # The id in the join key spreads the rows of one large group of copies.
    texts = keyed.join(members, (keyed["key"] == members["key"]) & keyed["doc_id"].eqNullSafe(members["rep"])) \
        .select("node", "root", "k", "block", "text")
    pairs = cut(verified(in_block_pairs(texts), words, threshold, ["node"]))

    links = pairs.groupBy("node").agg(F.sum("links").alias("n_links"))
    found = cut(connected_components(pairs.selectExpr("node AS a", "head AS b")))
    ids = (classes.select("node", "key", "rep", "n_copies").join(links, "node", "left").join(found, "node", "left")
           .withColumn("root", F.coalesce("root", "node")))
    least = ids.groupBy("root").agg(F.min("rep").alias("class_id"), F.min_by("node", F.struct(
        F.col("rep").isNull(), "rep", "node")).alias("head_node"))
    return ids.join(least, "root").select(
        "key", "rep", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies",
        (F.col("node") == F.col("head_node")).alias("is_head"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           words: int = WORDS, threshold: float = THRESHOLD,
                           recall: float = RECALL) -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (smallest id of its
    class of near duplicates, itself if it has none), ``n_links`` (other texts
    with Jaccard similarity of at least ``threshold``), ``n_copies`` (rows with
    the very same text) and ``is_head`` (the text of the class's smallest id).

    Words are ``[^\\x20\\x09-\\x0D]+``, shingles five of them; a text of one to
    four words is one shingle. Null counts as the empty text; empty texts have
    no links and are copies of each other. Rows without an id belong to their
    class like others; the class of a group in which no row has an id is null.
    Repeated rows come back as often as they came in. An empty table gives an
    empty result. Other columns are neither read nor returned."""
    keyed = _keyed(docs, id_col, text_col)
    verdict = _verdicts(keyed, words, threshold, recall)
    return (keyed.select("doc_id", "key").join(verdict, "key")
            .select("doc_id", "class_id", "n_links", "n_copies", "is_head"))


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (one of
    them, if it is repeated with the same text). The id is part of the join
    key, so a large group of copies is spread over all tasks. Null and empty
    texts are copies of each other; a class without any id keeps one of its
    rows. An empty table gives an empty result. Columns may have any names."""
    plain, (ids, texts) = numbered(docs, id_col, text_col)
    heads = _verdicts(_keyed(plain, ids, texts), words, threshold, recall).where("is_head").select(
        F.col("key").alias("_near_key"), F.col("rep").alias("_near_rep"))
    rows = plain.select("*", F.unhex(F.md5(F.coalesce(F.col(texts), F.lit("")))).alias("_near_text"))
    return (rows.join(heads, (F.col("_near_text") == F.col("_near_key")) & F.col(ids).eqNullSafe(F.col("_near_rep")))
            .dropDuplicates(["_near_key", "_near_rep"]).select(*plain.columns).toDF(*docs.columns))
