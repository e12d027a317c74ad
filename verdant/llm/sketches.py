"""MinHash near-duplicates with fast similarity sketches.

A sketch has ``bands * rows`` coordinates (bins). A set's shingles are placed
into bins by a fresh hash in each round, and a bin keeps the least value of
the first round that reaches it; after as many rounds as bins, round t + j
places every shingle into bin j, so each coordinate fills whatever the set's
size. A set of n shingles needs about t ln(t) / n rounds instead of t hashes
of every shingle, and two sets agree in a coordinate with the probability of
their Jaccard similarity, with concentration as if coordinates were independent.

Plan. (1) One pass gives each text its set's size, digest and band hashes;
equal sets are one node. (2) Nodes shuffle on band hashes; each node of a
bucket is verified against the bucket's smallest node on the full sets, a
large star being dealt to tasks by salt. (3) Components of these verified
links. Only buckets whose other members lie in more than one component can
hold further joins: their pairs across components are verified, in blocks of
bounded size, the largest component of a bucket against the others only.
(4) Components of all verified links. Unverified candidates never join
anything, and a group of near copies costs one comparison for each member.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import LOWER, chunks, cut, mix, shingles, span_indices, split_words, text_array
from verdant.llm.components import connected_components

WORDS = 4
PERCENT = 80
RECALL = 0.9999
MAX_BINS = 256
#: Members of a star that one task gets at once, and of a block of a bucket (nodes and shingles).
STAR_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 512, 64, 1 << 17
#: Rows that are sketched, and (round, shingle) pairs that are hashed, at once.
_ROWS, _PAIRS = 2048, 1 << 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(percent: int = PERCENT, recall: float = RECALL, bins: int = MAX_BINS) -> tuple[int, int]:
    """(bands, rows): the longest band for which the bands that the recall asks
    for at the threshold fit into ``bins``; an error if none does."""
    for rows in range(bins, 0, -1):
        hit = (percent / 100) ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows <= bins:
            return bands, rows
    raise ValueError(f"a recall of {recall} at {percent} % needs more than {bins} bins")


def fast_sketches(found: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """Sketches (sets x bins) of the sets ``found[at[i]:at[i + 1]]``. A value
    holds its round above its hash, so the least one of a bin is always of the
    first round that reached it, and it makes no difference how many rounds
    are hashed at once. Bins of an empty set stay empty."""
    out = np.full((len(at) - 1, bins), _EMPTY, np.uint64)
    flat, size, done = out.ravel(), np.diff(at), 0
    left = np.flatnonzero(size)
    while len(left) and done < 2 * bins:
        items = found[span_indices(at[left], at[left + 1])]
        row = np.repeat(left * bins, size[left])
        stage_end = bins if done < bins else 2 * bins
        many = min(max(_PAIRS // len(items), 1), stage_end - done)
        rounds = np.arange(done, done + many, dtype=np.uint64)[:, None]
        h = mix(items[None, :] ^ mix((rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        if done < bins:
            place = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        else:
            place = np.broadcast_to(rounds.astype(np.int64) - bins, h.shape)
        value = (rounds << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, (row[None, :] + place).ravel(), value.ravel())
        done += many
        left = left[(out[left] == _EMPTY).any(axis=1)]
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band (sets x bands)."""
    acc = np.zeros((len(sketch), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        acc = mix(acc ^ sketch[:, k::rows][:, :bands]) + np.uint64(k + 1)
    return acc.view(np.int64)


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, bounds in chunks(texts):
        found, at = shingles(split_words(LOWER[data], bounds), hi - lo, words)
        for first in range(0, hi - lo, _ROWS):
            last = min(first + _ROWS, hi - lo)
            yield lo + first, lo + last, found[at[first]:at[last]], at[first:last + 1] - at[first]


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, md5 of the text, n_shingles, digest of the set (null if it is
    empty) and band hashes of each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("md5"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found, at in _sets(text_array(batch.column("text")), words):
                hashes, size = band_hashes(fast_sketches(found, at, bands * rows), bands, rows), np.diff(at)
                raw = found.tobytes()
                digest = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None
                          for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("md5").slice(lo, hi - lo),
                     pa.array(size.astype(np.int64)), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[size > 0].ravel()))],
                    names=["doc_id", "md5", "n_shingles", "key", "bands"])

    return src.mapInArrow(sign, f"doc_id {dict(src.dtypes)['doc_id']}, md5 binary, n_shingles bigint, key binary, "
                                "bands array<bigint>")


def _common(base: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Size of the intersection of sorted ``base`` with each set of ``flat``."""
    place = np.searchsorted(base, flat)
    there = base[np.minimum(place, len(base) - 1)] == flat
    total = np.concatenate([[0], np.cumsum(there)])
    return total[at[1:]] - total[at[:-1]]


def _linked(base: np.ndarray, flat: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    common = _common(base, flat, at)
    return 100 * common >= percent * (len(base) + np.diff(at) - common)


LINKS = "a bigint, b bigint"


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (a, b)], names=["a", "b"])


def verified_stars(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (head, salt, member, node, text), one with member false for each
    (head, salt) -> links of members to their head. A task holds one head's set."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("head", "salt")])
            node, member = batch.column("node").to_numpy(), batch.column("member").to_numpy(zero_copy_only=False)
            for lo, hi, found, at in _sets(text_array(batch.column("text")), words):
                begin = lo + np.flatnonzero(np.concatenate([[True], (keys[:, lo + 1:hi] != keys[:, lo:hi - 1]).any(axis=0)]))
                for first, last in zip(begin, [*begin[1:], hi]):
                    if not member[first]:  # its head comes first; a group may go on in the next slice
                        now = tuple(keys[:, first])
                        base = found[at[first - lo]:at[first - lo + 1]].copy()
                        first += 1
                    assert now == tuple(keys[:, last - 1])
                    if first < last:
                        ends = at[first - lo:last - lo + 1]
                        linked = _linked(base, found[ends[0]:ends[-1]], ends - ends[0], percent)
                        yield _pairs(node[first:last][linked], np.full(int(linked.sum()), now[0]))

    return (rows.repartition("head", "salt").sortWithinPartitions("head", "salt", "member", "node")
            .select("head", "salt", "member", "node", "text").mapInArrow(stream, LINKS))


def verified_blocks(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (bucket, i, j, side, node, root, text) of block pairs -> links that join
    nodes of different roots. A task holds one pair of blocks."""
    columns = ["bucket", "i", "j", "side", "node", "root"]

    def joins(held: list) -> pa.RecordBatch:
        held = list({h[1]: h for h in held}.values())
        root = {h[2]: h[2] for h in held}

        def top(r):
            while root[r] != r:
                r = root[r]
            return r

        a, b = [], []
        for k, (side, node, r, base) in enumerate(held):
            # Every pair once: within a block by order, across by side.
            others = [h for h in held[k + 1:] if (h[0] == side if held[0][0] == held[-1][0] else h[0] != side)
                      and top(h[2]) != top(r) and 100 * min(len(h[3]), len(base)) >= percent * max(len(h[3]), len(base))]
            if others:
                at = np.concatenate([[0], np.cumsum([len(h[3]) for h in others])])
                for h, yes in zip(others, _linked(base, np.concatenate([h[3] for h in others]), at, percent)):
                    if yes and top(h[2]) != top(r):
                        root[top(h[2])] = top(r)
                        a.append(node)
                        b.append(h[1])
        return _pairs(a, b)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in columns]
            for lo, hi, found, at in _sets(text_array(batch.column("text")), words):
                for k in range(lo, hi):
                    key = (cols[0][k], cols[1][k], cols[2][k])
                    if key != now:
                        if held:
                            yield joins(held)
                        now, held = key, []
                    held.append((cols[3][k], cols[4][k], cols[5][k], found[at[k - lo]:at[k - lo + 1]].copy()))
        if held:
            yield joins(held)

    return (rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")
            .select(*columns, "text").mapInArrow(stream, LINKS))


def _star_rows(near: DataFrame) -> DataFrame:
    """(node, head) of each star once, dealt by salt, and its head to each salt."""
    edges = near.select("node", "head").distinct()
    salts = edges.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("long").alias("salts"))
    members = edges.join(salts, "head").select("node", "head", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"),
                                               F.lit(True).alias("member"))
    used = members.select("head", "salt").distinct()
    return members.unionByName(used.select(F.col("head").alias("node"), "head", "salt", F.lit(False).alias("member")))


def _block_rows(near: DataFrame, size: DataFrame) -> DataFrame:
    """(bucket, i, j, side, node, root) for the pairs of blocks of each bucket
    whose members (its head left out: all pairs with it are verified) have
    different roots. Blocks are numbered from 0 among the nodes outside the
    bucket's largest root, and go on among those inside; i is always outside."""
    inside = near.select("band", "node", "root").join(size, "node")
    roots = inside.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"),
                                               F.bit_xor(F.xxhash64("node")).alias("x"))
    largest = F.max(F.struct("c", "root"))
    of = (roots.groupBy("band").agg(F.count(F.lit(1)).alias("roots"), largest.alias("big"), F.sum("c").alias("c"),
                                    F.sum("n").alias("n"), F.bit_xor("x").alias("x"),
                                    F.max_by("n", F.struct("c", "root")).alias("big_n")).where("roots > 1")
          # Buckets of the same members (by count, shingles and hash) count once.
          .groupBy("c", "n", "x").agg(F.min(F.struct("band", "big", "big_n")).alias("b"))
          .select(F.col("b.band").alias("band"), F.col("b.big.root").alias("big_root"),
                  _blocks(F.col("c") - F.col("b.big.c"), F.col("n") - F.col("b.big_n")).alias("outer"),
                  _blocks(F.col("b.big.c"), F.col("b.big_n")).alias("inner")))
    rows = inside.join(of, "band")
    is_big = F.col("root") == F.col("big_root")
    block = F.when(is_big, F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("outer")))
    rows = rows.withColumn("block", block)
    # A block outside meets every block; one inside only those outside.
    meets = F.sequence(F.lit(0).cast("long"), F.when(is_big, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1))
    rows = rows.withColumn("other", F.explode(meets))
    return rows.select(F.col("band").alias("bucket"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       F.col("block").alias("side"), "node", "root")


def _blocks(rows, items):
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(items / BLOCK_SHINGLES), F.lit(1)).cast("long")


def sketched_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                        percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles`` (size of its set),
    ``component_id`` (smallest id that links lead to, itself included) and
    ``kept`` (whether that is its own id).

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, the set holds the
    shingles of ``words`` words; fewer words are one shingle. Sets are linked if
    100 * intersection >= ``percent`` * union, which is always decided on the
    full sets; bands lose a pair right at the threshold with a probability of
    1 - ``recall``. A null or wordless text has the empty set and is linked with nothing:
    its component is its own id. Rows without an id belong to their component; their
    own ``component_id`` is null only if no row of it has an id, and ``kept`` is true
    then. Repeated rows come back as often as they came in. An empty table gives an
    empty result. Other columns are neither read nor returned."""
    bands, rows = bands_for(percent, recall)
    signed = cut(_signed(docs, id_col, text_col, words, bands, rows))
    nodes = cut(signed.where("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5")).alias("rep"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
    ).select("key", F.col("rep.doc_id").alias("rep"), F.col("rep.md5").alias("rep_md5"), "n", "bands")
        .withColumn("node", F.monotonically_increasing_id()))

    banded = nodes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = cut(banded.join(heads, "band").where("node != head").select("band", "node", "head"))
    asked = near.select("node").union(near.select("head")).distinct()
    # The id in the join key spreads copies of one text over the tasks.
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("md5"))
    reps = nodes.join(asked, "node").select("node", "rep", "rep_md5")
    texts = cut(whole.join(reps, whole["doc_id"].eqNullSafe(reps["rep"]) & (whole["md5"] == reps["rep_md5"]))
                .dropDuplicates(["node"]).select("node", "text"))

    stars = cut(verified_stars(_star_rows(near).join(texts, "node"), words, percent))
    found = connected_components(stars)
    rooted = near.join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    blocks = _block_rows(rooted, nodes.select("node", "n"))
    more = verified_blocks(blocks.join(texts, "node"), words, percent)
    links = cut(stars.union(more))

    joined = nodes.select("key", "node", "rep").join(connected_components(links), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    verdict = joined.join(least, "root").select("key", "component_id")
    ends = signed.select("doc_id", "n_shingles", "key").join(verdict, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return ends.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))
