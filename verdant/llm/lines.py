"""Line deduplication by an exact set-similarity join.

A line is the set of its words. (1) A sketch of fixed size (counts of word
hashes in 2**20 cells over all lines) orders words by rarity: the count of the
cell, then the hash. The order is the same everywhere, so the join is exact
whatever the sketch confuses; it only has to put frequent words last. (2) Lines
with one word set are one class, named by its digest; each has its prefix (the
``n - ceil(t n) + 1`` rarest words) and a parity map of its words (a bit or
more for each), kept once per batch of documents, so that a line that fills the corpus costs little.
(3) Classes shuffle on prefix words. Within the run of a word, ordered by size,
pairs pass the length filter, the positional filter and the parity filter (the
maps of two sets differ in at most as many bits as the sets in words); a task
hands on a spanning forest of what passed, not the pairs. The run of a word in
many prefixes is split by size and a hash of the class into blocks of bounded
rows, and pairs of blocks are dealt to tasks. (4) The components of
those links are verified on the whole word sets, all pairs of a component, in
blocks of bounded size. (5) A line goes if the same set, or a linked one, stands
earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import chunks, cut, mix, numbered, order_within, small, span_hashes, split_words, text_array
from verdant.llm.components import connected_components
from verdant.llm.near_duplicates import in_block_pairs, in_blocks, verified
from verdant.session import materialize

THRESHOLD = 0.8
CELLS = 1 << 20
_SLICES = 64
#: Bits of the filter that picks candidate lines before their texts are shuffled.
FILTER_BITS = 1 << 25
_RUN_ROWS = 200_000
#: A word in more prefixes than this has its run split into blocks of about BLOCK_ROWS.
HOT_ROWS = 1 << 15
BLOCK_ROWS = 1 << 13


def _needed(n, share: float):
    """Least whole number >= share * n."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def _cell_counts(rows: DataFrame, hashes) -> np.ndarray:
    """Counts of the hashes of all batches in CELLS cells by their lowest bits.
    Every task adds up its own cells; slices of the tables are summed by key,
    and 4 MB reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for h in hashes(batch):
                cells += np.bincount((h & h.dtype.type(CELLS - 1)).astype(np.int64), minlength=CELLS)
        cells = np.minimum(cells, 0xFFFFFFFF).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(cells, _SLICES)], pa.binary())],
            names=["slice", "cells"])

    def add(pdf):
        total = np.zeros(CELLS // _SLICES, np.uint64)
        for cells in pdf["cells"]:
            total += np.frombuffer(cells, np.uint32)
        out = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return pdf.head(1).assign(cells=[out])

    rows = (rows.mapInArrow(count, "slice int, cells binary").groupBy("slice")
            .applyInPandas(add, "slice int, cells binary").collect())
    held = {r["slice"]: np.frombuffer(r["cells"], np.uint32) for r in rows}
    empty = np.zeros(CELLS // _SLICES, np.uint32)
    return np.concatenate([held.get(i, empty) for i in range(_SLICES)])


def _word_counts(texts: DataFrame) -> np.ndarray:
    """Counts of word hashes over all texts."""
    return _cell_counts(texts, lambda batch: (split_words(data, bounds).hash for _, _, data, bounds in
                                              chunks(text_array(batch.column("text")))))


class _Lines:
    """Lines with words of a chunk, and the distinct words of each, line by line."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        starts = np.union1d(bounds[:-1], np.flatnonzero(data == 10) + 1)
        starts = starts[starts < len(data)]
        w = split_words(data, bounds)
        of = np.searchsorted(starts, w.start, side="right") - 1
        order = order_within(of, w.hash)
        line, token = of[order], w.hash[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
        self.token, line = token[new], line[new]
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])[:len(line)])
        self.begin, used = begin, line[begin]
        self.size = np.diff(np.concatenate([begin, [len(line)]]))
        self.of = np.repeat(np.arange(len(used)), self.size)
        self.start = starts[used]
        self.end = np.concatenate([starts[1:], [len(data)]])[used] if len(used) else starts[:0]
        self.row = np.searchsorted(bounds, self.start, side="right") - 1
        # number of the line in its text, lines without words counted
        first = np.searchsorted(starts, bounds[:-1])
        self.number = used - first[self.row]

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.begin) if len(self.begin) else np.zeros(0, np.uint64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        h1 = mix(self._sum(mix(self.token)))
        h2 = mix(self._sum(mix(self.token ^ np.uint64(0x5851F42D4C957F2D))) + self.size.astype(np.uint64))
        return h1.view(np.int64), h2.astype(np.uint32).view(np.int32)

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """Parity maps, line by line, and their bounds: 64-bit words, as many as
        the power of two that gives each word of the line a bit. Folding the
        halves of a map by XOR gives the map of half the width."""
        width = np.int64(1) << np.ceil(np.log2(np.maximum(self.size / 64, 1))).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(width)])
        h = mix(self.token + np.uint64(1))
        at = bounds[self.of] + ((h >> np.uint64(6)) & (width[self.of] - 1).astype(np.uint64)).astype(np.int64)
        maps = np.zeros(bounds[-1], np.uint64)
        np.bitwise_xor.at(maps, at, np.uint64(1) << (h & np.uint64(63)))
        return maps, bounds

    def prefixes(self, counts: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Rarest words of each line, line by line, and their bounds."""
        cell = counts[(self.token & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
        # rarity and token in one value; the token's order decides between equal cells
        order = order_within(self.of, (np.minimum(cell, np.uint64((1 << 24) - 1)) << np.uint64(40))
                             | (self.token >> np.uint64(24)))
        place = np.arange(len(order)) - np.repeat(self.begin, self.size)
        take = self.size - _needed(self.size, share) + 1
        inside = place < np.repeat(take, self.size)
        return (self.token[order][inside] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.concatenate([[0], np.cumsum(take)])

    def raw(self, data: np.ndarray) -> np.ndarray:
        """Hash of each line's bytes."""
        return raw_lines(data, self.start, self.end)


def raw_lines(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(data, start, end).view(np.int64)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as a-b, one per node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        np.minimum.at(label, before[x], least)
        np.minimum.at(label, before[y], least)
        label = label[label]
        if (label == before).all():
            break
    has = label != np.arange(len(nodes))
    return nodes[has], nodes[label[has]]


def _differing(maps, begin, width, x, y) -> np.ndarray:
    """Differing bits of the parity maps of rows x and y, at the smaller width."""
    out = np.zeros(len(x), np.int64)
    wx, wy = width[x], width[y]
    for a, b in {*zip(wx.tolist(), wy.tolist())}:
        of = np.flatnonzero((wx == a) & (wy == b))
        w = min(a, b)
        fold = [np.bitwise_xor.reduce(maps[begin[r[of], None] + np.arange(k)].reshape(len(of), k // w, w), axis=1)
                for r, k in ((x, a), (y, b))]
        out[of] = np.bitwise_count(fold[0] ^ fold[1]).sum(axis=1)
    return out


def _passing(rows: dict[str, np.ndarray], maps: np.ndarray, share: float):
    """Links between classes of one prefix word that pass all filters; the maps
    of the rows are at ``begin``, ``width`` long. Rows of one ``side`` >= 0 meet
    in other blocks."""
    order = np.lexsort((rows["node"], rows["size"], rows["token"]))
    rows = {c: x[order] for c, x in rows.items()}
    new = np.concatenate([[True], (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])
    once = new[:len(rows["token"])]
    token, node, size, place, begin, width, side = (
        rows[c][once] for c in ("token", "node", "size", "place", "begin", "width", "side"))
    at, step, found, held = np.arange(len(token)), 0, [], 0
    while True:
        step += 1
        at = at[at + step < len(token)]
        to = at + step
        near = (token[at] == token[to]) & (size[at] >= _needed(size[to], share))
        at, to = at[near], to[near]
        if not len(at):
            break
        both = size[at] + size[to]
        least = _needed(both, share / (1 + share))
        room = np.minimum(size[at] - place[at], size[to] - place[to])
        fits = np.flatnonzero((room >= least) & (node[at] != node[to]) & ((side[at] != side[to]) | (side[at] < 0)))
        x, y = at[fits], to[fits]
        passed = _differing(maps, begin, width, x, y) <= both[fits] - 2 * least[fits]
        if passed.any():
            found.append((node[x[passed]], node[y[passed]]))
            held += int(passed.sum())
            if held > 1_000_000:
                found = [_spanning(*(np.concatenate(f) for f in zip(*found)))]
                held = len(found[0][0])
    return _spanning(*(np.concatenate(f) for f in zip(*found))) if found else (node[:0], node[:0])


def _hot_words(classes: DataFrame, share: float) -> DataFrame | None:
    """(token, parts: blocks by size class) of the words in more than HOT_ROWS
    prefixes: counted in cells first, then exactly where a cell has so many.
    Sets that pass the length filter are of one size class or of neighbours."""
    counts = _cell_counts(classes.select("prefix"), lambda batch: [batch.column("prefix").flatten().to_numpy(zero_copy_only=False)])
    cells = [(int(c),) for c in np.flatnonzero(counts > HOT_ROWS)]
    if not cells:
        return None
    cells = small(cut(classes.sparkSession.createDataFrame(cells, "cell int")))
    sizes = (classes.select(_size_class(share).alias("sized"), F.explode("prefix").alias("token"))
             .join(cells, F.col("token").bitwiseAND(CELLS - 1) == F.col("cell")).groupBy("token", "sized").agg(F.count(F.lit(1)).alias("c")))
    part = F.struct("sized", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("k"))
    return cut(sizes.groupBy("token").agg(F.map_from_entries(F.collect_list(part)).alias("parts"), F.sum("c").alias("c"))
               .where(F.col("c") > HOT_ROWS).drop("c"))


def _size_class(share: float):
    return F.floor(F.log("size") / (1.001 * max(-np.log(share), 0.01))).cast("int")


def _index(classes: DataFrame, share: float) -> DataFrame:
    """Rows (token, node, size, place, parity) of the classes' prefix words; if
    there are hot words, each of their rows once for each pair of blocks that
    holds its block, with the pair in place of the token and its ``side``."""
    index = classes.select("node", "size", "parity", F.posexplode("prefix").alias("place", "token"))
    hot = _hot_words(classes, share)
    if hot is None:
        return index
    index = index.join(small(hot), "token", "left").withColumn("sized", _size_class(share))
    blocks = lambda by: F.coalesce(F.try_element_at("parts", F.col("sized") + by), F.lit(0))
    mine = F.pmod(F.xxhash64("node"), F.greatest(blocks(0), F.lit(1))).cast("int")
    index = index.withColumn("block", mine)

    def met(by: int):
        """Pairs with the blocks of the size class that is ``by`` further."""
        def pair(j):
            i = F.col("block")
            first, second = (F.least(i, j), F.greatest(i, j)) if by == 0 else (i, j) if by > 0 else (j, i)
            side = F.when(i == j, -1).when(i < j, 0).otherwise(1) if by == 0 else F.lit(0 if by > 0 else 1)
            key = F.xxhash64("token", F.col("sized") + min(by, 0), F.lit(abs(by)), first, second)
            return F.struct(key.alias("token"), side.cast("int").alias("side"))
        every = F.transform(F.sequence(F.lit(0), F.greatest(blocks(by), F.lit(1)) - 1), pair)
        return F.filter(every, lambda x: blocks(by) > 0)

    alone = F.array(F.struct(F.col("token").cast("long").alias("token"), F.lit(-1).alias("side")))
    dealt = F.when(F.col("parts").isNull(), alone).otherwise(F.concat(met(0), met(1), met(-1)))
    return index.withColumn("d", F.explode(dealt)).select("d.token", "node", "size", "place", "parity", "d.side")


def _candidates(classes: DataFrame, share: float) -> DataFrame:
    """Links (a, b) whose components hold every pair that passes the filters."""
    index = _index(classes, share)
    columns = [c for c in ("token", "node", "size", "place", "parity", "side") if c in index.columns]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            maps = rows["parity"].combine_chunks().cast(pa.large_binary())
            ends = np.frombuffer(maps.buffers()[1], np.int64)[maps.offset:maps.offset + len(maps) + 1] // 8
            flat = np.frombuffer(maps.buffers()[2], np.uint64, count=int(ends[-1]))
            numbers = {c: rows[c].to_numpy().astype(np.int64) for c in ("token", "node", "size", "place")}
            side = rows["side"].to_numpy() if "side" in rows.column_names else np.full(rows.num_rows, -1)
            a, b = _passing(numbers | {"begin": ends[:-1], "width": np.diff(ends), "side": side}, flat, share)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < _RUN_ROWS:
                continue
            token = held["token"].to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            if last:
                yield out(held.slice(0, last).combine_chunks())
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield out(held.combine_chunks())

    return (index.repartition("token").sortWithinPartitions("token")
            .select(*columns).mapInArrow(sweep, "a bigint, b bigint"))


def _filter_bits(raw: DataFrame) -> np.ndarray:
    """Bit table of line hashes: of fixed size, at most 8 MB to the driver."""
    words = (raw.selectExpr(f"pmod(raw, {FILTER_BITS}) AS bit").groupBy(F.expr("bit >> 6").alias("w"))
             .agg(F.expr("bit_or(1L << CAST(bit & 63 AS INT))").alias("bits")).toArrow())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``doc_id, n_lines`` (lines with a word), ``n_removed``,
    ``n_links`` (sum over its lines of other word sets linked to the line's) and
    ``removed`` (numbers of the lines that go, from 0, comma-joined).

    Lines end at \\n, words are ``[^\\x20\\x09-\\x0D]+``; a line is the set of its
    words, and two lines match if their sets' Jaccard similarity is at least
    ``threshold``. A line goes if a matching line stands earlier, in the order of
    (id, line number), rows without id last. Lines without words never go. Null
    counts as the empty text. Rows that repeat an id and text are one place and
    don't remove each other. An empty table gives an empty result. Other columns
    are neither read nor returned."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    counts = spark.sparkContext.broadcast(_word_counts(src.select("text")))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), np.asarray(batch.column("row"))
            kept = np.zeros(0, np.int64)
            for lo, hi, data, bounds in chunks(text_array(batch.column("text"))):
                lines = _Lines(data, bounds)
                h1, h2 = lines.digests()
                prefix, ends = lines.prefixes(counts.value, threshold)
                fresh = np.zeros(len(h1), bool)  # first in this batch: the others need no prefix
                fresh[np.unique(h1, return_index=True)[1]] = True
                fresh &= ~np.isin(h1, kept)
                kept = np.concatenate([kept, h1[fresh]])
                n = hi - lo
                of = np.concatenate([lines.row, np.arange(n)])
                bare = np.zeros(n, np.int64)  # every document also has one row with line -1
                cat = lambda x, t: pa.array(np.concatenate([x, bare]).astype(t))
                total = np.concatenate([np.zeros(len(h1), np.int64), np.bincount(lines.row, minlength=n)])
                maps, map_ends = lines.parity()
                width = np.concatenate([np.where(fresh, np.diff(ends), 0), bare])
                offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
                prefix = prefix[np.repeat(fresh, np.diff(ends))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[lo:hi][of]), ids.slice(lo, n).take(pa.array(of)),
                     pa.array(np.concatenate([lines.number, np.full(n, -1)]).astype(np.int32)),
                     pa.array(total.astype(np.int32)), cat(h1, np.int64), cat(h2, np.int32), cat(lines.size, np.int32),
                     cat(lines.end - lines.start, np.int32), cat(lines.raw(data), np.int64),
                     pa.Array.from_buffers(pa.binary(), len(of), [
                         None, pa.py_buffer((np.concatenate([map_ends, np.full(n, map_ends[-1])]) * 8).astype(np.int32)),
                         pa.py_buffer(maps)]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix))],
                    names=["row", "doc_id", "line", "n_lines", "h1", "h2", "size", "bytes", "raw", "parity", "prefix"])

    # A table in the shared folder: its readers need a few columns each.
    seen = materialize(src.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        classify, f"row bigint, doc_id {id_type}, line int, n_lines int, h1 bigint, h2 int, size int, bytes int, "
                  "raw bigint, parity binary, prefix array<int>"), "lines")
    # Two sets with one 64-bit digest would share a node here: their cluster is verified all the same.
    clusters = cut(connected_components(_candidates(
        seen.where("size(prefix) > 0").selectExpr("h1 AS node", "size", "parity", "prefix"), threshold)))

    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("line").alias("line"),
                     F.col("raw").alias("raw"), F.col("bytes").alias("bytes"))
    classes = seen.where("line >= 0").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
    marked = cut(classes.join(clusters.withColumnRenamed("node", "h1"), "h1", "left").where("c > 1 OR root IS NOT NULL")
                 .select("h1", "h2", "first", "c", "root", F.monotonically_increasing_id().alias("node"),
                         F.col("first.bytes").alias("bytes"), F.col("first.raw").alias("raw")))
    members = in_blocks(marked.where("root IS NOT NULL")).select("node", "root", "k", "block", "raw", "first")
    picked = spark.sparkContext.broadcast(_filter_bits(marked.where("root IS NOT NULL")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = picked.value.view(np.uint64)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, bounds in chunks(text_array(batch.column("text"))):
                start = np.union1d(bounds[:-1], np.flatnonzero(data == 10) + 1)
                start = start[start < len(data)]
                end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
                row = np.searchsorted(bounds, start, side="right") - 1
                number = np.arange(len(start)) - np.searchsorted(start, bounds[:-1])[row]
                raw = raw_lines(data, start, end)
                bit = np.mod(raw, FILTER_BITS)
                has = np.flatnonzero((bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                texts = [data[s:e].tobytes() for s, e in zip(start[has], end[has])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(row[has])), pa.array(number[has].astype(np.int32)),
                     pa.array(raw[has]), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "line", "raw", "text"])

    # The id in the join key spreads the rows of a line with many copies.
    texts = src.mapInArrow(pick, f"doc_id {id_type}, line int, raw bigint, text string")
    at_first = ((texts["raw"] == members["raw"]) & (texts["line"] == members["first.line"])
                & texts["doc_id"].eqNullSafe(members["first.id"]))
    held = texts.join(members, at_first).select("node", "root", "k", "block", "text", F.col("first.none").alias("p0"),
                                                F.col("first.id").alias("p1"), F.col("first.line").alias("p2"))
    pairs = verified(in_block_pairs(held), 1, threshold, ["p0", "p1", "p2", "node"])
    linked = pairs.groupBy("node").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier"))
    verdict = (marked.select("node", "h1", "h2", "first", "c").join(linked, "node", "left").where("c > 1 OR links > 0")
               .select("h1", "h2", "first", "links", F.coalesce("earlier", F.lit(False)).alias("earlier")))

    whole = seen.where("line < 0").select("row", "doc_id", "n_lines", F.lit(-1).alias("line"), F.lit(0).alias("links"), F.lit(False).alias("goes"))
    goes = F.col("earlier") | ~((F.col("line") == F.col("first.line")) & F.col("doc_id").eqNullSafe(F.col("first.id")))
    met = (seen.where("line >= 0").select("row", "doc_id", "h1", "h2", "line", "n_lines").join(verdict, ["h1", "h2"])
           .select("row", "doc_id", "n_lines", "line", F.coalesce("links", F.lit(0)).alias("links"), goes.alias("goes")))
    return whole.unionByName(met).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_lines").cast("long").alias("n_lines"),
        F.sum(F.col("goes").cast("long")).alias("n_removed"), F.sum("links").cast("long").alias("n_links"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("goes"), F.col("line")))),
                                     lambda x: x.cast("string"))).alias("removed")).drop("row")


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with later matching lines taken out of the texts. Ids must be
    unique here; rows without id, and null and empty texts, stay as they are.
    An empty table gives an empty result. Columns may have any names."""
    plain, (ids, texts) = numbered(docs, id_col, text_col)
    gone = duplicate_lines(plain, ids, texts, threshold).where("n_removed > 0").select(
        F.col("doc_id").alias("_line_id"), F.transform(F.split("removed", ","), lambda x: x.cast("int")).alias("_line_gone"))
    joined = plain.join(gone, F.col(ids) == F.col("_line_id"), "left")
    lines = F.filter(F.split(F.col(texts), "\n"), lambda x, i: ~F.array_contains("_line_gone", i))
    return joined.select(*[F.when(F.col("_line_id").isNull(), F.col(c)).otherwise(F.array_join(lines, "\n")).alias(c)
                           if c == texts else F.col(c) for c in plain.columns]).toDF(*docs.columns)
