"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes places the chunk ends, so equal
passages are cut alike wherever they stand: an insertion changes the chunks
around it only. Chunks are deduplicated by digest: the document of the smallest
id keeps a chunk, later ones repeat it. Only runs of neighbouring repeated
chunks with at least ``MIN_RUN_WORDS`` words count, which leaves chance repeats
and short formulas alone.

Chunks shuffle as digests and positions, never as text. The first aggregation
(smallest and largest document per digest) is reduced map-side, so a passage
that a third of all documents share is one row per task; the join of chunks
with the repeated digests is a plain sort-merge join whose hot partitions
adaptive execution can split. Runs are put together per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm.common import chunks, mix, numbered, span_hashes, split_words, text_array

#: One byte in so many ends a chunk; ends closer than MIN_GAP to one before don't; longer chunks are cut.
ONE_IN = 20
MIN_GAP = 12
MAX_CHUNK = 512
MIN_RUN_WORDS = 20
_WINDOW = 16
_GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256, dtype=np.uint16)


def chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start of every chunk of every row, and the end of the data. The gear hash
    ``h(i) = 2 h(i-1) + gear[byte i]`` modulo 2**16 is summed in doubling steps;
    chunks start at character starts and never cross rows."""
    gear = _GEAR[data]
    step = 1
    while step < _WINDOW:
        before = gear
        gear = before.copy()
        gear[step:] += before[:-step] << np.uint16(step)
        step *= 2
    low = np.flatnonzero(gear < (1 << 16) // ONE_IN)
    row_start = bounds[np.searchsorted(bounds, low, side="right") - 1]
    low = low[low - row_start >= _WINDOW - 1]
    low = low[low + 1 < len(data)]
    low = low[(data[low + 1] & 0xC0) != 0x80]
    apart = np.ones(len(low), bool)
    apart[1:] = np.diff(low) >= MIN_GAP
    cuts = np.union1d(low[apart] + 1, bounds)
    long = np.flatnonzero(np.diff(cuts) > MAX_CHUNK)
    if len(long):
        more = np.concatenate([np.arange(cuts[i] + MAX_CHUNK, cuts[i + 1], MAX_CHUNK) for i in long])
        for _ in range(3):  # back to the start of a character
            more -= (data[more] & 0xC0) == 0x80
        cuts = np.union1d(cuts, more)
    return cuts


def _chunk_rows(data: np.ndarray, bounds: np.ndarray):
    """Per chunk: row, digest (uint64, uint32), number in the row, words begun,
    first code point, code points, and whether the row has it already."""
    cuts = chunk_bounds(data, bounds)
    start, end = cuts[:-1], cuts[1:]
    row = np.searchsorted(bounds, start, side="right") - 1
    first = span_hashes(data, start, end)
    second = mix(span_hashes(data, start, start + (end - start + 1) // 2) * np.uint64(3)
                 + span_hashes(data, start + (end - start + 1) // 2, end)).astype(np.uint32)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    w = split_words(data, bounds)
    words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    index = np.arange(len(row)) - np.searchsorted(row, row)
    order = np.lexsort((index, second, first, row))
    again = np.zeros(len(row), bool)
    same = np.ones(max(len(row) - 1, 0), bool)
    for x in (row, first, second):
        same &= x[order][1:] == x[order][:-1]
    again[order[1:]] = same
    return row, first, second, index, words, points[start] - points[bounds[row]], points[end] - points[start], again


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunk rows, and one row with ``idx`` -1 for every document (its digest is
    a hash of its number, to spread those rows; it can't meet a chunk's)."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      F.monotonically_increasing_id().alias("row"))
    schema = (f"row bigint, doc_id {dict(src.dtypes)['doc_id']}, h1 bigint, h2 int, idx int, words int, "
              "first int, points int, again boolean")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), np.asarray(batch.column("row"))
            for lo, hi, data, bounds in chunks(text_array(batch.column("text"))):
                row, first, second, index, words, at, points, again = _chunk_rows(data, bounds)
                n = hi - lo
                total = np.bincount(row, weights=words, minlength=n).astype(np.int64)
                own = rows[lo:hi].astype(np.uint64)
                of = np.concatenate([row, np.arange(n)])
                cat = lambda x, y, t: pa.array(np.concatenate([x, y]).astype(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[lo:hi][of]), ids.slice(lo, n).take(pa.array(of)),
                     pa.array(np.concatenate([first, mix(own)]).view(np.int64)),
                     pa.array(np.concatenate([second, mix(own + np.uint64(1)).astype(np.uint32)]).view(np.int32)),
                     cat(index, np.full(n, -1), np.int32), cat(words, total, np.int32), cat(at, np.zeros(n), np.int32),
                     cat(points, np.bincount(row, minlength=n), np.int32), pa.array(np.concatenate([again, np.zeros(n, bool)]))],
                    names=["row", "doc_id", "h1", "h2", "idx", "words", "first", "points", "again"])

    return src.mapInArrow(cut_up, schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """One row per row: ``doc_id, n_words, n_chunks, n_repeated_words`` (words in
    runs of chunks that another document or place has too, whichever is first),
    ``n_removed_words`` (those of them that an earlier place has, which goes),
    ``repeats`` (n_repeated_words > 0), ``removed`` (the spans that go as
    ``start:end`` in code points, by start) and ``spans`` (the same as structs).

    Earlier is a smaller id, or an earlier place in the same document; rows with
    one id, and rows without id among each other, don't repeat one another, and
    rows without id come last. Null texts and empty texts have no chunks.
    Repeated rows come back as often as they came in; an empty table gives an
    empty result. Other columns are neither read nor returned."""
    found = _chunked(docs, id_col, text_col)
    digests = (found.where("idx >= 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("ids"),
        F.count(F.lit(1)).alias("c")).where("c > 1").select(
        "h1", "h2", "lo", (F.col("lo").isNotNull() & ((F.col("lo") != F.col("hi")) | (F.col("ids") < F.col("c")))).alias("shared")))
    met = found.join(digests, ["h1", "h2"], "left").where("idx < 0 OR lo IS NOT NULL OR again OR shared IS NOT NULL")
    later = F.col("again") | F.coalesce(F.col("doc_id") > F.col("lo"), F.col("doc_id").isNull() & F.col("lo").isNotNull())
    here = met.select("row", "doc_id", "idx", "words", "first", "points", (F.col("idx") < 0).alias("whole"),
                      F.coalesce(later, F.lit(False)).alias("later"),
                      (F.coalesce("shared", F.lit(False)) | F.col("again")).alias("shared")).repartition("row")
    at = Window.partitionBy("row", "whole", "shared").orderBy("idx")
    at_later = Window.partitionBy("row", "whole", "later").orderBy("idx")
    runs = here.withColumn("run", F.col("idx") - F.row_number().over(at)).withColumn(
        "later_run", F.col("idx") - F.row_number().over(at_later))
    whole_row, whole_run = Window.partitionBy("row", "whole", "shared", "run"), Window.partitionBy("row", "whole", "later", "later_run")
    runs = runs.withColumn("run_words", F.sum("words").over(whole_row)).withColumn(
        "later_words", F.sum("words").over(whole_run)).withColumn("run_first", F.min("first").over(whole_run)).withColumn(
        "run_end", F.max(F.col("first") + F.col("points")).over(whole_run))
    chunk = ~F.col("whole")
    goes = chunk & F.col("later") & (F.col("later_words") >= min_run_words)
    stands = chunk & F.col("shared") & (F.col("run_words") >= min_run_words)
    spans = F.array_sort(F.collect_set(F.when(goes, F.struct(F.col("run_first").alias("start"), F.col("run_end").alias("end")))))
    out = runs.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("whole"), F.col("words"))).cast("long").alias("n_words"),
        F.max(F.when(F.col("whole"), F.col("points"))).cast("long").alias("n_chunks"),
        F.sum(F.when(stands, F.col("words")).otherwise(0)).alias("n_repeated_words"),
        F.sum(F.when(goes, F.col("words")).otherwise(0)).alias("n_removed_words"), spans.alias("spans"))
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return out.select("doc_id", "n_words", "n_chunks", "n_repeated_words", "n_removed_words",
                      (F.col("n_repeated_words") > 0).alias("repeats"), text.alias("removed"), "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated passages cut out of the texts.
    Ids must be unique here; rows without id, and null and empty texts, stay as
    they are. An empty table gives an empty result. Columns may have any names."""
    plain, (ids, texts) = numbered(docs, id_col, text_col)
    spans = repeated_passages(plain, ids, texts, min_run_words).where("n_removed_words > 0").select(
        F.col("doc_id").alias("_cut_id"), F.col("spans").alias("_cut_spans"))
    joined = plain.join(spans, F.col(ids) == F.col("_cut_id"), "left")
    kept = F.aggregate(
        "_cut_spans", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["text"], F.substring(F.col(texts), a["at"] + 1, s["start"] - a["at"])).alias("text"),
                              s["end"].alias("at")),
        lambda a: F.concat(a["text"], F.substring(F.col(texts), a["at"] + 1, F.length(texts))))
    return joined.select(*[F.when(F.col("_cut_id").isNull(), F.col(c)).otherwise(kept).alias(c) if c == texts else F.col(c)
                           for c in plain.columns]).toDF(*docs.columns)
