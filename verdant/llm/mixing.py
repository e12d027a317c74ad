"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / quality`` (u from a hash of id and text,
so reruns agree); within its source documents are taken in key order until the
source's token budget is met. Whole epochs come first, the fraction that is
left is selected by key.

No source is ever sorted whole, since one source may hold a third of all rows.
Key order and prefix sums are taken over bins of the key's logarithm: sizes
are pre-aggregated per (source, bin), a running sum over the few thousand bins
of a source finds the bin in which the budget ends, and only the documents of
that one bin are sorted. The outcome is one cut key per source; every document
then decides for itself against its source's cut, in a map-side join where the
table of sources is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm.common import chunks, cut, numbered, small, split_words, text_array

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BINS_PER_OCTAVE = 512
_CLEAN = np.array([b >= 0x80 or chr(b).isalpha() or chr(b) in " \t\n\v\f\r.,;:?!'\"-" for b in range(256)])


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """``docs`` with ``_mix_id, _mix_source, _mix_size, _mix_key, _mix_tie``."""
    src = docs.select(
        "*", F.col(f"`{id_col}`").alias("_mix_id"), F.col(f"`{source_col}`").alias("_mix_source"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_mix_text"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_mix_tie"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, clean, held = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for lo, hi, data, bounds in chunks(text_array(batch.column("_mix_text"))):
                size[lo:hi] = np.bincount(split_words(data, bounds).row, minlength=hi - lo)
                total = np.concatenate([[0], np.cumsum(_CLEAN[data])])
                clean[lo:hi], held[lo:hi] = np.diff(total[bounds]), np.diff(bounds)
            # quality weight: squared share of letters, blanks and plain punctuation, 1/4 at least
            quality = np.maximum(0.25, np.where(held > 0, clean / np.maximum(held, 1), 1.0) ** 2)
            tie = np.asarray(batch.column("_mix_tie")).view(np.uint64)
            u = ((tie >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            keep = [i for i, c in enumerate(batch.schema.names) if c != "_mix_text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(size), pa.array(-np.log(u) / quality)],
                names=[batch.schema.names[i] for i in keep] + ["_mix_size", "_mix_key"])

    schema = src.drop("_mix_text").schema.add("_mix_size", "long").add("_mix_key", "double")
    return src.mapInArrow(measure, schema)


def _ranked_weights(sources: DataFrame, weights) -> DataFrame:
    """Weight of each source by its place in code-point order, null last. The
    sort is by range, and places come from the row counts of the sorted
    partitions (as many numbers as partitions reach the driver)."""
    placed = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).agg(F.count(F.lit(1))).collect())
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    offsets = placed.sparkSession.createDataFrame(rows, "_part bigint, _before bigint")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).select("source", "source_size", pick.alias("w"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): ``share`` of all
    sizes dealt by weight; a target stops at ``epochs`` times its source's size
    and the excess is reshared by weight until none is above."""
    src = cut(_ranked_weights(sizes, weights))
    cap = F.col("source_size") * F.lit(float(epochs))
    goal = share * float(src.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:  # each turn caps at least one more source, or ends
        over = F.lit(False) if level is None else F.col("w") * level > cap
        held, open_w = src.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(~over, F.col("w")).otherwise(0.0))).first()
        now = math.inf if not open_w else (goal - held) / open_w
        if now == level:
            break
        level = now
    target = cap if level == math.inf else F.least(F.col("w") * level, cap)
    return src.select("source", "source_size", target.cast("double").alias("target"))


def _plan(rows: DataFrame, weights, share: float, epochs: int) -> DataFrame:
    """Per source: size, target, whole epochs, and the cut of the fraction:
    keys up to ``cut_key`` are in, the documents at it share ``rest`` words."""
    bins = cut(rows.withColumn("bin", F.floor(F.log2("_mix_key") * BINS_PER_OCTAVE))
               .groupBy(F.col("_mix_source").alias("source"), "bin").agg(F.sum("_mix_size").alias("held")))
    goal = targets(bins.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = cut(goal.withColumn("epochs", whole).withColumn(
        "budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = (bins.withColumn("before", F.coalesce(F.sum("held").over(up), F.lit(0)))
            .join(goal.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
            .where("before < budget AND budget <= before + held")
            .select("source", "bin", (F.col("budget") - F.col("before")).alias("left")))
    ends = cut(ends)
    tied = (rows.withColumn("at", F.floor(F.log2("_mix_key") * BINS_PER_OCTAVE))
            .join(small(ends), F.col("_mix_source").eqNullSafe(F.col("source")) & (F.col("at") == F.col("bin")))
            .groupBy("source", "left", "_mix_key").agg(F.sum("_mix_size").alias("held")))
    within = Window.partitionBy("source").orderBy("_mix_key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (tied.withColumn("before", F.coalesce(F.sum("held").over(within), F.lit(0)))
            .where("before < left AND left <= before + held")
            .select(F.col("source").alias("s"), F.col("_mix_key").alias("cut_key"),
                    (F.col("left") - F.col("before")).alias("rest"), F.col("held").alias("at_cut")))
    return cut(goal.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget"))


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    key, size = F.col("_mix_key"), F.col("_mix_size")
    # Documents with the very same key share the words that are left at the cut.
    at_cut = F.floor(F.col("_mix_rest") * size / F.greatest("_mix_at_cut", F.lit(1))).cast("long")
    part = (F.when(F.col("_mix_cut_key").isNull() | (key > F.col("_mix_cut_key")), F.lit(0).cast("long"))
            .when(key < F.col("_mix_cut_key"), size).otherwise(at_cut))
    plan = plan.select(*[F.col(c).alias(f"_mix_{'s' if c == 'source' else c}") for c in plan.columns])
    return rows.join(small(plan), F.col("_mix_source").eqNullSafe(F.col("_mix_s"))).withColumn("_mix_part", part)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, source,
    epochs``. ``size`` counts ``[^\\x20\\x09-\\x0D]+`` (null: 0). ``taken`` is the
    words the mix takes, repeats counted: whole epochs of the source, then the
    documents of smallest key; the one at which the budget ends gives just the
    words that are left, so a source's taken words are its rounded target.
    Documents with one key (rows that repeat id and text) share those words
    evenly, rounded down. The null source is a source, last in order; empty
    texts have size 0; an empty table gives an empty result. Other columns are
    neither read nor returned."""
    rows = cut(_sized(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                                  F.col(f"`{text_col}`").alias("text")), "doc_id", "source", "text", seed)
               .select("_mix_id", "_mix_source", "_mix_size", "_mix_key"))
    out = _decided(rows, _plan(rows, weights, share, epochs))
    return out.select(
        F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_epochs") * F.col("_mix_size") + F.col("_mix_part")).alias("taken"),
        F.col("_mix_source").alias("source"), F.col("_mix_epochs").alias("epochs"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document comes
    once per epoch, and once more if the fraction takes at least half of it
    (texts stay whole). Nulls, ties, repeated rows and sources as in ``mix``;
    documents without words are in no fraction, and so come once per whole epoch. An empty table
    gives an empty result. Columns may have any names."""
    plain, (ids, sources, texts) = numbered(docs, id_col, source_col, text_col)
    sized = _sized(plain, ids, sources, texts, seed)
    rows = cut(sized.select("_mix_source", "_mix_size", "_mix_key"))
    out = _decided(sized, _plan(rows, weights, share, epochs))
    more: Column = (F.col("_mix_part") > 0) & (F.col("_mix_part") * 2 >= F.col("_mix_size"))
    copies = (F.col("_mix_epochs") + more.cast("long")).cast("int")
    return (out.where(copies > 0).withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies)))
            .select(*plain.columns).toDF(*docs.columns))
