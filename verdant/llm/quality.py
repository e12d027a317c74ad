"""Quality rules: fixed limits, then robust multivariate outliers.

One map gives every text its counts and a vector of transformed statistics.
Per language and source the vectors get a minimum-covariance-determinant
estimate: from medians and median deviations, C-steps take the three quarters
of the rows with the smallest Mahalanobis distance, and their mean and
covariance for the next step. Texts far from their group's estimate go.

A step is two small aggregations over the stored vectors (no texts): counts per
(group, bin of the distance), which give the group's limit, and the moments of
the rows within it. Both are reduced map-side, so a source with a third of all
rows is as cheap as any other; a group's few thousand bins are all that ever
meet in one task. Groups of fewer than ``MIN_GROUP`` rows are pooled by
language, what is left over all languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm.common import WORD_BYTES, chunks, cut, small, span_hashes, split_words, text_array

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
SUPPORT = 0.75
STEPS = 6
MIN_GROUP = 60
#: A clean vector is beyond the cut about once in so many times.
TAIL = 1e-6
#: Least standard deviation of each statistic: what differs by less is no sign of bad quality.
#: In a group without spread each statistic alone can pass the cut: the limits of repeated
#: lines and words are bounded (log1p(100), and sqrt(0.2) by the base rule), and their floors suit them.
FLOORS = (0.05, 0.5, 0.65, 0.075, 0.08, 0.05)
#: Repeated lines and words: the words of a repeated line are repeated words too, so both together are not two signs.
REPEAT_CORRELATION = 0.6
BINS_PER_OCTAVE = 32
_D = len(FLOORS)
_FLOOR = np.diag(np.square(FLOORS))
_FLOOR[2, 3] = _FLOOR[3, 2] = REPEAT_CORRELATION * FLOORS[2] * FLOORS[3]
_X = [f"x{i}" for i in range(_D)]
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _in(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_SYMBOL, _PUNCT = _in(SYMBOLS), _in(".,;:!?")
_POINT = (np.arange(256) & 0xC0) != 0x80


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[bounds])


def _repeated(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Number in its (row, value) group of every element, 0 first, and the group's size."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])[:len(order)]
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [len(order)]]))
    place, total = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(start, size)
    total[order] = np.repeat(size, size)
    return place, total


def text_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every row of a chunk (see ``quality``)."""
    n = len(bounds) - 1
    w = split_words(data, bounds)
    words = np.bincount(w.row, minlength=n)
    k = REPEAT_WINDOW
    covered = np.zeros(len(w.row) + 1, np.int64)
    if len(w.row) >= k:
        first = np.flatnonzero(w.row[:len(w.row) - k + 1] == w.row[k - 1:])
        value = np.zeros(len(first), np.uint64)
        for j in range(k):
            value = value * np.uint64(0x9E3779B97F4A7C15) + w.hash[first + j]
        again = first[_repeated(w.row[first], value)[1] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + k, -1)
    in_repeat = np.cumsum(covered[:-1]) > 0
    # lines: a row's start or what follows a newline, to the next newline or the row's end
    newline = data == 10
    start = np.union1d(bounds[:-1], np.flatnonzero(newline) + 1)
    start = start[start < len(data)]
    end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
    end = end - newline[np.maximum(end - 1, 0)] if len(start) else end
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[worded], end[worded]
    line_row = np.searchsorted(bounds, start, side="right") - 1
    dup = _repeated(line_row, span_hashes(data, start, end))[0] > 0
    return {
        "n_words": words,
        "word_chars": _per_row(WORD_BYTES[data] & _POINT[data], bounds),
        "n_symbols": _per_row(_SYMBOL[data], bounds),
        "n_dup_lines": np.bincount(line_row[dup], minlength=n),
        "n_repeat_words": np.bincount(w.row[in_repeat], minlength=n),
        "lines": np.bincount(line_row, minlength=n),
        "chars": _per_row(_POINT[data], bounds),
        "stutter": np.bincount(w.row[1:][(w.row[1:] == w.row[:-1]) & (w.hash[1:] == w.hash[:-1])], minlength=n),
        "punct": _per_row(_PUNCT[data], bounds),
    }


def _vector(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Transformed statistics, drawn to a common value where a text is short:
    mean word length, symbols, repeated lines, repeated words, words equal to the
    one before, punctuation."""
    return [
        np.log((c["word_chars"] + 250) / (c["n_words"] + 50)),
        np.log1p(1000 * c["n_symbols"] / (c["chars"] + 200)),
        np.log1p(100 * c["n_dup_lines"] / (c["lines"] + 10)),
        np.sqrt(c["n_repeat_words"] / (c["n_words"] + 20)),
        np.sqrt(c["stutter"] / (c["n_words"] + 20)),
        np.sqrt((c["punct"] + 5) / (c["n_words"] + 50)),
    ]


def _measured(docs: DataFrame) -> DataFrame:
    types = dict(docs.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in ("doc_id", "lang", "source")]
                       + [f"{c} bigint" for c in _COUNTS] + [f"{x} double" for x in _X])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_counts(data, bounds) for _, _, data, bounds in chunks(text_array(batch.column("text")))]
            c = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
                 for k in (*_COUNTS, "lines", "chars", "stutter", "punct")}
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("doc_id", "lang", "source")] + [pa.array(c[k], pa.int64()) for k in _COUNTS]
                + [pa.array(x, pa.float64()) for x in _vector(c)],
                names=["doc_id", "lang", "source", *_COUNTS, *_X])

    return docs.mapInArrow(measure, schema)


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with the group ``g`` of their estimate."""
    sizes = cut(rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    rest = sizes.where(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("m"))
    rest = rest.select(F.col("lang").alias("l"), "m")
    groups = cut(sizes.join(small(cut(rest)), F.col("lang").eqNullSafe(F.col("l")), "left").select(
        F.col("lang").alias("l"), F.col("source").alias("s"),
        F.when(F.col("n") >= MIN_GROUP, F.xxhash64(F.lit(2), "lang", "source"))
        .when(F.col("m") >= MIN_GROUP, F.xxhash64(F.lit(1), "lang")).otherwise(F.lit(0).cast("long")).alias("g")))
    return rows.join(small(groups), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")),
                     "left").drop("l", "s")


def _distance() -> Column:
    terms = []
    for i in range(_D):
        for j in range(i, _D):
            times = 1 if i == j else 2
            terms.append(f"{times} * inv[{i * _D + j}] * (x{i} - mu[{i}]) * (x{j} - mu[{j}])")
    return F.greatest(F.expr(" + ".join(terms)), F.lit(0.0))


def _bin(d2) -> Column:
    return F.floor(F.log2(d2 + 1e-9) * BINS_PER_OCTAVE)


def _quantile(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """Per group the first bin up to which at least ``share`` of the rows are."""
    up = Window.partitionBy(*by).orderBy("bin")
    whole = Window.partitionBy(*by)
    return (counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(whole))
            .where(F.col("upto") >= F.ceil(F.col("n") * share)).groupBy(*by).agg(F.min("bin").alias("at"), F.max("n").alias("n")))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and squared median deviations of every statistic, from counts of
    values in steps of 1/512."""
    step = 512.0
    long = rows.select("g", F.posexplode(F.array(*_X)).alias("i", "x"))
    med = cut(_quantile(long.groupBy("g", "i", F.floor(F.col("x") * step).alias("bin")).agg(F.count(F.lit(1)).alias("c")),
                        ["g", "i"], 0.5).select("g", "i", (F.col("at") / step).alias("med")))
    off = long.join(small(med), ["g", "i"]).select("g", "i", F.floor(F.abs(F.col("x") - F.col("med")) * step).alias("bin"))
    mad = _quantile(off.groupBy("g", "i", "bin").agg(F.count(F.lit(1)).alias("c")), ["g", "i"], 0.5).select(
        "g", "i", (F.col("at") / step * 1.4826).alias("mad"))

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        inv = np.linalg.inv(np.diag(pdf["mad"].to_numpy() ** 2) + _FLOOR)
        return pd.DataFrame({"g": [pdf["g"].iat[0]], "mu": [pdf["med"].tolist()], "inv": [inv.ravel().tolist()]})

    return med.join(mad, ["g", "i"]).groupBy("g").applyInPandas(shape, "g bigint, mu array<double>, inv array<double>")


def _c_step(rows: DataFrame, shape: DataFrame) -> DataFrame:
    placed = rows.join(small(shape), "g").withColumn("bin", _bin(_distance()))
    limit = cut(_quantile(placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("c")), ["g"], SUPPORT).select("g", "at"))
    # moments about the current centre, which keeps the sums exact enough
    moved = placed.join(small(limit), "g").where("bin <= at").select(
        "g", "mu", *[(F.col(x) - F.col("mu")[i]).alias(x) for i, x in enumerate(_X)])
    sums = moved.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.first("mu").alias("mu"), F.array(*[F.sum(x) for x in _X]).alias("s"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in _X for b in _X]).alias("ss"))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mus, invs = [], []
            for n, mu, s, ss in zip(*(batch.column(c).to_pylist() for c in ("n", "mu", "s", "ss"))):
                mean = np.array(s) / n
                cov = np.array(ss).reshape(_D, _D) / n - np.outer(mean, mean)
                mus.append((np.array(mu) + mean).tolist())
                invs.append(np.linalg.inv(cov + _FLOOR).ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), pa.array(mus, pa.list_(pa.float64())), pa.array(invs, pa.list_(pa.float64()))],
                names=["g", "mu", "inv"])

    return sums.mapInArrow(shaped, "g bigint, mu array<double>, inv array<double>")


def chi2_quantile(p_upper: float, d: int) -> float:
    """Wilson-Hilferty."""
    z = NormalDist().inv_cdf(1 - p_upper)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source", steps: int = STEPS, tail: float = TAIL) -> DataFrame:
    """One row per row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance`` (squared Mahalanobis distance
    over the group's cut; above 1 the text goes; null where ``base_failed``).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have no words and fail. Null
    languages and sources are values like others. Groups are pooled as the
    module says; a group of fewer than 20 rows rejects nothing. Repeated rows
    come back as often as they came in; an empty table gives an empty result.
    Other columns are neither read nor returned."""
    src = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in
                        ((id_col, "doc_id"), (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = cut(_grouped(cut(_measured(src).withColumn("base_failed", failed))))
    fit = rows.where("NOT base_failed")
    shape = cut(_start(fit))
    for _ in range(steps):
        shape = cut(_c_step(fit, shape))
    placed = fit.join(small(shape), "g").withColumn("bin", _bin(_distance()))
    half = _quantile(placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("c")), ["g"], 0.5)
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.col("at") / BINS_PER_OCTAVE) / chi2_quantile(0.5, _D))
    limit = cut(half.join(shape, "g").select("g", "mu", "inv", F.when(F.col("n") >= 20, scale * chi2_quantile(tail, _D)).alias("limit")))
    far = F.when(~F.col("base_failed"), _distance() / F.col("limit"))
    return rows.join(small(limit), "g", "left").withColumn("distance", far).select(
        "doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce(F.col("distance") > 1, F.lit(False))).alias("kept"),
        "distance")
