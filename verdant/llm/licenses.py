"""License scans: sparse TF-IDF cosine of lines and joined lines to license
notices and of whole texts to full license texts, then inheritance from the
nearest ancestor directory that holds a license file.

Two maps over whole texts: the first counts in how many lines each template
word occurs (as many numbers as the templates have words), the second weighs
every line, every run of up to ``MAX_LINES`` lines with words (a notice may be
wrapped) and the whole text. The words' products add up over lines and the
lines' squared lengths are at most the run's, so sums per line give a bound on
a run's cosine, and only runs that may reach the threshold are weighed. Only
verdicts and paths take part in the directory joins: license files are reduced to one row per
directory, the ancestors of each *distinct* directory are looked up once, and
documents then join their directory's row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import ALNUM_BYTES, LOWER, chunks, cut, small, span_indices, split_words, text_array

THRESHOLD = 0.6
FILE_SHARE = 0.5
#: Least cosine of a whole text to a full license text.
TEXT_THRESHOLD = 0.8
_BLOCK_LINES = 1 << 15
#: License notices as they are commonly written, per license.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.",
                 "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any "
            "purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "SPDX-License-Identifier: Unlicense"],
}
#: Lines with words that are joined at most for a wrapped notice: as many as the longest one has words.
MAX_LINES = max(len(t.split()) for notices in TEMPLATES.values() for t in notices)


@cache
def full_texts() -> dict[str, list[str]]:
    """Full license texts by license, from ``license_texts``."""
    return {f.name.removesuffix(".txt"): [f.read_text("utf-8")] for f in files("verdant.llm").joinpath("license_texts").iterdir()
            if f.name.endswith(".txt")}


def _words(data: np.ndarray, bounds: np.ndarray):
    return split_words(LOWER[data], bounds, ALNUM_BYTES)


class _Vocabulary:
    """Words of the templates (sorted hashes) and the templates' word counts."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = [k for k, texts in sorted(templates.items()) for _ in texts]
        texts = pa.array([t for _, v in sorted(templates.items()) for t in v], pa.large_utf8())
        (_, hi, data, bounds), = chunks(texts, 1 << 30)
        w = _words(data, bounds)
        self.hash, at = np.unique(w.hash, return_inverse=True)
        self.count = np.zeros((len(self.hash), hi))
        np.add.at(self.count, (at, w.row), 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)


class _Weights:
    """Normed template vectors for the rarity of words in a corpus: ``held`` of
    all ``lines`` hold each word; ``damped``: a word's times count by logarithm."""

    def __init__(self, vocabulary: _Vocabulary, held: np.ndarray, lines: int, damped: bool):
        self.vocabulary, self.damped = vocabulary, damped
        self.rarity = np.log((1 + lines) / (1 + held)) + 1
        self.other = float(np.log(1 + lines) + 1)  # words of no template weigh as the rarest
        weight = self._times(vocabulary.count) * self.rarity[:, None]
        self.weight = weight / np.sqrt((weight ** 2).sum(0))

    def _times(self, times: np.ndarray) -> np.ndarray:
        return np.log2(1 + times) if self.damped else times

    def products(self, group: np.ndarray, token: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Product of each of ``n`` groups (ascending) with every template, and the groups' squared lengths."""
        at = self.vocabulary.find(token)
        value = self._times(times) * np.where(at >= 0, self.rarity[at], self.other)
        known = np.flatnonzero(at >= 0)
        out = np.zeros((n, self.weight.shape[1]))
        if len(known):
            of = group[known]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[first]] = np.add.reduceat(value[known, None] * self.weight[at[known]], first)
        return out, np.bincount(group, weights=value ** 2, minlength=n)


def _cosines(products: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.round(products / np.maximum(np.sqrt(squares), 1e-12)[:, None], 9)


def _merged(group: np.ndarray, token: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, word hash, times) with one entry for each word of a group."""
    order = np.lexsort((token, group))
    group, token, times = group[order], token[order], times[order]
    begin = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (token[1:] != token[:-1])])[:len(group)])
    return group[begin], token[begin], np.add.reduceat(times, begin) if len(begin) else times


def _runs(weights: _Weights, line, token, times, row, products, squares, top, threshold: float):
    """(first line, lines, cosine, template) of runs of 2 to ``MAX_LINES`` lines
    of one row that reach the threshold and more than any run or line in them."""
    entry = np.searchsorted(line, np.arange(len(row) + 1))
    out = []
    for lo in range(0, max(len(row) - 1, 0), _BLOCK_LINES):
        hi = min(len(row), lo + _BLOCK_LINES + MAX_LINES - 1)
        total, square, within = products[lo:hi], squares[lo:hi], top[lo:hi]
        for k in range(2, min(MAX_LINES, hi - lo) + 1):
            total, square = total[:-1] + products[lo + k - 1:hi], square[:-1] + squares[lo + k - 1:hi]
            within = np.maximum(within[:-1], within[1:])
            bound = total.max(1) / np.sqrt(np.maximum(square, 1e-24))
            may = np.flatnonzero((row[lo:hi - k + 1] == row[lo + k - 1:hi]) & (bound >= threshold - 1e-6) & (bound > within - 1e-6))
            if not len(may):
                continue
            start, end = entry[lo + may], entry[lo + may + k]
            run, of = np.repeat(np.arange(len(may)), end - start), span_indices(start, end)
            cosine = _cosines(*weights.products(*_merged(run, token[of], times[of]), len(may)))
            best = cosine.argmax(1)
            score = cosine[np.arange(len(may)), best]
            more = (score >= threshold) & (score > within[may]) & (may < _BLOCK_LINES)  # the next block has the others
            out.append((lo + may[more], np.full(more.sum(), k), score[more], best[more]))
            within = within.copy()
            within[may] = np.maximum(within[may], score)
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]


def _lines(data: np.ndarray, bounds: np.ndarray):
    """(line, word hash, times) of the distinct words of each line with words,
    and those lines' rows, numbers in the row and words."""
    starts = np.union1d(bounds[:-1], np.flatnonzero(data == 10) + 1)
    starts = starts[starts < len(data)]
    w = _words(data, bounds)
    of = np.searchsorted(starts, w.start, side="right") - 1
    used, line = np.unique(of, return_inverse=True)
    row = np.searchsorted(bounds, starts[used], side="right") - 1
    number = used - np.searchsorted(starts, bounds[:-1])[row]
    order = np.lexsort((w.hash, line))
    line, token = line[order], w.hash[order]
    begin = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])])[:len(line)])
    times = np.diff(np.concatenate([begin, [len(line)]]))
    return line[begin], token[begin], times, row, number, np.bincount(line, minlength=len(used))


def _line_counts(texts: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """Lines that hold each of the words (sorted hashes), over all texts; lines with words."""
    n = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(text_array(batch.column("text"))):
                _, token, _, row, _, _ = _lines(data, bounds)
                at = np.minimum(np.searchsorted(words, token), n - 1)
                total[:n] += np.bincount(at[words[at] == token], minlength=n)
                total[n] += len(row)
        yield pa.RecordBatch.from_arrays([pa.array(range(n + 1), pa.int32()), pa.array(total)], names=["w", "c"])

    got = texts.mapInArrow(count, "w int, c bigint").groupBy("w").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(n + 1, np.int64)
    for r in got:
        out[r["w"]] = r["c"]
    return out[:n], int(out[n])


def own_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path",
                 templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD,
                 texts: dict[str, list[str]] | None = None, text_threshold: float = TEXT_THRESHOLD) -> DataFrame:
    """``doc_id, path, license, score, line, n_license_lines, is_file``: of a text
    whose cosine to a full license text (``texts``, ``full_texts()`` by default)
    reaches ``text_threshold``, that license and cosine, its first line with words
    and all of those; of others the best line or run of lines (``score`` its
    cosine, ``line`` the number of its first line; the first of equals) and the
    lines in any. ``is_file``: a full license text, or license lines hold half of its words."""
    notices, full = _Vocabulary(templates), _Vocabulary(full_texts() if texts is None else texts)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{path_col}`").cast("string").alias("path"),
                      F.col(f"`{text_col}`").alias("text"))
    every = np.union1d(notices.hash, full.hash)
    held, lines = _line_counts(src.select("text"), every)
    by_notice, by_text = (_Weights(v, held[np.searchsorted(every, v.hash)], lines, v is full) for v in (notices, full))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = batch.column("doc_id"), batch.column("path")
            for lo, hi, data, bounds in chunks(text_array(batch.column("text"))):
                n = hi - lo
                line, token, times, row, number, words = _lines(data, bounds)
                products, squares = by_notice.products(line, token, times, len(row))
                cosine = _cosines(products, squares)
                best = cosine.argmax(1) if len(row) else np.zeros(0, np.int64)
                top = cosine[np.arange(len(row)), best]
                alone = np.flatnonzero(top >= threshold)
                first, size, run_top, run_best = _runs(by_notice, line, token, times, row, products, squares, top, threshold)
                hit, size = np.concatenate([alone, first]), np.concatenate([np.ones(len(alone), np.int64), size])
                top, best = np.concatenate([top[alone], run_top]), np.concatenate([best[alone], run_best])
                inside = np.zeros(len(row) + 1, np.int64)
                np.add.at(inside, hit, 1)
                np.add.at(inside, hit + size, -1)
                inside = np.cumsum(inside[:-1]) > 0
                order = np.lexsort((number[hit], -top, row[hit]))
                chosen = np.full(n, -1)
                if len(order):
                    begin = np.concatenate([[True], row[hit[order]][1:] != row[hit[order]][:-1]])
                    chosen[row[hit[order]][begin]] = order[begin]
                has = chosen >= 0
                pick = np.where(has, chosen, 0)
                get = lambda x: x[pick] if len(x) else np.zeros(n, x.dtype)
                all_words = np.bincount(row, weights=words, minlength=n)
                license_words = np.bincount(row[inside], weights=words[inside], minlength=n)
                whole = _cosines(*by_text.products(*_merged(row[line], token, times), n))
                nearest = whole.argmax(1)
                whole = whole[np.arange(n), nearest]
                is_text = whole >= text_threshold
                started = np.minimum(np.searchsorted(row, np.arange(n)), max(len(row) - 1, 0))
                found = has | is_text
                at = np.where(is_text, number[started] if len(row) else 0, get(number[hit]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), paths.slice(lo, n),
                     pa.array([full.names[f] if t else notices.names[b] if ok else None
                               for f, t, b, ok in zip(nearest, is_text, get(best), has)], pa.string()),
                     pa.array(np.where(is_text, whole, get(top)), mask=~found), pa.array(at.astype(np.int32), mask=~found),
                     pa.array(np.where(is_text, np.bincount(row, minlength=n), np.bincount(row[inside], minlength=n))),
                     pa.array(is_text | (has & (license_words >= FILE_SHARE * all_words)))],
                    names=["doc_id", "path", "license", "score", "line", "n_license_lines", "is_file"])

    return src.mapInArrow(score, f"doc_id {dict(src.dtypes)['doc_id']}, path string, license string, score double, "
                                 "line int, n_license_lines bigint, is_file boolean")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path",
                 templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``doc_id, license, origin, score, line, n_license_lines,
    is_file, from_dir``. ``origin`` is "own" (a line, a run of lines or the whole text matches),
    "inherited" (from the nearest ancestor directory of ``path`` with a license
    file, ``from_dir``) or null (no license).

    A directory with several license files has the license of the first path,
    then of the first license. Null and empty texts have no lines; a null path
    is in no directory, one without "/" in the root "". Repeated rows come back
    as often as they came in; an empty table gives an empty result. Other
    columns are neither read nor returned."""
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    found = cut(own_licenses(docs, id_col, text_col, path_col, templates, threshold).withColumn("dir", parent))
    files = found.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(
        F.min(F.struct("path", "license")).alias("f")).select(F.col("dir").alias("from_dir"), F.col("f.license").alias("inherited"))
    names = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.array_union(F.array(F.lit("")), above))
    ancestors = found.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct().select(
        "dir", F.explode(above).alias("from_dir"))
    nearest = cut(ancestors.join(files, "from_dir").groupBy("dir").agg(
        F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "inherited")).alias("n"))
        .select(F.col("dir").alias("d"), "n.from_dir", "n.inherited"))
    out = found.join(small(nearest), F.col("license").isNull() & (F.col("dir") == F.col("d")), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
    return out.select("doc_id", F.coalesce("license", "inherited").alias("license"), origin.alias("origin"), "score", "line",
                      "n_license_lines", "is_file", "from_dir")
