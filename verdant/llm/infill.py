"""Fill-in-the-middle: whole texts cut at two unit ends and put in another order.

A unit is a word with the blanks before it, or the blanks at a text's end. The
UTF-8 bytes of many texts are viewed as 64-bit words of eight bytes, and all
bytes of a word are classified at once by arithmetic (SWAR): blanks, then
bytes that end a unit (a non-blank byte before a blank one, and the last byte
of a text), each as the high bit of its byte. ``bitwise_count`` of each word
and one running sum turn "how many units before this byte" into a rank and
"where does unit k end" into a search for its word and an in-word select (eight prefix sums
by one multiplication). The same ranks over code-point starts count characters.

One map over the documents; nothing is shuffled or held beyond a slice of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import chunks, text_array

SEED = 42
#: Of 100 texts with units so many are cut, and of 100 cut ones so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_ONES, _LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_BYTE = np.uint64(8)


class Marks(NamedTuple):
    """Marked bytes (high bit of each) by word, and the number of marks before each word."""
    word: np.ndarray
    before: np.ndarray


def _counted(word: np.ndarray) -> Marks:
    return Marks(word, np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)]))


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, zeros behind them and one spare word."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def unit_ends(x: np.ndarray, bounds: np.ndarray) -> Marks:
    """Last bytes of the units of the texts between ``bounds``."""
    low = x & _LOW
    space = ~((low ^ (_ONES * np.uint64(0x20))) + _LOW)
    control = (low + _ONES * np.uint64(0x80 - 0x09)) & ~(low + _ONES * np.uint64(0x80 - 0x0E))
    blank = (space | control) & ~x & _HIGH
    next_blank = blank >> _BYTE
    next_blank[:-1] |= blank[1:] << np.uint64(56)
    ends = ~blank & next_blank & _HIGH
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * _BYTE))
    return _counted(ends)


def code_points(x: np.ndarray) -> Marks:
    """First bytes of code points: all but 10xxxxxx."""
    return _counted(~(x & ~(x << np.uint64(1))) & _HIGH)


def rank(marks: Marks, at: np.ndarray) -> np.ndarray:
    """Number of marks before each byte position."""
    inside = (np.uint64(1) << ((at & 7).astype(np.uint64) * _BYTE)) - np.uint64(1)
    return marks.before[at >> 3] + np.bitwise_count(marks.word[at >> 3] & inside)


def select(marks: Marks, k: np.ndarray) -> np.ndarray:
    """Byte position right behind the k-th mark (k from 1)."""
    word = np.searchsorted(marks.before, k, side="left") - 1
    within = (k - marks.before[word]).astype(np.uint64)
    sums = ((marks.word[word] >> np.uint64(7)) & _ONES) * _ONES  # byte j: marks in bytes 0 to j
    reached = ((sums | _HIGH) - within * _ONES) & _HIGH
    return word * 8 + 9 - np.bitwise_count(reached).astype(np.int64)


def _arrange(texts: pa.Array, draws: np.ndarray) -> Iterator[tuple[int, int, list]]:
    """(first row, end row, columns n, form, prefix_chars, middle_chars, output) by slices of text."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for lo, hi, data, bounds in chunks(texts):
        h = draws[lo:hi]
        x = as_words(data)
        ends, points = unit_ends(x, bounds), code_points(x)
        first = rank(ends, bounds[:-1])
        n = rank(ends, bounds[1:]) - first
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        cuts = [np.where(k > 0, select(ends, np.maximum(first + k, 1)), bounds[:-1]) if ends.before[-1] else bounds[:-1]
                for k in (np.minimum(one, two), np.maximum(one, two))]
        marked = pc.match_substring_regex(texts.slice(lo, hi - lo), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
        plain = (np.diff(bounds) == 0) | marked.to_numpy(zero_copy_only=False) | (h[:, 2] % 100 >= CUT_PERCENT)
        form = np.where(plain, "plain", np.where(h[:, 3] % 100 < SUFFIX_FIRST_PERCENT, "spm", "psm"))
        raw, out = data.tobytes(), []
        for a, b, c, d, f in zip(bounds[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), bounds[1:].tolist(), form):
            if f == "plain":
                out.append(raw[a:d])
            elif f == "psm":
                out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
            else:
                out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        at = [rank(points, cut) for cut in (bounds[:-1], *cuts)]
        yield lo, hi, [pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()),
                       pa.array((at[1] - at[0]).astype(np.int64), mask=plain),
                       pa.array((at[2] - at[1]).astype(np.int64), mask=plain),
                       pa.array(out, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, n`` (units of the whole text), ``form``
    (plain, psm or spm), ``prefix_chars, middle_chars`` (code points; null if
    plain) and ``output``.

    The draws come from the hex SHA-256 of ``seed:id``, so repeated rows and
    reruns agree; a null id counts as empty there. Null counts as the empty text, which is
    plain with no units; so is every text that holds one of the marks itself.
    A text of blanks is one unit. An empty table gives an empty result; other
    columns are neither read nor returned."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      F.unhex(F.substring(F.sha2(key, 256), 1, 32)).alias("draw"))

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.frombuffer(b"".join(batch.column("draw").to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
            for lo, hi, cols in _arrange(text_array(batch.column("text")), draws):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *cols],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return src.mapInArrow(arrange, f"doc_id {dict(src.dtypes)['doc_id']}, n bigint, form string, prefix_chars bigint, "
                                   "middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text from an ``output`` and its ``form``: a text with a mark
    of its own is plain, so the first of each mark is the one that was put there."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parts(mark: str) -> tuple[Column, Column]:
        body = F.substring(head, len(mark) + 1, 1 << 30)
        return F.substring_index(body, mark, 1), F.substring_index(body, mark, -1)

    (psm_prefix, psm_suffix), (spm_suffix, spm_prefix) = parts(SUFFIX), parts(PREFIX)
    return (F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix))
            .when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output))
