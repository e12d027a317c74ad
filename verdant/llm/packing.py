"""Token ids of documents packed into rows of fixed length.

Every task tokenizes its own documents and packs them window by window (about a
million tokens) with best-fit-decreasing: pieces in order of falling length,
each into the open row with the least room that still holds it, found in a
segment tree over the rooms 0..length. Documents longer than a row are cut
into full rows and a rest, so nothing is lost. There is no shuffle, and memory
is bounded by the window; the rows that a window leaves open are at most a few
of thousands.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 2048
WINDOW_TOKENS = 1 << 20
PAD = 50256
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """Encoder of a rank file's content; one per process and vocabulary."""
    import tiktoken

    name = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if name not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


class RoomTree:
    """Segment tree over rooms 0..length: how many open rows have each room."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.base
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and gives (room, row) with the least room >= need."""
        count, node = self.count, need + self.base
        while not count[node]:
            while node & 1:  # a right child: nothing further right under its parent
                node >>= 1
                if node <= 1:
                    return None
            if node <= 1:
                return None
            node += 1  # the right sibling
        while node < self.base:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.base
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; sizes are from 1 to ``length``. Equal sizes keep
    their order, so the packing is a function of the sizes."""
    packed: list[list[int]] = []
    tree = RoomTree(length)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        found = tree.take(size) if size < length else None
        if found is None:
            room, row = length, len(packed)
            packed.append([])
        else:
            room, row = found
        packed[row].append(piece)
        if room > size:
            tree.add(room - size, row)
    return packed


def _pack(pieces: list[tuple[object, int, np.ndarray]], length: int, pad: int):
    """(n_tokens, ids, cu_seqlens, positions, doc ids, piece starts) of each row."""
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        held = [pieces[i] for i in row]
        sizes = np.array([len(p[2]) for p in held])
        ends = np.cumsum(sizes)
        ids = np.full(length, pad, np.int32)
        ids[:ends[-1]] = np.concatenate([p[2] for p in held])
        positions = np.zeros(length, np.int32)  # each segment counts from 0; the padding is 0
        positions[:ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        yield (int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], positions.tobytes(),
               [p[0] for p in held], [p[1] for p in held])


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                length: int = LENGTH, pad: int = PAD, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per packed row: ``pack_id`` (long, unique), ``n_tokens``,
    ``input_ids`` and ``position_ids`` (``length`` little-endian int32 each, a
    row of the id and position matrices), ``cu_seqlens`` (cumulative segment
    lengths from 0), ``doc_ids`` and ``starts`` (document of each segment and
    the number of its tokens before the segment).

    The segments of a document, ordered by start, are its tokens exactly.
    Null and empty texts have no tokens and appear in no row; a repeated row is
    packed again; an empty table gives an empty result. Other columns are not
    read. ``vocabulary`` is read by the driver and broadcast (about 1 MB)."""
    with open(vocabulary, "rb") as f:
        words = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    schema = (f"pack_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
              f"doc_ids array<{id_type}>, starts array<bigint>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(words.value).encode_ordinary
        first = TaskContext.get().partitionId() << 33
        pieces, held, done = [], 0, 0
        kind = None

        def emit():
            rows = list(zip(*_pack(pieces, length, pad)))
            n = len(rows[0])
            kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(kind), pa.list_(pa.int64()))
            return n, pa.RecordBatch.from_arrays(
                [pa.array(range(first + done, first + done + n), pa.int64())]
                + [pa.array(list(c), t) for c, t in zip(rows, kinds)],
                names=["pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array(encode(text.as_py() or ""), np.int32)
                for lo in range(0, len(ids), length):
                    pieces.append((key, lo, ids[lo:lo + length]))
                held += len(ids)
                if held >= window_tokens:
                    n, out = emit()
                    yield out
                    pieces, held, done = [], 0, done + n
        if pieces:
            yield emit()[1]

    return src.mapInArrow(pack, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: id matrix, cumulative lengths, positions."""
    packed.write.mode("overwrite").parquet(path)
