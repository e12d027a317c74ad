"""Secret scans with multipart credential linking.

One map over the whole texts finds the parts of credentials: access
identifiers, secrets and endpoints, each with its span and its scope (a block
of lines without a blank line between them). Parts that stand for themselves
(the base kinds) are always reported. Weak parts - a login name, a random-looking
word, a network address - are reported only where a complementary part lies
in the same scope (and within ``max_gap`` code points, if that is given): an
identifier or an endpoint with a secret. That interval join is a sweep over the parts of a scope in
order of position: the nearest complementary part before and after each part
decides, so a scope full of parts costs a sort, never its pairs. Only parts
are shuffled, never texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm.common import cut

#: The base kinds, in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "login", "random", "endpoint")

#: Names may follow a prefix, as in DB_USER; connection strings write them as one or two words.
_LOGIN = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:[\x20_]?(?:name|id))?|uid|login|account(?:_?name|_id)?|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{2,}""",
                    re.IGNORECASE | re.ASCII)
#: Random words also begin right after the "=" or ":" of an assignment.
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
_URL = re.compile(r"""(?<![A-Za-z0-9+])[A-Za-z][A-Za-z0-9+]{1,15}://[^\s"'<>]{3,}""", re.ASCII)
_HOST = re.compile(r"""(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?(?:tcp:)?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?""",
                   re.IGNORECASE | re.ASCII)
_BREAK = re.compile(r"\n[\x20\t\r]*\n")


def _mixed(word: str) -> bool:
    """Digits, capitals and small letters in one word, as random keys have."""
    return (any(c.isdigit() for c in word) and any("a" <= c <= "z" for c in word)
            and any("A" <= c <= "Z" for c in word) and len(set(word)) >= 10)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds in code points, leftmost and not
    overlapping within a kind."""
    pairs = ASSIGN.finditer(text) if "=" in text or ":" in text else ()
    out = [(0, *m.span()) for m in pairs if len(m[2]) >= 6]
    out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(2, *m.span()) for m in HEX.finditer(text)]


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, scope) of base parts and weak candidates."""
    base = base_spans(text)
    weak = []
    if "=" in text or ":" in text:
        weak += [(3, *m.span()) for m in _LOGIN.finditer(text)]
        weak += [(5, *m.span()) for m in _HOST.finditer(text)]
    if "://" in text:
        weak += [(5, *m.span()) for m in _URL.finditer(text)]
    taken = sorted((s, e) for _, s, e in base + weak)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in _RANDOM.finditer(text):  # outside all other parts
        at = bisect_left(starts, m.end())
        if _mixed(m[0]) and not (at and reach[at - 1] > m.start()):
            weak.append((4, *m.span()))
    found = sorted(base + weak, key=lambda p: (p[1], p[0]))
    breaks = [m.end() for m in _BREAK.finditer(text)] if found else []
    scope, out = 0, []
    for kind, start, end in found:
        while scope < len(breaks) and breaks[scope] <= start:
            scope += 1
        out.append((kind, start, end, scope))
    return out


def _joined(spans) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (s["kind"] + 1).cast("int")),
        s["start"].cast("string"), s["end"].cast("string"))))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_gap: int | None = None) -> DataFrame:
    """One row per row: ``doc_id, n_assign, n_access, n_hex`` (base kinds),
    ``base_sha256`` and ``spans`` (base and linked weak spans as
    ``kind:start:end`` by start, then kind; code points, end exclusive),
    ``n_linked`` (weak spans reported) and ``found`` (the spans as structs).

    Null counts as the empty text; texts without parts have zero counts and
    empty spans. Repeated rows come back as often as they came in; an empty
    table gives an empty result. Other columns are neither read nor returned."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "scope"), p)) for p in parts(t.as_py() or "")]
                     for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, shape)], names=["doc_id", "parts"])

    scanned = src.mapInArrow(scan, f"doc_id {id_type}, parts array<struct<kind:int,start:bigint,end:bigint,scope:bigint>>")
    # Small (no texts): computed once, with the row numbers that the join uses.
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    has_weak = F.exists("parts", lambda p: p["kind"] > 2)
    done = scanned.where(~has_weak).select("doc_id", F.col("parts").alias("p"))
    linked = _linked(scanned.where(has_weak).select("row", "doc_id", F.explode("parts").alias("part"))
                     .select("row", "doc_id", "part.*"), max_gap)
    found = F.array_sort(F.transform("p", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return done.unionByName(linked).select("doc_id", found.alias("found")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda s: s["kind"] <= 2)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["kind"] > 2)).cast("long").alias("n_linked"), "found")


def _linked(rows: DataFrame, max_gap: int | None) -> DataFrame:
    """The interval join: (doc_id, parts that stay) of each row. A secret needs
    another role in its scope (near it, if there is a ``max_gap``), an identifier or endpoint a secret."""
    role = F.when(F.col("kind").isin(1, 3), "id").when(F.col("kind").isin(0, 2, 4), "secret").otherwise("endpoint")
    is_secret = role == "secret"
    where = Window.partitionBy("row", "scope").orderBy("start", "kind", "end")
    before, after = where.rowsBetween(Window.unboundedPreceding, -1), where.rowsBetween(1, Window.unboundedFollowing)

    def near(of):
        gap_before = F.col("start") - F.max(F.when(of, F.col("end"))).over(before)
        gap_after = F.min(F.when(of, F.col("start"))).over(after) - F.col("end")
        if max_gap is None:
            return gap_before.isNotNull() | gap_after.isNotNull()
        return (F.coalesce(gap_before <= max_gap, F.lit(False)) | F.coalesce(gap_after <= max_gap, F.lit(False)))

    kept = (F.col("kind") <= 2) | F.when(is_secret, F.col("by_other")).otherwise(F.col("by_secret"))
    one = F.struct("kind", "start", "end", "scope")
    return (rows.repartition("row")
            .withColumn("by_secret", near(is_secret)).withColumn("by_other", near(~is_secret))
            .groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.when(kept, one)).alias("p"))
            .select("doc_id", "p"))
