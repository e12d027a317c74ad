"""Delimited-text source (S1, S2) and preview (S3).

* Strategies: ``,``, a sniffed delimiter, ``;`` and tab are tried in this
  order, and the first parse with rows is taken; if none has any, the error
  names the last cause (``strict_order=False`` sniffs first; ``sep`` tries
  nothing else).
* Rows with more fields than the header are dropped, whatever columns a query
  selects; short rows are padded with nulls. If the *first* row has k fields
  more than the header, k leading fields of every row are an index and no columns.
* A quote within a quoted field is doubled. Quoted line breaks are found
  without giving up splits (``sources/records.py``).
* Header names are trimmed; a repeated name gets ``.1``, ``.2``, a blank one
  is ``Unnamed: i``. ``_row_id`` is the order of rows, file by file in the
  order of their paths.
* Types are given by ``schema``, or decided the way a pandas read decides them
  (see ``read_delimited``): one aggregation pass over the text fields.
"""

from __future__ import annotations

import csv
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from verdant.fixed import CSV_NA_TOKENS
from verdant.functions.names import named
from verdant.functions.numeric import NUMERIC_TEXT, to_num
from verdant.plans.ordinal import global_rank
from verdant.sources.records import any_open_quotes, escaped, path_key, records, text_lines

#: Delimiters in the order of the strategies; None stands for the sniffed one.
STRATEGIES = (",", None, ";", "\t")
CANDIDATES = (",", ";", "\t", "|", ":")
#: Lines of the first file that the header, the first row and the delimiter are taken from.
HEAD_LINES = 200
_PLACE = ["_file", "_block", "_place"]


class DelimitedReadError(ValueError):
    pass


def _failed(cause: str) -> DelimitedReadError:
    return DelimitedReadError(f"Failed to parse CSV. Last error: {cause}")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of every file, from Spark's own listing; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path").distinct()


def _head(spark: SparkSession, path: str) -> list[str]:
    """The first lines of the first file that has any."""
    first = _listing(spark, path).agg(F.min("path")).first()[0]
    if first is None:
        raise _failed(f"No columns to parse from file {path}")
    return [r.value.removesuffix("\r") for r in spark.read.option("lineSep", "\n").text(first).limit(HEAD_LINES).collect()]


def _parsed(lines: list[str], sep: str) -> list[list[str]]:
    return [r for r in csv.reader([x + "\n" for x in lines], delimiter=sep) if any(c.strip() for c in r) or len(r) > 1]


def sniff_delimiter(lines: list[str]) -> str:
    """The candidate that splits the sampled records most evenly: the share of
    records with the most frequent number of fields, if that is more than one; between equals the one
    with more fields, then the earlier candidate."""
    best = (0.0, 1, ",")
    for sep in CANDIDATES:
        try:
            sizes = Counter(len(r) for r in _parsed(lines, sep))
        except csv.Error:
            continue
        if sizes:
            fields, times = max(sizes.items(), key=lambda x: (x[1], x[0]))
            if fields > 1 and (score := (times / sizes.total(), fields)) > best[:2]:
                best = (*score, sep)
    if best[0] == 0.0:
        raise _failed("Could not determine delimiter")
    return best[2]


def _names(header: list[str | None]) -> list[str]:
    """Trimmed header names, made distinct."""
    out: list[str] = []
    for i, raw in enumerate(header):
        name = (raw or "").strip() or f"Unnamed: {i}"
        times = 0
        while (free := name if not times else f"{name}.{times}") in out:
            times += 1
        out.append(free)
    return out


def _with_row_id(df: DataFrame, path: str) -> DataFrame:
    """``_row_id`` from the file's rank among the paths, the place of the split
    in its file and the row's place in the split. Rows are at least one byte
    long, so the three add up in order. Ranks come from a distributed range
    sort; Spark broadcasts them only if they are few by its own estimate."""
    ranks = global_rank(_listing(df.sparkSession, path), [("path", "asc")]).select(
        path_key("path").alias("_ranked"), F.col("rank").alias("_rank"))
    placed = df.join(ranks, F.col("_file") == F.col("_ranked"))
    row_id = (F.col("_rank") - 1) * F.lit(1 << 44) + F.col("_block") + F.col("_place")
    return placed.withColumn("_row_id", row_id).drop(*_PLACE, "_ranked", "_rank")


def _fields(spark: SparkSession, path: str, sep: str, width: int, multi_line: bool) -> DataFrame:
    """Text fields ``_f0`` ... of all rows that don't have more than ``width``, and their place."""
    raw = [f"_f{i}" for i in range(width)]
    schema = StructType([StructField(c, StringType(), True) for c in [*raw, "_bad"]])
    options = dict(sep=sep, mode="PERMISSIVE", quote='"', escape='"', columnNameOfCorruptRecord="_bad",
                   ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    if multi_line:
        df = records(spark, path, sep).select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"),
                                              *_PLACE).select("r.*", *_PLACE)
    else:
        df = spark.read.options(header=True, **options).schema(schema).csv(path).select(
            "*", path_key("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    # A flagged row is dropped only when it has too many fields (quotes aside);
    # short rows stay, padded with nulls. The test names every field, so the
    # reader parses whole rows for any selection of columns.
    found = F.size(F.split(F.regexp_replace("_bad", r'"(?:[^"]|"")*"', ""), escaped(sep), -1))
    whole = F.length(F.concat_ws("", *raw)) >= 0  # always true
    df = df.where(whole & (F.col("_bad").isNull() | (found <= width)))
    if not multi_line:
        df = df.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return df.drop("_bad")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, strict_order: bool = True,
                   require_rows: bool = True, multi_line: bool | None = None, schema: dict[str, str] | None = None) -> DataFrame:
    """Read a delimited file or folder (see module doc); a file without data
    rows is an error, as every parse strategy comes back empty
    (``require_rows=False`` gives the last strategy's empty table).

    Types follow a pandas read rather than Spark's CSV inference (which
    would read ``1d`` as 1.0): every field is read as text, the default
    missing-value tokens (``nan``, ``n/a``, ``NULL``, ...) become null, and
    a column is numeric when all its other values are plain numbers (one
    aggregation over the data decides this for all columns at once);
    integral without gaps -> BIGINT, else DOUBLE; an all-missing column is
    numeric (DOUBLE). ``schema`` (column -> Spark SQL type; others stay text)
    saves that pass; values that don't fit their type become null.

    ``multi_line`` says whether quoted fields hold line breaks; by default one
    scan of the lines, which ends with the first open quote, finds out."""
    lines = _head(spark, path)
    if not any(x.strip() for x in lines):
        raise _failed(f"No columns to parse from file {path}")
    chain = [sep] if sep else list(STRATEGIES) if strict_order else [None, *(s for s in STRATEGIES if s)]
    cause = None
    for k, given in enumerate(chain):
        try:
            df, header = _attempt(spark, path, lines, given or sniff_delimiter(lines), multi_line)
        except (DelimitedReadError, csv.Error) as e:
            cause = str(e).removeprefix("Failed to parse CSV. Last error: ")
            continue
        if not df.isEmpty() or not require_rows and k == len(chain) - 1:
            break
        cause = cause or f"no data rows in {path}"
    else:
        raise _failed(cause)
    if schema is None:
        df = _apply_inferred_types(df, header)
    else:
        df = df.select(*[named(c).try_cast(schema[c]).alias(c) if c in schema else named(c) for c in header], *_PLACE)
    return _with_row_id(df, path)


def _attempt(spark: SparkSession, path: str, lines: list[str], sep: str, multi_line: bool | None) -> tuple[DataFrame, list[str]]:
    """The text table under one delimiter, and its column names."""
    top = _parsed(lines, sep)
    header = _names(top[0])
    index = max(len(top[1]) - len(header), 0) if len(top) > 1 else 0
    width = len(header) + index
    if multi_line is None:
        multi_line = any_open_quotes(text_lines(spark, path, sep))
    na = F.array(*[F.lit(t) for t in CSV_NA_TOKENS])
    df = _fields(spark, path, sep, width, multi_line)
    return df.select(*[F.when(F.array_contains(na, F.col(c)) | F.col(c).isNull(), F.lit(None)).otherwise(F.col(c)).alias(name)
                       for c, name in zip([f"_f{i}" for i in range(index, width)], header)], *_PLACE), header


def _apply_inferred_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """One aggregation decides, for every text column, whether all present
    values are numbers (and integers); the decision (a few numbers per
    column) comes back to the driver and becomes casts."""
    stats = []
    for i, c in enumerate(cols):
        v, t = named(c), F.lower(F.trim(named(c)))
        stats += [F.count(v).alias(f"p{i}"), F.count_if(t.rlike(NUMERIC_TEXT)).alias(f"n{i}"),
                  F.count_if(t.rlike(r"^[+-]?\d+$")).alias(f"i{i}")]
    stats.append(F.count(F.lit(1)).alias("rows"))
    row = df.agg(*stats).first()
    out = []
    for i, c in enumerate(cols):
        present, numeric, integral = row[f"p{i}"], row[f"n{i}"], row[f"i{i}"]
        col = named(c)
        if numeric == present and present == row["rows"] and integral == present and present > 0:
            out.append(F.trim(col).try_cast("bigint").alias(c))
        elif numeric == present:
            out.append(to_num(col).alias(c))
        else:
            out.append(col.alias(c))
    return df.select(*out, *_PLACE)


def preview(df: DataFrame, n: int = 10, row_id: str = "_row_id") -> DataFrame:
    """S3: the first ``n`` rows in file order (a top-k, not a full sort)."""
    return df.orderBy(row_id).limit(n)
