"""Ordinal positions (global rank, rank within groups of any size) without
sending a whole group through one task, and without writing anything.

Plan. A deterministic sample of the rows (those with the least hashes) gives,
as a scalar subquery, the bounds of a fixed number of ranges over (group,
order, row hash). Each row finds its range by comparing itself with the
bounds, so the assignment is part of the row: branches of the plan agree on it
whatever the executors do. Rows are numbered within their range (a window
keyed by the range), and ranges are added up from their counts: for a global rank one
row per range, for groups only the few groups that reach over a bound.

Sample, counts and rows are three uses of the input. The row hash names every
column, so the three ask for the same columns and share the input's shuffles
(they would be computed anew, with the same result, if Spark did not share them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, LongType, NumericType, TimestampType

from verdant.functions.names import named

#: Sampled rows per range, and the most ranges.
SAMPLE_ROWS, MAX_RANGES = 32, 4096
Order = list[tuple[str, str]]


def _key(df: DataFrame, order: Order, groups: list[str]) -> Column:
    """The sort key as one struct that compares in ascending order, nulls last:
    descending numbers are negated, nullable columns come behind a null flag."""
    fields = {f.name: f for f in df.schema.fields}
    parts = []
    for c, direction in [*((g, "asc") for g in groups), *order]:
        kind, value = fields[c].dataType, named(c)
        if direction == "desc":
            if isinstance(kind, (DateType, TimestampType)):
                value = F.unix_date(value) if isinstance(kind, DateType) else F.unix_micros(value)
                kind = LongType()
            if not isinstance(kind, NumericType):
                raise ValueError(f"{c}: only numbers, dates and times can be in descending order")
            value = F.bitwise_not(value) if isinstance(kind, IntegralType) else -value
        elif direction != "asc":
            raise ValueError(f"direction of {c} must be asc or desc")
        if fields[c].nullable:
            parts.append(named(c).isNull().alias(f"n{len(parts)}"))
        parts.append(value.alias(f"v{len(parts)}"))
    return F.struct(*parts, F.xxhash64(*[named(c) for c in df.columns]).alias("tie"))


def _with_range(df: DataFrame, key: Column, ranges: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``__key`` and its range number ``__range``, and the one-row table of bounds."""
    keyed = df.withColumn("__key", key)
    sample = keyed.select("__key", F.xxhash64("__key").alias("h")).orderBy("h").limit(ranges * SAMPLE_ROWS)
    bounds = sample.agg(F.filter(F.sort_array(F.collect_list("__key")), lambda _, i: (i + 1) % SAMPLE_ROWS == 0).alias("bounds"))
    # Two steps of about sqrt(ranges) comparisons each instead of one for every
    # bound; the subquery is named once, so that it is planned once.
    step = math.isqrt(ranges - 1) + 1
    below = lambda part: F.size(F.filter(part, lambda b: b < F.col("__key")))
    first = F.transform("__bounds", lambda b: F.struct(
        b.alias("b"), below(F.filter(b, lambda _, i: (i + 1) % step == 0)).alias("c")))
    both = F.transform(first, lambda x: x["c"] * step + below(F.slice(x["b"], x["c"] * step + 1, step)))
    out = keyed.withColumn("__bounds", F.array(bounds.scalar())).withColumn("__range", both[0])
    return out.drop("__bounds"), bounds


def with_ordinal(df: DataFrame, order: Order, group_cols: list[str] | tuple = (), pos_col: str = "_pos",
                 size_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row within its group under ``order``
    ((column, "asc" or "desc"), nulls last; "desc" for numbers, dates and times) and, if ``size_col`` is given, the
    group's size. Ties get distinct positions by a hash of the row; give a total
    order for a result that is the same for the same rows. Null groups are a
    group. ``num_partitions`` is the number of ranges (by default
    ``spark.sql.shuffle.partitions``); a range is sorted in one task."""
    groups = list(group_cols)
    spark = df.sparkSession
    ranges = min(num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    tagged, bounds = _with_range(df, _key(df, order, groups), max(ranges, 1))
    names = [f"__g{i}" for i in range(len(groups))]
    counted = tagged.select("__range", *[named(g).alias(n) for n, g in zip(names, groups)])
    if groups:
        # A group that reaches over a bound holds that bound's key: at most so many groups as bounds.
        fields = [f for f in tagged.schema["__key"].dataType.names if f.startswith("v")][:len(groups)]
        over = bounds.select(F.explode("bounds").alias("b")).select(
            *[F.col(f"b.{f}").alias(f"__o{i}") for i, f in enumerate(fields)]).distinct()
        counted = counted.join(F.broadcast(over), _pairs(names, [f"__o{i}" for i in range(len(groups))]), "left_semi")
    counts = counted.groupBy("__range", *names).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*names)
    # One row per range, or per range of a group that reaches over a bound.
    offsets = counts.select(F.col("__range").alias("__at"), *names, F.sum("__n").over(
        whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__offset"),
        F.sum("__n").over(whole).alias("__total"))
    within = Window.partitionBy("__range", *[named(g) for g in groups])
    out = tagged.join(F.broadcast(offsets), _pairs(["__range", *groups], ["__at", *names]), "left").withColumn(
        pos_col, (F.row_number().over(within.orderBy("__key")) - 1 + F.coalesce("__offset", F.lit(0))).cast("bigint"))
    kept = [named(c) for c in df.columns] + [named(pos_col)]
    if size_col:
        size = F.coalesce("__total", F.count(F.lit(1)).over(within) if groups else F.lit(0))
        kept.append(size.cast("bigint").alias(size_col))
    return out.select(*kept)


def _pairs(left: list[str], right: list[str]) -> Column:
    """Whether columns are equal pair by pair, nulls being equal."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & named(a).eqNullSafe(F.col(b))
    return cond


def global_rank(df: DataFrame, order: Order, rank_col: str = "rank", total_col: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """1-based rank without ties (row_number semantics) over the whole table."""
    out = with_ordinal(df, order, (), rank_col, total_col, num_partitions)
    return out.withColumn(rank_col, named(rank_col) + 1)
