"""Quantiles of groups of any size.

``exact_quantiles`` selects ranks by bucket refinement. Every double has an
order-preserving 64-bit key; a first pass counts the values of each bucket of
the key's high bits, which tells the bucket and the rest of the rank of every
quantile; the next pass counts only those buckets' values by further bits;
after the last bits the bucket is a value. What moves between tasks are counts
(with map-side partials) and at the end one row for each quantile: no value
is sorted, nothing is written, no group is gathered. A pass costs one scan of
the input, or of its last shuffle, which the passes share.

``sketch_quantiles`` is one pass over mergeable KLL sketches with a stated rank error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.functions.names import named

#: Bits below those that each pass counts by: sign, exponent and 20 bits of the
#: fraction first (about a million buckets for each power of two that occurs),
#: then the rest. More passes, such as (44, 22, 0), make fewer buckets each, for
#: huge columns of values that agree in their first 20 bits.
SHIFTS = (32, 0)
#: Names for the columns that are added to a table of values.
_KEY, _VALUE, _PARENT, _RANKS = "__key", "__value", "__parent", "__ranks"


def with_ordered_key(df: DataFrame, value: str, key: str = _KEY) -> DataFrame:
    """``key``: a BIGINT that orders rows as the double ``value`` does (its IEEE
    bits, by arithmetic; negated for negative numbers; -0.0 like 0.0). NaN and
    null have no key."""
    v = f"`{value}`"
    exponent = df.withColumn("__a", F.expr(f"abs({v})")).withColumn(
        "__e", F.expr("CASE WHEN __a > 0D AND __a < double('Infinity') THEN CAST(floor(log2(__a)) AS INT) END"))
    # The logarithm may be off by one next to a power of two; powers of two are exact.
    exact = exponent.withColumn("__e", F.expr(
        "__e + CASE WHEN __a / pow(2D, __e) >= 2D THEN 1 WHEN __a / pow(2D, __e) < 1D THEN -1 ELSE 0 END"))
    bits = ("CASE WHEN __a = 0D THEN 0L WHEN __a = double('Infinity') THEN shiftleft(2047L, 52) "
            "WHEN __e < -1022 THEN CAST(__a / 4.9E-324D AS BIGINT) "
            "ELSE shiftleft(CAST(__e + 1023 AS BIGINT), 52) + CAST((__a / pow(2D, __e) - 1D) * 4503599627370496D AS BIGINT) END")
    return (exact.withColumn("__b", F.expr(bits))
            .withColumn(key, F.expr(f"CASE WHEN isnan({v}) THEN NULL WHEN {v} < 0D THEN -__b ELSE __b END"))
            .drop("__a", "__e", "__b"))


def _same(cols: list[str]) -> Column:
    """Whether the columns equal their renamed counterparts, nulls being equal."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & named(c).eqNullSafe(named(f"__r_{c}"))
    return cond


def _renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__r_{c}" for c in cols})


def exact_quantiles(long_df: DataFrame, group_cols: list[str], value_col: str, probs: dict[str, float],
                    stats: dict[str, Column] | None = None, few_groups: bool = False,
                    shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """Exact linearly interpolated quantiles per group (pandas / ``quantile_cont``
    semantics); nulls and NaN are ignored, -0.0 counts as 0.0.

    One row per group (null groups too) with a column per entry of ``probs``
    and one per entry of ``stats`` (name -> aggregate over the group's values).
    ``few_groups`` says that the number of groups has a bound of its own (the
    columns of a table), so the wanted buckets, a few rows for each, are
    broadcast; otherwise the later passes meet them by a shuffle on the group
    and the bucket's bits, which spreads a large group. ``shifts`` end with 0."""
    groups = list(group_cols)
    values = long_df.select(*[named(g) for g in groups], (named(value_col) + F.lit(0.0)).alias(_VALUE)).where(
        f"{_VALUE} IS NOT NULL AND NOT isnan({_VALUE})")
    keyed = with_ordered_key(values, _VALUE)
    figures = {k: c for k, c in (stats or {}).items()}
    # ``stats`` name the value column as the caller knows it.
    renamed = values if value_col == _VALUE else values.withColumnRenamed(_VALUE, value_col)
    facts = renamed.groupBy(*[named(g) for g in groups]).agg(
        F.count(F.lit(1)).alias("__n"), *[c.alias(f"__s_{k}") for k, c in figures.items()]).where("__n > 0")

    # Ranks to find: an array of two for each quantile; -1 where a rank lies in another bucket.
    place = {name: f"CAST({float(p)!r}D * (__n - 1) AS DOUBLE)" for name, p in probs.items()}
    ranks = "array(" + ", ".join(f"{f}({at})" for at in place.values() for f in ("floor", "ceil")) + ")"
    side = (lambda d: F.broadcast(d)) if few_groups else (lambda d: d)
    wanted = None
    for level, shift in enumerate(shifts):
        here, parents = keyed, []
        if level:  # only the values of the buckets in question are counted
            here = keyed.withColumn(_PARENT, F.shiftright(_KEY, shifts[level - 1]))
            here = here.join(side(_renamed(wanted, [*groups, _PARENT])), _same([*groups, _PARENT]))
            parents = [_PARENT]
        by = [*[named(g) for g in groups], *parents]
        counts = here.groupBy(*by, *([_RANKS] if level else []), F.shiftright(_KEY, shift).alias("__to")).agg(
            F.count(F.lit(1)).alias("__c"), *([F.min(_VALUE).alias("__found")] if shift == 0 else []))
        within = Window.partitionBy(*by)
        counts = counts.withColumn("__upto", F.sum("__c").over(within.orderBy("__to").rowsBetween(Window.unboundedPreceding, 0)))
        if not level:
            counts = counts.withColumn("__n", F.sum("__c").over(within)).withColumn(_RANKS, F.expr(ranks))
        left = F.transform(_RANKS, lambda r: F.when((r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")),
                                                    r - F.col("__upto") + F.col("__c")).otherwise(F.lit(-1).cast("bigint")))
        wanted = counts.select(*[named(g) for g in groups], F.col("__to").alias(_PARENT), left.alias(_RANKS),
                               *(["__found"] if shift == 0 else [])).where(F.exists(_RANKS, lambda r: r >= 0))

    picked = wanted.groupBy(*[named(g) for g in groups]).agg(*[
        F.max(F.when(F.col(_RANKS)[2 * i + k] >= 0, F.col("__found"))).alias(f"__{s}_{name}")
        for i, name in enumerate(probs) for k, s in enumerate(("lo", "hi"))])
    out = side(_renamed(picked, groups)).join(facts, _same(groups))
    lo, hi = (lambda n: F.col(f"`__lo_{n}`")), (lambda n: F.col(f"`__hi_{n}`"))
    return out.select(*[named(g) for g in groups],
                      *[(lo(n) + (hi(n) - lo(n)) * F.expr(f"{place[n]} - floor({place[n]})")).alias(n) for n in probs],
                      *[F.col(f"`__s_{k}`").alias(k) for k in figures])


def sketch_quantiles(long_df: DataFrame, group_cols: list[str], value_col: str, probs: dict[str, float],
                     k: int = 800) -> DataFrame:
    """Approximate quantiles (values of the data, not interpolated) from one
    KLL sketch per group, merged from the tasks' partial sketches: one pass, a
    few kilobytes for each group and task. The rank of a result is off by
    about 2.3 / k ** 0.9 of the group's size at most (99 % of the time; 0.6 %
    for the default k), as tests/test_quantiles.py measures. Nulls and NaN are ignored."""
    v = named(value_col).cast("double")
    values = long_df.select(*[named(g) for g in group_cols], v.alias(_VALUE)).where(f"{_VALUE} IS NOT NULL AND NOT isnan({_VALUE})")
    sketched = values.groupBy(*[named(g) for g in group_cols]).agg(F.kll_sketch_agg_double(_VALUE, k).alias("__sketch"))
    return sketched.select(*[named(g) for g in group_cols], *[
        F.kll_sketch_get_quantile_double("__sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])
