"""Trends (A9-A11), wide->long (R1), year pivot (R2), trend series.

The panel is unpivoted once over the mapped metrics; each per-metric figure is
an aggregation keyed by (company, metric) whose first/last values come from
``min_by`` / ``max_by`` on the year order, with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.fixed import HIGHER_IS_BETTER, LOWER_IS_BETTER
from verdant.functions.names import named
from verdant.functions.numeric import py_round
from verdant.operators.latest import company_key
from verdant.operators.score import metric_value

DIMENSIONS = ("company", "industry", "country", "year")
#: Direction of a company without any row.
UNKNOWN_DIRECTION = "Unknown"


def metric_long(panel: DataFrame, col_map: dict, row_id: str = "_row_id") -> DataFrame:
    """(company, metric, column_name, year, _year_raw, _row_id, value) over
    the mapped metrics other than company/industry/country/year; values and
    ``year`` coerced to numbers, ``_year_raw`` kept for ordering as a sort of
    the raw column would order rows."""
    from verdant.operators.score import number_sql
    keyed = company_key(panel, col_map)
    types = {f.name: f.dataType for f in panel.schema.fields}
    metrics = [(m, c) for m, c in col_map.items() if m not in DIMENSIONS and c in panel.columns]
    year = (F.expr(number_sql(types, col_map["year"])) if "year" in col_map else F.lit(None).cast("double"))
    rid = named(row_id) if row_id in panel.columns else F.lit(0).cast("bigint")
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column_name"),
                                 metric_value(panel, col_map, m).alias("value"))
                        for m, c in metrics])
    raw = named(col_map["year"]) if "year" in col_map else F.lit(None).cast("double")
    return keyed.select(F.col("_company").alias("company"), year.alias("year"), raw.alias("_year_raw"),
                        rid.alias("_row_id"), F.inline(entries))


def metric_trends(panel: DataFrame, col_map: dict) -> DataFrame:
    """A9 + A10: per (company, metric) with at least two values: first and
    last value in year order, pct_change (1 decimal, 0.0 when first is 0)
    and the improving flag (from the rounded change; zero is not improving).
    Computed from the one-pass company facts."""
    from verdant.operators.facts import company_facts
    return trends_from_facts(company_facts(panel, col_map), col_map)


def trends_from_facts(facts: DataFrame, col_map: dict) -> DataFrame:
    """Unpivot the per-metric first / last / count columns of a facts table
    (or of any table carrying them) into trend rows."""
    metrics = [(m, c) for m, c in col_map.items() if f"n_{m}" in facts.columns]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column_name"),
                              F.col(f"n_{m}").alias("n_values"), F.col(f"first_{m}").alias("first_value"),
                              F.col(f"last_{m}").alias("last_value")) for m, c in metrics])
    keep = [c for c in facts.columns if c in ("rank", "solution")]
    agg = facts.select("company", *keep, F.inline(rows)).where(F.col("n_values") >= 2)
    agg = agg.withColumn("pct_change", _change(F.col("first_value"), F.col("last_value")))
    improving = (F.when(F.col("metric").isin(LOWER_IS_BETTER), F.col("pct_change") < 0)
                 .when(F.col("metric").isin(HIGHER_IS_BETTER), F.col("pct_change") > 0))
    return agg.withColumn("is_improving", improving)


def _change(first: F.Column, last: F.Column) -> F.Column:
    return F.when(first != 0, py_round((last - first) / F.abs(first) * F.lit(100.0), 1)).otherwise(F.lit(0.0))


def trend_series(panel: DataFrame, col_map: dict) -> DataFrame:
    """P7 / A9 value list in long form: (company, metric, pos, year, value)
    with ``pos`` the 0-based place in year order (null year last, then file
    order). Positions come from the distributed ordinal helper, so a company
    with a huge number of rows is never sorted in a single task."""
    from verdant.plans.ordinal import with_ordinal
    long = metric_long(panel, col_map).where(F.col("value").isNotNull())
    ranked = with_ordinal(long, [("_year_raw", "asc"), ("_row_id", "asc")], ["company", "metric"], "pos")
    return ranked.select("company", "metric", "pos", F.col("year").cast("bigint").alias("year"), "value")


def trend_direction(trends: DataFrame) -> DataFrame:
    """A11 per company of a table of trends: counts and overall direction."""
    return trends.groupBy("company").agg(
        F.count_if(F.col("is_improving")).alias("improving_count"),
        F.count_if(~F.col("is_improving")).alias("declining_count")).withColumn("overall_direction", _direction())


def _direction() -> F.Column:
    imp, dec = F.col("improving_count"), F.col("declining_count")
    total = imp + dec
    return (F.when(total == 0, "Insufficient Data")
            .when(imp / total >= 0.7, "Improving")
            .when(dec / total >= 0.7, "Declining")
            .otherwise("Mixed"))


def company_directions(panel: DataFrame, col_map: dict, asked: DataFrame | None = None) -> DataFrame:
    """A11 for every company of the panel, from the one-pass company facts (a
    row per company): no second pass for companies without trends. With
    ``asked`` (a ``company`` column) for each of its rows instead: "Unknown" and
    zero counts for a company of which the panel has no row."""
    from verdant.operators.facts import company_facts
    facts = company_facts(panel, col_map)
    change = {m: F.when(F.col(f"n_{m}") >= 2, _change(F.col(f"first_{m}"), F.col(f"last_{m}")))
              for m in col_map if f"n_{m}" in facts.columns}
    better = [change[m] < 0 for m in change if m in LOWER_IS_BETTER] + \
             [change[m] > 0 for m in change if m in HIGHER_IS_BETTER and m not in LOWER_IS_BETTER]
    flags = F.array(*better).cast("array<boolean>")
    found = facts.select(
        "company", F.size(F.filter(flags, lambda x: x)).cast("bigint").alias("improving_count"),
        F.size(F.filter(flags, lambda x: ~x)).cast("bigint").alias("declining_count")).withColumn(
        "overall_direction", _direction())
    if asked is None:
        return found
    counts = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("improving_count", "declining_count")]
    return asked.select("company").join(found, "company", "left").select(
        "company", *counts, F.coalesce("overall_direction", F.lit(UNKNOWN_DIRECTION)).alias("overall_direction"))


def yoy_long(panel: DataFrame, col_map: dict) -> DataFrame:
    """R2 in long form: (company, metric title, column, year, value at 1
    decimal); a duplicate year keeps the last row; metrics that are all-null
    for the company are dropped; rows with a null year are not shown."""
    # One pass over the panel: the count of values travels with each year's
    # group and is summed over the (small) result.
    from pyspark.sql import Window
    per_year = (metric_long(panel, col_map)
                .groupBy("company", "metric", "column_name", F.col("year").cast("bigint").alias("year"))
                .agg(F.max_by("value", "_row_id").alias("value"), F.count("value").alias("_n")))
    whole = Window.partitionBy("company", "metric")
    out = (per_year.withColumn("_nv", F.sum("_n").over(whole))
           .where((F.col("_nv") > 0) & F.col("year").isNotNull()))
    return out.select("company", F.initcap(F.replace(F.col("metric"), F.lit("_"), F.lit(" "))).alias("metric"),
                      F.col("column_name"), "year", py_round(F.col("value"), 1).alias("value"))


#: Pivot columns that may be read from the data; a table of more is no pivot.
MAX_YEARS = 1000


def yoy_pivot(panel: DataFrame, col_map: dict, years: list[int] | None = None) -> DataFrame:
    """R2: one row per (company, metric), one column per year.

    ``years``: the pivot columns; when omitted they are read from the data
    by a job of its own (a distinct over the years), so name them where they are known."""
    long = yoy_long(panel, col_map)
    if years is None:
        # The pivot columns are part of the plan, so they are read when it is built.
        found = long.select("year").distinct().limit(MAX_YEARS + 1).collect()
        if len(found) > MAX_YEARS:
            raise ValueError(f"more than {MAX_YEARS} distinct years: name the pivot columns in years")
        years = sorted(r[0] for r in found)
    return (long.groupBy("company", "metric", "column_name")
            .pivot("year", years).agg(F.first("value"))
            .select("company", "metric", "column_name", *[F.col(str(y)) for y in years]))
