"""Table profiling (A1-A7) and the summary sentence.

min / max / mean / count / stddev are plain aggregations (map-side partials);
exact medians and quartiles come from bucket counts (``plans/quantiles.py``),
so no value is sorted or gathered; ``approximate=True`` takes one pass of sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdant.functions.names import named, quoted, user_columns
from verdant.functions.numeric import py_round
from verdant.operators.latest import company_key
from verdant.operators.quality import numeric_columns
from verdant.plans.ordinal import global_rank
from verdant.plans.quantiles import exact_quantiles, sketch_quantiles


def _long_values(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    """Numeric columns as rows (ids..., column_name, value DOUBLE), NaN as null."""
    value = lambda c: F.nanvl(named(c).cast("double"), F.lit(None).cast("double"))
    return df.select(*[named(i) for i in ids], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), value(c).alias("value")) for c in cols])))


def _quantiles(df: DataFrame, cols: list[str], ids: list[str], probs: dict, stats: dict, approximate: bool) -> DataFrame:
    long = _long_values(df, cols, ids)
    groups = [*ids, "column_name"]
    if not approximate:
        return exact_quantiles(long, groups, "value", probs, stats, few_groups=not ids)
    figures = long.where("value IS NOT NULL").groupBy(*[named(g) for g in groups]).agg(*[c.alias(k) for k, c in stats.items()])
    return figures.join(sketch_quantiles(long, groups, "value", probs), groups)


def column_stats(df: DataFrame, cols: list[str] | None = None, digits: int = 2,
                 group_cols: list[str] = (), approximate: bool = False) -> DataFrame:
    """A6 (A5 with ``group_cols`` = company): min, max, mean, median per numeric
    column (and group), rounded; columns without values are skipped.
    ``approximate`` takes the median from a sketch (see ``sketch_quantiles``)."""
    cols = cols if cols is not None else numeric_columns(df)
    v = F.col("value")
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, min_val double, max_val double, mean_val double, "
                                                   "median_val double")
    q = _quantiles(df, cols, list(group_cols), {"md": 0.5}, {"mn": F.min(v), "mx": F.max(v), "av": F.avg(v)}, approximate)
    return q.select(*[named(g) for g in group_cols], "column_name", py_round(F.col("mn"), digits).alias("min_val"),
                    py_round(F.col("mx"), digits).alias("max_val"),
                    py_round(F.col("av"), digits).alias("mean_val"),
                    py_round(F.col("md"), digits).alias("median_val"))


def describe(df: DataFrame, cols: list[str] | None = None, digits: int = 2, approximate: bool = False) -> DataFrame:
    """Count, mean, std, min, 25 %, 50 %, 75 %, max per numeric column
    (columns without values keep a row with count 0). ``approximate`` takes
    the quartiles from a sketch (see ``sketch_quantiles``)."""
    cols = cols if cols is not None else numeric_columns(df)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    if not cols:
        q = names.selectExpr("column_name", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in ("n", "av", "sd", "mn", "q25", "q50", "q75", "mx")])
    else:
        v = F.col("value")
        q = _quantiles(df, cols, [], {"q25": 0.25, "q50": 0.5, "q75": 0.75},
                       {"n": F.count(v), "av": F.avg(v), "sd": F.stddev_samp(v), "mn": F.min(v), "mx": F.max(v)}, approximate)
    j = names.join(F.broadcast(q), "column_name", "left")
    r = lambda c: py_round(F.col(c), digits)
    return j.select("column_name", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("count"),
                    r("av").alias("mean"), r("sd").alias("std"), r("mn").alias("min"), r("q25").alias("p25"),
                    r("q50").alias("p50"), r("q75").alias("p75"), r("mx").alias("max"))


def _null_cells(cols: list[str]) -> F.Column:
    return F.sum(sum((named(c).isNull().cast("int") for c in cols), F.lit(0)))


def _completeness(ncol: int) -> F.Column:
    return py_round((F.lit(1.0) - F.col("_nulls") / (F.col("row_count") * F.lit(float(ncol)))) * F.lit(100.0), 1)


def _year_range(panel: DataFrame, col_map: dict) -> list[F.Column]:
    if "year" not in col_map:
        return []
    from verdant.operators.score import number_sql
    y = F.expr(number_sql({f.name: f.dataType for f in panel.schema.fields}, col_map["year"]))
    return [F.min(y).cast("bigint").alias("year_min"), F.max(y).cast("bigint").alias("year_max")]


def company_summary(panel: DataFrame, col_map: dict, also: list[F.Column] = ()) -> DataFrame:
    """A1 + A2 per company: rows, columns, completeness (1 decimal), year range,
    and the aggregates in ``also``, all in one pass.

    Completeness = (1 - mean over columns of the null share) * 100; with the
    same row count in every column that is 1 - nulls / (rows * columns)."""
    user_cols = user_columns(panel.columns)
    out = company_key(panel, col_map).groupBy("_company").agg(
        F.count(F.lit(1)).alias("row_count"), _null_cells(user_cols).alias("_nulls"),
        *_year_range(panel, col_map), *also)
    return (out.withColumn("col_count", F.lit(len(user_cols)).cast("bigint"))
               .withColumn("completeness_pct", _completeness(len(user_cols)))
               .withColumnRenamed("_company", "company").drop("_nulls"))


def companies_sorted(df: DataFrame, col_map: dict) -> DataFrame:
    """A4: distinct non-null companies (sorted on output)."""
    return df.select(named(col_map["company"]).alias("company")).where(F.col("company").isNotNull()).distinct()


def companies_first_seen(df: DataFrame, col_map: dict, row_id: str = "_row_id") -> DataFrame:
    """A3: distinct companies in first-seen order, as (seen_order, company)."""
    first = (df.where(named(col_map["company"]).isNotNull())
             .groupBy(named(col_map["company"]).alias("company")).agg(F.min(row_id).alias("_first")))
    ranked = global_rank(first, [("_first", "asc"), ("company", "asc")], rank_col="seen_order")
    return ranked.select("seen_order", "company")


# ---------------------------------------------------------------- X8, P8 per company
HIGHLIGHT_METRICS = ["carbon_emissions", "renewable_energy", "gender_diversity", "energy"]


def _value_text(df: DataFrame, c: str, ref: str | None = None) -> F.Column:
    """A cell as Python prints it: floats like ``repr``, missing float as nan.
    ``c`` names the column in ``df`` (for its type); ``ref`` the column to
    read (defaults to ``c``)."""
    from pyspark.sql.types import DoubleType, FloatType, IntegralType

    from verdant.functions.numeric import py_float_str_sql
    t = df.schema[c].dataType
    col = F.col(ref) if ref else named(c)
    if isinstance(t, (DoubleType, FloatType)):
        name = ref or quoted(c)
        return F.expr(f"coalesce({py_float_str_sql(name)}, 'nan')")
    if isinstance(t, IntegralType):
        return F.coalesce(col.cast("string"), F.lit("nan"))
    return F.coalesce(col.cast("string"), F.lit("None"))


def _highlights(panel: DataFrame, cmap: dict) -> list[tuple[str, str]]:
    numeric = numeric_columns(panel)
    return [(m, cmap[m]) for m in HIGHLIGHT_METRICS if m in cmap and cmap[m] in numeric]


def _number(c: str) -> F.Column:
    return F.nanvl(named(c).cast("double"), F.lit(None).cast("double"))


def _sentence(cmap: dict, hl: list[tuple[str, str]], companies: F.Column) -> F.Column:
    """The summary sentence from ``row_count, col_count, completeness_pct``, the
    year range and the highlight figures ``_mn, _mx, _av``; null parts are left out."""
    from verdant.functions.numeric import py_float_str_sql, py_round_sql
    parts = [F.format_string("Dataset: %d rows, %d columns.", F.col("row_count"), F.col("col_count")),
             F.concat(F.lit("Completeness: "), F.expr(py_float_str_sql("completeness_pct")), F.lit("%."))]
    if "year" in cmap:
        parts.append(F.when(F.col("year_min").isNotNull(),
                            F.format_string("Year range: %d-%d.", F.col("year_min"), F.col("year_max"))))
    if "company" in cmap:
        parts.append(F.concat(F.lit("Companies: "), companies, F.lit(".")))
    if cmap:
        parts.append(F.lit(f"ESG columns detected: {', '.join(cmap.keys())}."))
    r2 = lambda c: F.expr(py_float_str_sql(py_round_sql(c, 2)))
    for i, (m, _) in enumerate(hl):
        title = m.replace("_", " ").title()
        parts.append(F.when(F.col(f"_mn{i}").isNotNull(), F.concat(
            F.lit(f"{title}: mean="), r2(f"_av{i}"), F.lit(", range ["), r2(f"_mn{i}"), F.lit(", "),
            r2(f"_mx{i}"), F.lit("]."))))
    return F.concat_ws(" ", *parts)


def _summarised(panel: DataFrame, cmap: dict, also: list[F.Column] = ()) -> DataFrame:
    """One pass: ``company_summary`` with ``text_summary`` and ``also``."""
    hl = _highlights(panel, cmap)
    figures = [f(_number(c)).alias(f"_{n}{i}") for i, (_, c) in enumerate(hl)
               for f, n in ((F.min, "mn"), (F.max, "mx"), (F.avg, "av"))]
    return company_summary(panel, cmap, figures + list(also)).withColumn(
        "text_summary", _sentence(cmap, hl, F.col("company")))


def _detected(panel: DataFrame, col_map: dict | None) -> dict:
    from verdant.operators.schema import detect_columns
    return col_map if col_map is not None else detect_columns(user_columns(panel.columns))


def data_summary_text(panel: DataFrame, col_map: dict | None = None) -> DataFrame:
    """X8 for every company at once: the summary sentence of the company's
    rows (rows, columns, completeness, years, company, detected metrics and
    the mean / range of up to four highlight metrics among the
    numeric columns). ``col_map`` defaults to detection on the column names."""
    return _summarised(panel, _detected(panel, col_map)).select(
        "company", "row_count", "col_count", "completeness_pct", "text_summary")


def profile_text(panel: DataFrame, col_map: dict | None = None, row_id: str = "_row_id",
                 sample_fields: int | None = None) -> DataFrame:
    """P8 per company: column list, row count, the X8 summary, and the first
    ``sample_fields`` fields (all by default) of the company's first row as ``k: v`` pairs."""
    user_cols = user_columns(panel.columns)
    fields = user_cols[:sample_fields]
    # Pick each company's first row as a struct of raw values, then format
    # only that row (formatting every panel row would be wasted work).
    first = F.min_by(F.struct(*[named(c).alias(f"f{i}") for i, c in enumerate(fields)]), F.col(row_id)).alias("_first")
    pairs = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), _value_text(panel, c, f"_first.f{i}"))
                                 for i, c in enumerate(fields)])
    text = F.concat(F.lit(f"Columns: {', '.join(user_cols)}. Row count: "), F.col("row_count").cast("string"),
                    F.lit(". "), F.col("text_summary"), F.lit("\nSample record: "), pairs)
    return _summarised(panel, _detected(panel, col_map), [first]).select("company", text.alias("profile_text"))


#: Buckets in which the first companies are looked for side by side.
_SEEN_BUCKETS = 64


def table_summary_text(panel: DataFrame, col_map: dict | None = None, row_id: str = "_row_id") -> DataFrame:
    """X8 for the whole table (no company selected): one row with the
    summary sentence; the company list is the first five companies in
    first-seen order (W5). One pass: figures and first row per company, the
    first five companies of each of a fixed number of buckets, then one row."""
    user_cols = user_columns(panel.columns)
    cmap = _detected(panel, col_map)
    hl = _highlights(panel, cmap)
    named_rows = panel.withColumn("_name", named(cmap["company"]).cast("string") if "company" in cmap
                                  else F.lit(None).cast("string"))
    per = named_rows.groupBy("_name").agg(
        F.count(F.lit(1)).alias("row_count"), _null_cells(user_cols).alias("_nulls"), *_year_range(panel, cmap),
        F.min(row_id).alias("_seen"),
        *[f(_number(c)).alias(f"_{n}{i}") for i, (_, c) in enumerate(hl)
          for f, n in ((F.min, "mn"), (F.max, "mx"), (F.sum, "sum"), (F.count, "n"))])
    bucket = Window.partitionBy(F.pmod(F.xxhash64("_name"), F.lit(_SEEN_BUCKETS))).orderBy("_seen")
    early = F.when(F.col("_name").isNotNull() & (F.col("_place") <= 5), F.struct("_seen", "_name"))
    years = [F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max")] if "year" in cmap else []
    figures = [x for i in range(len(hl)) for x in (
        F.min(f"_mn{i}").alias(f"_mn{i}"), F.max(f"_mx{i}").alias(f"_mx{i}"),
        F.try_divide(F.sum(f"_sum{i}"), F.sum(f"_n{i}")).alias(f"_av{i}"))]
    out = (per.withColumn("_place", F.row_number().over(bucket))
           .agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.sum("_nulls").alias("_nulls"), *years, *figures,
                F.slice(F.array_sort(F.collect_list(early)), 1, 5).alias("_early"))
           .withColumn("col_count", F.lit(len(user_cols)).cast("bigint"))
           .withColumn("completeness_pct", F.when(F.col("row_count") > 0, _completeness(len(user_cols)))))
    names = F.nullif(F.array_join(F.transform("_early", lambda x: x["_name"]), ", "), F.lit(""))
    return out.select("row_count", "col_count", "completeness_pct", _sentence(cmap, hl, names).alias("text_summary"))
