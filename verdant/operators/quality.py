"""Data-quality checks (V2-V8) as single-pass aggregations.

Each check is one aggregation over the table (map-side partials, one small
exchange), never a per-column loop of jobs: the per-column figures come out of
one ``agg`` row and are unpivoted with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructField

from verdant import fixed
from verdant.functions.names import ROW_ID, named, user_columns
from verdant.functions.numeric import py_round, to_num


def _user_columns(df: DataFrame) -> list[str]:
    return user_columns(df.columns)


def _stack(pairs: list[tuple[str, Column]], name_col: str, value_col: str) -> Column:
    """Unpivot a one-row set of (name, value) columns via ``stack``."""
    literal = lambda n: "'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'"
    args = ", ".join(f"{literal(n)}, `{a}`" for n, a in pairs)
    return F.expr(f"stack({len(pairs)}, {args}) AS ({name_col}, {value_col})")


# ---------------------------------------------------------------- V3
def duplicate_count(df: DataFrame, table: str) -> DataFrame:
    """Rows minus distinct rows (nulls compare equal), exact.

    Rows are first grouped by a 96-bit row hash (two independent hashes), so
    the wide shuffle carries 16 bytes per row instead of whole rows. Only rows
    whose hash occurs more than once (true duplicates or, rarely, colliding
    distinct rows) are then grouped on their full values, which keeps the
    count exact; the semi join against that candidate set is broadcast by AQE
    when it is small (the usual case) and sort-merged otherwise.
    """
    cols = [named(c) for c in _user_columns(df)]
    h1, h2 = ["_dup_h1", "_dup_h2"]
    hashed = df.select("*", F.xxhash64(*cols).alias(h1), F.hash(*cols).alias(h2))
    per_hash = hashed.groupBy(h1, h2).agg(F.count(F.lit(1)).alias("_n"))
    total = per_hash.agg(F.sum("_n").alias("v")).select(F.lit("rows").alias("k"), "v")
    candidates = per_hash.where(F.col("_n") > 1).select(h1, h2)
    repeated = hashed.join(candidates, [h1, h2], "left_semi").drop(h1, h2)
    exact = (repeated.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
             .agg(F.sum(F.col("_n") - 1).alias("v")).select(F.lit("dups").alias("k"), "v"))
    both = total.unionByName(exact).agg(
        F.coalesce(F.max(F.when(F.col("k") == "rows", F.col("v"))), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.max(F.when(F.col("k") == "dups", F.col("v"))), F.lit(0)).cast("bigint").alias("n_duplicates"))
    return both.select(F.lit(table).alias("table_name"), "n_rows", "n_duplicates",
                       F.when(F.col("n_duplicates") > 0, F.format_string(
                           fixed.MSG_DUPLICATES, F.col("n_duplicates"))).alias("message"))


# ---------------------------------------------------------------- V4
def missing_share(df: DataFrame, table: str, threshold: float = 50.0) -> DataFrame:
    """Columns whose missing share is above ``threshold`` percent."""
    cols = _user_columns(df)
    aggs = [F.avg(named(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    long = one.select(_stack([(c, f"m{i}") for i, c in enumerate(cols)], "column_name", "_share"))
    pct = F.col("_share") * F.lit(100.0)
    return (long.where(pct > F.lit(threshold))
            .select(F.lit(table).alias("table_name"), "column_name",
                    py_round(pct, 1).alias("pct_missing"))
            .withColumn("message", F.format_string(fixed.MSG_MISSING,
                                                   F.col("column_name"), F.col("pct_missing"))))


# ---------------------------------------------------------------- V5
def few_rows(df: DataFrame, table: str) -> DataFrame:
    n = df.limit(2).agg(F.count(F.lit(1)).alias("_n"))
    return n.where(F.col("_n") < 2).select(
        F.lit(table).alias("table_name"),
        F.lit(fixed.MSG_FEW_ROWS).alias("message"))


# ---------------------------------------------------------------- V6
def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns (booleans excluded) plus all-null text columns are
    decided by the caller; here by type only."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
            and f.name != ROW_ID]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)
            and f.name != ROW_ID]


def constant_columns(df: DataFrame, table: str) -> DataFrame:
    """Numeric columns with at most one distinct non-null value (an all-null
    column counts): ``min <=> max`` answers that without a distinct count."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, message string")
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.min(named(c)).eqNullSafe(F.max(named(c))).alias(f"k{i}"))
    one = df.agg(*aggs)
    long = one.select(_stack([(c, f"k{i}") for i, c in enumerate(cols)], "column_name", "_const"))
    return (long.where(F.col("_const"))
            .select(F.lit(table).alias("table_name"), "column_name",
                    F.format_string(fixed.MSG_CONSTANT, F.col("column_name")).alias("message")))


# ---------------------------------------------------------------- V2
def year_rule(df: DataFrame, table: str, min_year: int = 2010) -> DataFrame:
    """Year/date rule in one aggregation: the minimum year of every column that
    is a year or a date by its name; the first of them (years before dates, each
    in the table's order) with a minimum below ``min_year`` fails the table. A
    column named both ways is checked in both places."""
    checks = sorted((rank, at) for at, f in enumerate(df.schema.fields)
                    for rank, word in enumerate(fixed.YEAR_RULE_WORDS) if word in f.name.lower())
    if not checks:
        return df.sparkSession.createDataFrame(
            [(table, True, fixed.MSG_YEAR_SKIP)], "table_name string, passed boolean, message string")
    least = df.agg(*[F.min(_year_of(df.schema.fields[at], rank)).alias(f"c{i}") for i, (rank, at) in enumerate(checks)])
    message = F.lit(None).cast("string")
    for i, (rank, at) in reversed(list(enumerate(checks))):
        year = F.col(f"c{i}").cast("bigint")  # int() truncates
        message = F.when(year < min_year, F.format_string(
            fixed.MSG_YEAR_FAIL, F.lit(df.schema.fields[at].name), F.lit(fixed.YEAR_RULE_KINDS[rank]), year)).otherwise(message)
    return least.select(F.lit(table).alias("table_name"), message.isNull().alias("passed"),
                        F.coalesce(message, F.lit(fixed.MSG_YEAR_PASS)).alias("message"))


def _year_of(field: StructField, rank: int) -> Column:
    """A column's values as years: numbers for rank 0, dates for rank 1; null if neither."""
    c, kind = named(field.name), field.dataType
    if rank == 0:
        return F.nanvl(c.cast("double") if isinstance(kind, NumericType) else to_num(c), F.lit(None).cast("double"))
    is_date = kind.typeName() in ("timestamp", "timestamp_ntz", "date")
    return F.year(c if is_date else F.try_to_timestamp(c.cast("string")))


# ---------------------------------------------------------------- V7, V8
def missing_fields(profiles: DataFrame) -> DataFrame:
    """V7: the required profile fields that are null, as an array per row."""
    names = fixed.REQUIRED_PROFILE_FIELDS
    arr = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in names])
    return profiles.withColumn("missing_fields", F.filter(arr, lambda x: x.isNotNull()))


def fill_profile(profiles: DataFrame) -> DataFrame:
    """V8: form defaults for missing fields and range/membership flags."""
    lo_e, hi_e = fixed.FORM_RANGES["employee_count"]
    lo_b, hi_b = fixed.FORM_RANGES["budget"]
    out = (profiles
           .withColumn("employee_count", F.coalesce(F.col("employee_count"),
                                                    F.lit(fixed.FORM_DEFAULTS["employee_count"])))
           .withColumn("budget", F.coalesce(F.col("budget"), F.lit(fixed.FORM_DEFAULTS["budget"]))))
    return (out
            .withColumn("employee_count_in_range", F.col("employee_count").between(lo_e, hi_e))
            .withColumn("budget_in_range", F.col("budget").between(lo_b, hi_b))
            .withColumn("industry_allowed", F.col("industry").isin(fixed.FORM_INDUSTRIES))
            .withColumn("country_allowed", F.col("country").isin(fixed.FORM_COUNTRIES)))


def profile_form_view(extracted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """V7 + V8 of extracted profiles: the missing fields, the form's values
    after defaults, and whether each is in range or among the choices."""
    filled = fill_profile(missing_fields(extracted))
    return filled.select(id_col, F.array_join("missing_fields", ",").alias("missing_fields"),
                         F.size("missing_fields").cast("bigint").alias("n_missing"),
                         F.col("employee_count").alias("employee_count_filled"), F.col("budget").alias("budget_filled"),
                         "employee_count_in_range", "budget_in_range", "industry_allowed", "country_allowed")
