"""Dimension tables (J1-J6) built from ``verdant.fixed``.

Each is a handful of rows with a fixed size, so joins against them are
broadcast hash joins; the fact side is never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant import fixed

def benchmarks(spark: SparkSession) -> DataFrame:
    """Benchmark row per industry, plus the default row (industry null)."""
    rows = [(ind, *map(float, vals)) for ind, *vals in fixed.INDUSTRY_BENCHMARKS]
    rows.append((None, *map(float, fixed.DEFAULT_BENCHMARK)))
    cols = ", ".join(f"{c} double" for c in fixed.BENCHMARK_COLUMNS)
    return spark.createDataFrame(rows, f"industry string, {cols}")


def with_benchmark(df: DataFrame, industry_col: str, spark: SparkSession) -> DataFrame:
    """Exact, case-sensitive industry lookup with the default row otherwise."""
    b = benchmarks(spark)
    known = F.broadcast(b.where(F.col("industry").isNotNull())
                        .withColumnRenamed("industry", "_b_industry"))
    default = dict(zip(fixed.BENCHMARK_COLUMNS, fixed.DEFAULT_BENCHMARK))
    j = df.join(known, df[industry_col] == known["_b_industry"], "left")
    return j.select(*[df[c] for c in df.columns],
                    *[F.coalesce(known[c], F.lit(float(default[c]))).alias(c) for c in fixed.BENCHMARK_COLUMNS])


def modifiers(spark: SparkSession) -> DataFrame:
    """Industry modifiers keyed by lower-case industry."""
    return spark.createDataFrame(fixed.INDUSTRY_MODIFIERS, "industry_key string, e int, s int, g int")


def regulations(spark: SparkSession) -> DataFrame:
    """Regulation row per country, plus the default row (country null)."""
    return spark.createDataFrame(
        fixed.REGULATIONS,
        "country string, frameworks array<string>, key_deadlines string, penalties string, regulator string")


def with_regulation(df: DataFrame, country_col: str, spark: SparkSession) -> DataFrame:
    """Country lookup (broadcast), default row otherwise."""
    r = regulations(spark)
    known = F.broadcast(r.where(F.col("country").isNotNull()).select(
        F.col("country").alias("_r_country"), F.col("frameworks").alias("_r_fw"),
        F.col("key_deadlines").alias("_r_dl"), F.col("penalties").alias("_r_pen"),
        F.col("regulator").alias("_r_reg")))
    d = fixed.REGULATIONS[-1]
    j = df.join(known, df[country_col] == known["_r_country"], "left")
    default_fw = F.array(*[F.lit(x) for x in d[1]])
    return j.select(*[df[c] for c in df.columns],
                    F.when(F.col("_r_country").isNotNull(), F.col("_r_fw")).otherwise(default_fw).alias("frameworks"),
                    F.coalesce(F.col("_r_dl"), F.lit(d[2])).alias("key_deadlines"),
                    F.coalesce(F.col("_r_pen"), F.lit(d[3])).alias("penalties"),
                    F.coalesce(F.col("_r_reg"), F.lit(d[4])).alias("regulator"))


def risk_templates(spark: SparkSession) -> DataFrame:
    """risk/opportunity templates (industry null = default set)."""
    return spark.createDataFrame(
        fixed.RISK_OPP_TEMPLATES,
        "kind string, industry string, ord int, title string, description string, level string, "
        "fw_slot int, fw_fallback string")


def boosts(spark: SparkSession) -> DataFrame:
    """(industry, solution) pairs that get the +5 fit boost."""
    rows = [(ind, name) for ind, names in fixed.INDUSTRY_BOOSTS for name in names]
    return spark.createDataFrame(rows, "boost_industry string, boost_name string")


def kpi_improvement_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.KPI_IMPROVEMENT_MAP, "metric string, kpi string, improvement int")


def timeline(spark: SparkSession, style: str = "report") -> DataFrame:
    """The fixed compliance timeline (dashboard or report wording)."""
    if style == "dashboard":
        return spark.createDataFrame(
            fixed.DASHBOARD_TIMELINE, "phase string, timeframe string, actions string, deliverable string")
    return spark.createDataFrame(
        fixed.REPORT_TIMELINE, "timeframe string, phase string, actions string, deliverable string")


def scale_map(scale: dict) -> F.Column:
    """Size -> scale as a literal map for ``element_at`` lookups."""
    return F.create_map(*[x for k, v in scale.items() for x in (F.lit(k), F.lit(float(v)))])


def size_scale(size_col: F.Column, scale: dict) -> F.Column:
    return F.coalesce(F.try_element_at(scale_map(scale), size_col), F.lit(1.0))
