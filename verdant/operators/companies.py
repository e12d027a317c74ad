"""Per-company context: profile + data completeness + maturity.

Joins are on the company key only; the dimension lookups inside ``maturity``
are broadcast (fixed-size tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import fixed
from verdant.functions.numeric import py_round, py_round_sql
from verdant.operators import dims
from verdant.operators.score import maturity, sql_literal


def money0(c) -> F.Column:
    """``f"{x:,.0f}"``: round half-even to a whole number first, then group."""
    return F.format_string("%,.0f", py_round(c, 0))


def company_maturity(profiles: DataFrame, panel: DataFrame, col_map: dict, facts: DataFrame | None = None) -> DataFrame:
    """Each company's profile with maturity recomputed on its own rows
    (the completeness of its panel rows drives the governance adjustment).
    The result carries the company facts (latest row, per-metric first /
    last values), so later operators need no second pass over the panel;
    ``facts`` puts another per-company table with ``completeness_pct`` in their place."""
    from verdant.operators.facts import company_facts
    spark = profiles.sparkSession
    facts = company_facts(panel, col_map) if facts is None else facts
    base = profiles.join(facts, "company")
    m = maturity(base, dims.modifiers(spark), "completeness_pct")
    budget, staff = "coalesce(CAST(budget AS DOUBLE), 0D)", "CAST(coalesce(employee_count, 0) AS BIGINT)"
    money = lambda x: f"format_string('%,.0f', {py_round_sql(x, 0)})"
    words = ["lower(coalesce(business_size, 'Medium'))", "lower(industry)", staff, money(budget),
             money(f"{budget} / greatest(CAST({staff} AS DOUBLE), 1D)")]
    # A null industry makes the whole text null.
    return m.selectExpr("*", f"CASE WHEN industry IS NOT NULL THEN format_string({sql_literal(fixed.MATURITY_RATIONALE)}, "
                             f"{', '.join(words)}) END AS m_rationale")


def maturity_view(cm: DataFrame) -> DataFrame:
    return cm.select("company", "industry", "country", "employee_count", "budget", "business_size",
                     "completeness_pct", F.col("m_environmental").alias("environmental"),
                     F.col("m_social").alias("social"), F.col("m_governance").alias("governance"),
                     F.col("m_overall").alias("overall"), F.col("m_grade").alias("grade"),
                     F.col("m_rationale").alias("rationale"))


__all__ = ["company_maturity", "maturity_view", "money0", "py_round"]
