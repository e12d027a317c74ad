"""Readers for the driver tables and the company panel derived from them.

The panel (one row per company and year, canonical metric columns) is built
from ``lineitem`` and ``supplier``: the line items are aggregated per
(supplier, ship year) *before* the join, so the big table is reduced by
map-side partial aggregation and only one row per supplier-year meets the
supplier dimension.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Canonical panel columns in order (company, dimensions, year, metrics).
PANEL_METRICS = [
    "employees", "revenue", "esg_budget", "carbon_emissions", "energy", "renewable_energy",
    "water", "waste_total", "waste_recycled", "gender_diversity", "employee_turnover",
    "training", "board_independence", "safety", "community_investment",
    "scope1", "scope2", "scope3",
]
PANEL_COLUMNS = ["company", "industry", "country", "year"] + PANEL_METRICS

# Identity column map for the canonical panel (detection on these names
# misplaces revenue and misses safety; see operators.schema).
IDENTITY_MAP = {c: c for c in PANEL_COLUMNS}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def esg_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company x year panel derived from line items (FIXTURES F17)."""
    li = read_table(spark, sf_dir, "lineitem")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")

    # Exact sums in integer hundredths (BIGINT, the long-backed fast path)
    # instead of DECIMAL(18,2) sums (whose DECIMAL(28,2) result falls back to
    # BigDecimal arithmetic). N / 100.0 is the correctly rounded double of the
    # exact decimal sum, i.e. the same value CAST(SUM(decimal) AS DOUBLE) gives.
    # Overflow would need ~1e11 line items in one supplier-year; ANSI mode
    # raises on it rather than wrapping. Formulas are SQL expression text: one
    # JVM call each instead of one per operator.
    def cents(c):
        return (f"CAST(CASE WHEN {c} >= 0 THEN FLOOR({c} * 100D + 0.5D) "
                f"ELSE -FLOOR(-{c} * 100D + 0.5D) END AS BIGINT)")

    qty = cents("l_quantity")
    aggs = [
        f"sum({cents('l_extendedprice')}) AS _rev",
        f"sum({cents('l_extendedprice')} * {cents('l_tax')}) AS _budget",
        f"sum({qty}) AS _qty",
        "count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS _n_n",
        "sum(l_linenumber) AS _lines",
        "count(1) AS _n",
        "count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS _n_f",
        "count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS _n_a",
        f"sum({cents('l_discount')}) AS _disc",
        "count(CASE WHEN l_tax >= 0.04D THEN 1 END) AS _n_tax",
        "count(CASE WHEN l_discount < 0.005D THEN 1 END) AS _n_low",
        f"sum({cents('l_tax')}) AS _tax",
        f"sum(CASE WHEN l_returnflag = 'A' THEN {qty} END) AS _q_a",
        f"sum(CASE WHEN l_returnflag = 'N' THEN {qty} END) AS _q_n",
        f"sum(CASE WHEN l_returnflag = 'R' THEN {qty} END) AS _q_r",
    ]
    key = [F.col("l_suppkey"), F.year("l_shipdate").alias("year")]
    per_year = li.groupBy(*key).agg(*[F.expr(a) for a in aggs])
    # The distinct order count runs as its own narrow aggregation (three
    # columns through the shuffle) instead of dragging every other partial
    # aggregate through the (supplier, year, order) level; both sides come out
    # hash-partitioned on (supplier, year), so the join adds no exchange.
    orders = (li.select(*key, "l_orderkey").distinct()
              .groupBy("l_suppkey", "year").agg(F.count(F.lit(1)).alias("employees")))
    joined = per_year.join(orders, ["l_suppkey", "year"]).join(sup, F.col("l_suppkey") == sup.s_suppkey)
    c2 = "(CAST({} AS DOUBLE) / 100D)".format  # hundredths -> value
    return joined.selectExpr(
        "s_name AS company",
        f"{INDUSTRY_SQL} AS industry",
        f"{COUNTRY_SQL} AS country",
        "CAST(year AS BIGINT) AS year",
        "employees",
        f"{c2('_rev')} AS revenue",
        "CAST(_budget AS DOUBLE) / 10000D / 10D AS esg_budget",
        f"{c2('_qty')} / 8D AS carbon_emissions",
        f"{c2('_qty')} * 3D AS energy",
        "100D * _n_n / _n AS renewable_energy",
        "CAST(_lines AS DOUBLE) AS water",
        "CAST(_n AS DOUBLE) AS waste_total",
        "100D * _n_f / _n AS waste_recycled",
        "CASE WHEN _n >= 90 THEN 100D * _n_a / _n END AS gender_diversity",
        f"400D * {c2('_disc')} / _n AS employee_turnover",
        f"{c2('_qty')} / _n AS training",
        "100D * _n_tax / _n AS board_independence",
        "CAST(_n_low AS DOUBLE) AS safety",
        f"CASE WHEN pmod(s_suppkey, 5) != 0 THEN {c2('_tax')} * 1000D END AS community_investment",
        f"{c2('_q_a')} AS scope1",
        f"{c2('_q_n')} AS scope2",
        f"{c2('_q_r')} AS scope3",
        "s_suppkey * 10000 + year AS _row_id",
    )


INDUSTRY_SQL = ("CASE pmod(s_suppkey, 6) WHEN 0 THEN 'Technology' WHEN 1 THEN 'Finance' "
                "WHEN 2 THEN 'Manufacturing' WHEN 3 THEN 'Energy' WHEN 4 THEN 'Financial Services' "
                "ELSE 'Automotive' END")
COUNTRY_SQL = ("CASE pmod(s_nationkey, 5) WHEN 0 THEN 'Germany' WHEN 1 THEN 'United States' "
               "WHEN 2 THEN 'Japan' WHEN 3 THEN 'Brazil' ELSE 'Norway' END")


def company_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile per company (FIXTURES F5): head count, ESG budget, industry, country."""
    return read_table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS company", "pmod(s_suppkey * 37, 2000) AS employee_count", "s_acctbal * 100D AS budget",
        f"{INDUSTRY_SQL} AS industry", f"{COUNTRY_SQL} AS country",
        "CASE WHEN pmod(s_suppkey * 37, 2000) >= 250 THEN 'Large' WHEN pmod(s_suppkey * 37, 2000) >= 50 THEN 'Medium' "
        "ELSE 'Small' END AS business_size")
