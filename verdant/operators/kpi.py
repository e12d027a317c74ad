"""KPI projections (B5), trend-based projections (J8) and the KPI heatmap.

B5: every (company, ranked solution) gets the five KPI templates through
``inline`` (no join); measured baselines come from the company's latest row.
J8: the company's metric trends joined to the fixed improvement map
(broadcast) and to its own top three solutions (equi-join on company).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import fixed
from verdant.functions.numeric import py_round
from verdant.operators import dims

KPI_COLUMN_NAMES = {1: "carbon_emissions_tco2e", 2: "energy_efficiency_pct", 3: "employee_satisfaction_pct",
                    4: "waste_diversion_rate_pct", 5: "esg_disclosure_score"}


def _templates():
    return F.array(*[F.struct(F.lit(o).alias("kpi_ord"), F.lit(k).alias("kpi"),
                              F.lit(float(b)).alias("base_default"), F.lit(int(i)).alias("imp_default"))
                     for o, k, b, i in fixed.KPI_TEMPLATES])


def kpi_projection(ranked: DataFrame, col_map: dict) -> DataFrame:
    """B5 per company. ``ranked``: ``solutions.rank_solutions`` output
    carrying ``business_size`` and the company's ``latest`` row."""
    from verdant.operators.benchmark import latest_values
    measured = {kpi: (m, imp) for m, kpi, imp in fixed.KPI_MEASURED}
    sol = latest_values(ranked, col_map, [m for m, _, _ in fixed.KPI_MEASURED], "b_")
    scale = dims.size_scale(F.col("business_size"), fixed.KPI_SCALE)
    rows = sol.select("company", "rank", F.col("name").alias("solution"), scale.alias("_scale"),
                      *[f"b_{m}" for m, _, _ in fixed.KPI_MEASURED], F.inline(_templates()))
    base = F.when(F.col("kpi_ord") == 1, F.col("base_default") * F.col("_scale")).otherwise(F.col("base_default"))
    imp = F.col("imp_default")
    # A template uses the measured value when a measured KPI has the same name.
    for kpi, (m, m_imp) in measured.items():
        hit = (F.col("kpi") == F.lit(kpi)) & F.col(f"b_{m}").isNotNull()
        base = F.when(hit, F.col(f"b_{m}")).otherwise(base)
        imp = F.when(hit, F.lit(m_imp)).otherwise(imp)
    rows = rows.withColumn("_base", base).withColumn("improvement_pct", imp.cast("int"))
    proj = F.col("_base") * (F.lit(1.0) + F.col("improvement_pct") / F.lit(100.0))
    return rows.select("company", "rank", "solution", "kpi_ord", "kpi",
                       py_round(F.col("_base"), 1).alias("current"), py_round(proj, 1).alias("projected"),
                       "improvement_pct")


def kpi_heatmap(kpis: DataFrame) -> DataFrame:
    """Per (company, solution) one column per KPI with its improvement %."""
    ords = sorted(KPI_COLUMN_NAMES)
    p = kpis.groupBy("company", "solution").pivot("kpi_ord", ords).agg(F.first("improvement_pct"))
    return p.select("company", "solution", *[F.col(str(o)).alias(KPI_COLUMN_NAMES[o]) for o in ords])


def kpi_real(ranked: DataFrame, col_map: dict, top: int = 3) -> DataFrame:
    """Trend metrics with an improvement rule, for each of the top
    solutions. ``ranked`` carries the per-metric facts columns."""
    from verdant.operators.trends import trends_from_facts
    top_sol = ranked.where(F.col("rank") <= top).withColumnRenamed("name", "solution")
    t = trends_from_facts(top_sol, col_map)
    imp = F.broadcast(dims.kpi_improvement_map(ranked.sparkSession))
    j = t.join(imp, "metric")
    proj = F.col("last_value") * (F.lit(1.0) + F.col("improvement") / F.lit(100.0))
    return j.select("company", "rank", "solution", "metric", "kpi",
                    py_round(F.col("last_value"), 1).alias("current"), py_round(proj, 1).alias("projected"),
                    F.col("improvement").alias("improvement_pct"))
