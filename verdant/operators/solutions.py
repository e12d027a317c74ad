"""Solution ranking (B6, W3), ROI timeline (W6), cost display.

Each company gets the six catalogue entries through ``inline`` over a literal
array (a Generate node, no join); the industry boost is a broadcast lookup;
the per-company rank is a window over groups of exactly six rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdant import fixed
from verdant.functions.numeric import py_round
from verdant.operators import dims


def _catalogue():
    return F.array(*[F.struct(F.lit(o).alias("template_ord"), F.lit(n).alias("name"),
                              F.lit(c).alias("category"), F.lit(d).alias("description"),
                              F.lit(float(lo)).alias("cost_low"), F.lit(float(hi)).alias("cost_high"),
                              F.lit(float(sv)).alias("savings"), F.lit(float(pb)).alias("payback_years"),
                              F.lit(int(fit)).alias("base_fit"))
                     for o, n, c, d, lo, hi, sv, pb, fit in fixed.SOLUTIONS])


def thousands(c) -> F.Column:
    """``f"{x/1000:.0f}"`` with half-even rounding."""
    return F.format_string("%.0f", py_round(c / F.lit(1000.0), 0))


def rank_solutions(profiles: DataFrame, carry: list[str] | tuple = ()) -> DataFrame:
    """B6 per company. ``profiles``: company, industry, business_size, budget.
    ``carry``: extra per-company columns passed through to every solution row
    (so later steps need no join back)."""
    spark = profiles.sparkSession
    carry = [c for c in carry if c not in ("company", "industry", "business_size", "budget")]
    scale = dims.size_scale(F.col("business_size"), fixed.COST_SCALE)
    sol = profiles.select("company", "industry", "business_size", "budget", *carry, F.inline(_catalogue()))
    sol = (sol.withColumn("upfront_cost_low", F.col("cost_low") * scale)
              .withColumn("upfront_cost_high", F.col("cost_high") * scale)
              .withColumn("annual_savings", F.col("savings") * scale))
    boost = F.broadcast(dims.boosts(spark))
    sol = sol.join(boost, (sol["industry"] == boost["boost_industry"]) & (sol["name"] == boost["boost_name"]),
                   "left")
    fit = F.when(F.col("boost_name").isNotNull(), F.least(F.col("base_fit") + 5, F.lit(100))) \
           .otherwise(F.col("base_fit"))
    budget = F.col("budget").cast("double")
    over = budget.isNotNull() & (budget > 0) & (F.col("upfront_cost_low") > budget * F.lit(2.0))
    fit = F.when(over, F.greatest(fit - 15, F.lit(10))).otherwise(fit)
    sol = sol.withColumn("fit_score", fit.cast("int"))
    w = Window.partitionBy("company").orderBy(F.col("fit_score").desc(), F.col("template_ord").asc())
    sol = sol.withColumn("rank", F.row_number().over(w).cast("bigint"))
    avg_cost = (F.col("upfront_cost_low") + F.col("upfront_cost_high")) / F.lit(2.0)
    return sol.select(
        "company", "rank", "template_ord", "name", "category", "description", "fit_score",
        "upfront_cost_low", "upfront_cost_high", "annual_savings", "payback_years",
        avg_cost.alias("avg_cost"),
        F.concat(F.lit("$"), thousands(avg_cost), F.lit("K")).alias("investment_display"),
        F.format_string("%.1f yrs", F.col("payback_years")).alias("payback_display"),
        F.concat(F.lit("$"), thousands(F.col("upfront_cost_low")), F.lit("K–$"),
                 thousands(F.col("upfront_cost_high")), F.lit("K")).alias("cost_range"),
        F.concat(F.lit("$"), thousands(F.col("annual_savings")), F.lit("K/yr")).alias("savings_display"),
        *(["industry", "business_size", "budget", *carry] if carry else []))


def roi_timeline(ranked: DataFrame, top: int = 4, years: int = 5) -> DataFrame:
    """Cumulative net value per year 0..``years`` for the top solutions:
    -mean(cost low, cost high) + savings * year (closed form)."""
    top_sol = ranked.where(F.col("rank") <= top)
    return (top_sol.select("company", "rank", "name", "avg_cost", "annual_savings",
                           F.explode(F.sequence(F.lit(0), F.lit(years))).alias("year"))
            .select("company", "rank", "name", F.col("year").cast("bigint").alias("year"),
                    (-F.col("avg_cost") + F.col("annual_savings") * F.col("year")).alias("cumulative_value")))
