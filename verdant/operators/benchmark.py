"""Benchmark comparison (B7, B8), gap list (P5), regulation (J2), compliance
readiness (B9), pillar status (B10), radar references (B11).

The seven benchmark rows per company are generated with ``inline`` over an
array of structs (no join); the industry benchmark and regulation lookups are
broadcast joins against fixed-size dimension tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import fixed
from verdant.functions.numeric import py_round
from verdant.operators import dims
from verdant.operators.score import metric_sql, pillar_status, readiness


def latest_values(cm: DataFrame, col_map: dict, metrics, prefix: str = "b_") -> DataFrame:
    """Metric values of each company's latest row (the ``latest`` struct of
    the company facts), coerced, as columns ``<prefix><metric>``."""
    types = {f.name: f.dataType for f in cm.schema["latest"].dataType.fields}
    out = []
    for m in metrics:
        v = metric_sql(types, col_map, m, prefix="latest.")
        out.append(F.expr(v if v else "CAST(NULL AS DOUBLE)").alias(f"{prefix}{m}"))
    return cm.select("*", *out)


def benchmark_comparison(cm: DataFrame, col_map: dict) -> DataFrame:
    """B7 per company. ``cm`` is the company context from
    ``companies.company_maturity`` (maturity pillars, industry, latest row)."""
    spark = cm.sparkSession
    real = latest_values(cm, col_map, ("renewable_energy", "gender_diversity", "esg_budget"), "real_")
    j = dims.with_benchmark(real, "industry", spark)
    avg, top = F.col("esg_score_avg"), F.col("esg_score_top_quartile")
    ren, gen, dis = F.col("renewable_energy_pct"), F.col("gender_diversity_pct"), F.col("esg_disclosure_pct")
    r1 = lambda c: py_round(c, 1)

    def row(ord_, name, cv, ia, tq):
        return F.struct(F.lit(ord_).alias("metric_ord"), F.lit(name).alias("metric"),
                        cv.cast("double").alias("cv"), ia.cast("double").alias("ia"),
                        tq.cast("double").alias("tq"))

    rows = F.array(
        row(1, "Overall ESG Score", F.col("m_overall"), avg, top),
        row(2, "Environmental Pillar", F.col("m_environmental"), r1(avg * F.lit(0.95)), r1(top * F.lit(0.95))),
        row(3, "Social Pillar", F.col("m_social"), avg, top),
        row(4, "Governance Pillar", F.col("m_governance"), r1(avg * F.lit(1.05)), r1(top * F.lit(1.05))),
        row(5, "Renewable Energy (%)", F.coalesce(F.col("real_renewable_energy"), r1(ren * F.lit(0.7))),
            ren, F.least(ren * F.lit(1.5), F.lit(100.0))),
        row(6, "Gender Diversity (%)", F.coalesce(F.col("real_gender_diversity"), r1(gen * F.lit(0.85))),
            gen, F.least(gen * F.lit(1.3), F.lit(50.0))),
        row(7, "ESG Disclosure (%)", F.coalesce(F.col("real_esg_budget"), r1(dis * F.lit(0.65))),
            dis, F.least(dis * F.lit(1.2), F.lit(100.0))),
    )
    out = j.select("company", F.inline(rows))
    out = (out.withColumn("company_value", r1(F.col("cv")))
              .withColumn("industry_avg", r1(F.col("ia")))
              .withColumn("top_quartile", r1(F.col("tq"))))
    out = out.withColumn("gap", r1(F.col("company_value") - F.col("industry_avg")))
    status = (F.when(F.col("gap") > 5, "Above Average").when(F.col("gap") >= -5, "At Average")
              .otherwise("Below Average"))
    return out.withColumn("status", status).drop("cv", "ia", "tq")


def gap_below(bench: DataFrame) -> DataFrame:
    """P5: the below-average rows with their target text."""
    return (bench.where(F.col("status") == "Below Average")
            .withColumn("message", F.format_string(
                fixed.MSG_GAP_BELOW, F.col("metric"), F.col("gap"), F.col("industry_avg"), F.col("top_quartile"))))


def regulation(cm: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """J2 per company: applicable frameworks, deadlines, penalties, regulator
    (and the columns of ``keep``)."""
    r = dims.with_regulation(cm.select("company", "country", *keep), "country", cm.sparkSession)
    return r.select("company", "country", *keep, F.array_join("frameworks", " | ").alias("frameworks"),
                    F.size("frameworks").cast("bigint").alias("n_frameworks"),
                    "key_deadlines", "penalties", "regulator")


def readiness_view(cm: DataFrame) -> DataFrame:
    """B9 per company."""
    score, label = readiness(F.col("m_governance"))
    return cm.select("company", F.col("m_governance").alias("governance"),
                     score.alias("readiness_score"), label.alias("readiness_label"))


def pillar_view(cm: DataFrame) -> DataFrame:
    """B10 + B11 per company and pillar: score, the three status wordings and
    the industry reference point (industry average x 0.95 / 1 / 1.05)."""
    spark = cm.sparkSession
    j = dims.with_benchmark(cm, "industry", spark)
    avg = F.col("esg_score_avg")
    rows = F.array(
        F.struct(F.lit(1).alias("pillar_ord"), F.lit("Environmental").alias("pillar"),
                 F.col("m_environmental").alias("score"), (avg * F.lit(0.95)).alias("industry_reference")),
        F.struct(F.lit(2).alias("pillar_ord"), F.lit("Social").alias("pillar"),
                 F.col("m_social").alias("score"), (avg * F.lit(1.0)).alias("industry_reference")),
        F.struct(F.lit(3).alias("pillar_ord"), F.lit("Governance").alias("pillar"),
                 F.col("m_governance").alias("score"), (avg * F.lit(1.05)).alias("industry_reference")))
    out = j.select("company", F.inline(rows))
    return (out.withColumn("status", pillar_status(F.col("score"), "report"))
               .withColumn("status_detailed", pillar_status(F.col("score"), "detailed"))
               .withColumn("status_dashboard", pillar_status(F.col("score"), "dashboard")))
