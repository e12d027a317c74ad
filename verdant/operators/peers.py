"""B4 peer comparison with W2 ranking, for all companies in one plan.

latest row per company (one aggregation) -> B1 score columns -> distributed
global rank (score desc, company asc). Fewer than two companies, or no
company column, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.fixed import PEER_METRICS
from verdant.functions.numeric import py_round
from verdant.operators.latest import latest_metrics
from verdant.operators.score import esg_score, metric_value
from verdant.plans.ordinal import global_rank


def scored_latest(panel: DataFrame, col_map: dict, null_year: str = "keep") -> DataFrame:
    """The year and metrics of each company's latest row with the B1 score columns."""
    return esg_score(latest_metrics(panel, col_map, null_year=null_year), col_map)


def peer_comparison(panel: DataFrame, col_map: dict, null_year: str = "keep") -> DataFrame:
    if "company" not in col_map:
        return panel.sparkSession.createDataFrame([], "rank bigint, company string")
    scored = scored_latest(panel, col_map, null_year)
    metric_cols = []
    for m in PEER_METRICS:
        v = metric_value(scored, col_map, m)
        if v is not None:
            metric_cols.append(py_round(v, 1).alias(m))
    base = scored.select(
        F.col("_company").alias("company"), "esg_score", "grade", "environmental", "social",
        "governance", *metric_cols)
    ranked = global_rank(base, [("esg_score", "desc"), ("company", "asc")], total_col="_n_companies")
    out = ranked.where(F.col("_n_companies") >= 2).drop("_n_companies")
    return out.select("rank", *[c for c in out.columns if c != "rank"])


# Display names used by the dashboard table.
DISPLAY_NAMES = {
    "rank": "Rank", "company": "Company", "esg_score": "ESG Score", "grade": "Grade",
    "environmental": "Environmental", "social": "Social", "governance": "Governance",
    **{m: m.replace("_", " ").title() for m in PEER_METRICS},
}


def for_display(peers: DataFrame, selected: str | None = None) -> DataFrame:
    """P9 rename for display, U1 highlight flag for the selected company."""
    out = peers.select(*[F.col(c).alias(DISPLAY_NAMES.get(c, c)) for c in peers.columns])
    if selected is not None:
        out = out.withColumn("is_selected", F.col("Company") == F.lit(selected))
    return out
