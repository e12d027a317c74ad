"""Everything the per-company operators need from the panel, in ONE
aggregation keyed by company (map-side partials, one shuffle):

* row count, null count, completeness and year range (A1, A2);
* the mapped metrics of the latest row (W1), as numbers, in a struct by column;
* for every mapped metric: the number of values and the first and last
  non-null value in year order (A9).

Every aggregate is over numbers, so it is a hash aggregation. Maturity, benchmarks, KPI projections and trends all read this table, so a
query over them computes the panel once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions.names import quoted, user_columns
from verdant.functions.numeric import py_round_sql
from verdant.operators.latest import company_key, with_row_order
from verdant.operators.score import metric_sql, number_sql

DIMENSIONS = ("company", "industry", "country", "year")


def trend_metrics(col_map: dict, columns: list[str]) -> list[tuple[str, str]]:
    return [(m, c) for m, c in col_map.items() if m not in DIMENSIONS and c in columns]


def company_facts(panel: DataFrame, col_map: dict, row_id: str = "_row_id") -> DataFrame:
    keyed = with_row_order(company_key(panel, col_map), col_map, row_id)
    types = {f.name: f.dataType for f in panel.schema.fields}
    user_cols = user_columns(panel.columns)
    # Rows are ordered by the raw year value (as a sort of the column would
    # order them; a missing year last); the year range uses coerced numbers.
    year = number_sql(types, col_map["year"]) if "year" in col_map else "CAST(NULL AS DOUBLE)"
    nulls = " + ".join(f"CAST({quoted(c)} IS NULL AS INT)" for c in user_cols)
    aggs = ["count(1) AS row_count", f"sum({nulls}) AS null_count",
            f"CAST(min({year}) AS BIGINT) AS year_min", f"CAST(max({year}) AS BIGINT) AS year_max"]
    metrics = trend_metrics(col_map, user_cols)
    for m, _ in metrics:
        v = metric_sql(types, col_map, m)
        aggs += [f"count({v}) AS n_{m}", f"max_by({v}, _order) AS _latest_{m}",
                 f"min_by({v}, CASE WHEN {v} IS NOT NULL THEN _order END) AS first_{m}",
                 f"max_by({v}, CASE WHEN {v} IS NOT NULL THEN _order END) AS last_{m}"]
    out = keyed.groupBy(F.col("_company").alias("company")).agg(*[F.expr(a) for a in aggs])
    ncol = len(user_cols)
    by_column = {c: m for m, c in metrics}  # two metrics may share a column
    latest = ", ".join(f"_latest_{m} AS {quoted(c)}" for c, m in by_column.items())
    kept = [c for c in out.columns if not c.startswith("_latest_")]
    return out.selectExpr(
        *kept, f"struct({latest}) AS latest" if latest else "CAST(NULL AS STRUCT<none: DOUBLE>) AS latest",
        f"CAST({ncol} AS BIGINT) AS col_count",
        py_round_sql(f"(1D - null_count / (row_count * {float(ncol)}D)) * 100D", 1) + " AS completeness_pct")
