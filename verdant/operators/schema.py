"""V1: metric-column detection by name patterns.

Rules: a column name is lower-cased with spaces turned into ``_``; for each
(metric, column) only the *first* pattern of the metric's list that the
column contains counts, scoring its length; per metric the highest score
wins, ties keep the earlier column. One column may serve several metrics.

For one table this is a dict built from ``df.columns`` on the driver (no
scan). For many tables at once it is a Spark job: the (table, column) list is
joined to the broadcast pattern table on ``contains`` (a theta join against a
fixed ~90-row table), then reduced per (table, metric).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdant.fixed import COLUMN_PATTERNS
from verdant.functions.names import named, user_columns


def detect_columns(columns: list[str]) -> dict[str, str]:
    """Driver-side detection for one table's column list."""
    keys = [c.lower().replace(" ", "_") for c in columns]

    def rank(patterns: list[str], place: int) -> tuple[int, int]:
        """(-length of the column's first pattern, place): the least one wins."""
        return -len(next((p for p in patterns if p in keys[place]), "")), place

    winners = {metric: min((rank(patterns, i) for i in range(len(columns))), default=(0, 0))
               for metric, patterns in COLUMN_PATTERNS.items()}
    return {metric: columns[place] for metric, (score, place) in winners.items() if score}


def pattern_table(spark: SparkSession) -> DataFrame:
    rows = [(m_ord, metric, p_ord, p) for m_ord, (metric, pats) in enumerate(COLUMN_PATTERNS.items())
            for p_ord, p in enumerate(pats)]
    return spark.createDataFrame(rows, "metric_ord int, metric string, pattern_ord int, pattern string")


def column_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "table_name string, column_ord int, column_name string")


def detect_columns_df(columns: DataFrame) -> DataFrame:
    """Detection for a (table_name, column_ord, column_name) DataFrame.

    Returns (table_name, metric, column_name, score)."""
    spark = columns.sparkSession
    pats = F.broadcast(pattern_table(spark))
    keyed = columns.withColumn("_key", F.lower(F.replace(F.col("column_name"), F.lit(" "), F.lit("_"))))
    hits = keyed.join(pats, F.contains(F.col("_key"), F.col("pattern")))
    first_hit = (hits.groupBy("table_name", "column_ord", "column_name", "metric")
                 .agg(F.min_by("pattern", "pattern_ord").alias("pattern")))
    scored = first_hit.withColumn("score", F.length("pattern"))
    w = Window.partitionBy("table_name", "metric").orderBy(F.col("score").desc(), F.col("column_ord").asc())
    return (scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("table_name", "metric", "column_name", F.col("score").cast("bigint").alias("score")))


def detected_values(df: DataFrame, table: str) -> DataFrame:
    """The columns that detection picks in ``df`` and, in one pass over them,
    the rows and non-null values each holds: (table_name, metric, column_name,
    n_rows, n_values); no row for a table without such columns."""
    found = list(detect_columns(user_columns(df.columns)).items())
    if not found:
        return df.sparkSession.createDataFrame(
            [], "table_name string, metric string, column_name string, n_rows bigint, n_values bigint")
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(named(c)).alias(f"v{i}") for i, (_, c) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column_name"), F.col("n_rows").alias("n_rows"),
                              F.col(f"v{i}").alias("n_values")) for i, (m, c) in enumerate(found)])
    return one.select(F.lit(table).alias("table_name"), F.inline(rows))
