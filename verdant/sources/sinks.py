"""Exports and report datasets.

Spreadsheet and PDF rendering are single-machine formats; here every sheet or
report section is a DataFrame keyed by company. A bundle is one table of all
their rows, tagged with the sheet: one plan, written by one job, clustered by
company, each sheet a folder of its own to be read back with ``read_sheet``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.functions.names import named, quoted
from verdant.functions.numeric import py_float_str
from verdant.operators.companies import money0

PROFILE_FIELDS = ["Industry", "Country", "Employees", "ESG Budget", "Business Size", "ESG Grade",
                  "Overall Score", "Environmental", "Social", "Governance"]
SOLUTION_SHEET = {"rank": "Rank", "name": "Solution", "category": "Category", "fit_score": "Fit Score",
                  "upfront_cost_low": "Cost Low ($)", "upfront_cost_high": "Cost High ($)",
                  "annual_savings": "Annual Savings ($)", "payback_years": "Payback (yrs)"}
KPI_SHEET = {"solution": "Solution", "kpi": "KPI", "current": "Current", "projected": "Projected",
             "improvement_pct": "Improvement_Pct"}
BENCHMARK_SHEET = {"metric": "Metric", "company_value": "Company_Value", "industry_avg": "Industry_Avg",
                   "top_quartile": "Top_Quartile", "gap": "Gap", "status": "Status"}


def profile_sheet(cm: DataFrame) -> DataFrame:
    """S5 sheet 1: ten Field / Value rows per company."""
    na = F.lit("N/A")
    vals = [F.coalesce(F.col("industry"), na), F.coalesce(F.col("country"), na),
            F.coalesce(F.col("employee_count").cast("string"), na),
            F.concat(F.lit("$"), money0(F.coalesce(F.col("budget").cast("double"), F.lit(0.0)))),
            F.coalesce(F.col("business_size"), na), F.coalesce(F.col("m_grade"), na),
            py_float_str(F.col("m_overall")), py_float_str(F.col("m_environmental")),
            py_float_str(F.col("m_social")), py_float_str(F.col("m_governance"))]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("field_ord"), F.lit(f).alias("field"), v.alias("value"))
                     for i, (f, v) in enumerate(zip(PROFILE_FIELDS, vals))])
    return cm.select("company", F.inline(rows))


def solutions_sheet(ranked: DataFrame) -> DataFrame:
    """S5 sheet 2: the ranked solutions with display names."""
    return ranked.select("company", *[F.col(k).alias(v) for k, v in SOLUTION_SHEET.items()])


def with_report_defaults(cm: DataFrame, regulation: DataFrame | None = None):
    """S8 defaults: a company without maturity scores reports 50 / 50 / 50 /
    50 and grade C; without a regulation row, no frameworks and "N/A"."""
    for c in ("m_overall", "m_environmental", "m_social", "m_governance"):
        cm = cm.withColumn(c, F.coalesce(F.col(c), F.lit(50.0)))
    cm = cm.withColumn("m_grade", F.coalesce(F.col("m_grade"), F.lit("C")))
    if regulation is not None:
        regulation = regulation.select(
            "company", F.coalesce(F.col("frameworks"), F.lit("")).alias("frameworks"),
            *[F.coalesce(F.col(c), F.lit("N/A")).alias(c) for c in ("key_deadlines", "penalties", "regulator")])
    return cm, regulation


def quality_section(summary: DataFrame, col_map: dict) -> DataFrame:
    """The data-quality paragraph per company from ``company_summary``,
    and the line of detected columns (null when none was)."""
    years = F.when(F.col("year_min").isNotNull(), F.format_string("Year range: %d-%d. ", "year_min", "year_max"))
    text = F.concat(F.format_string("Dataset: %d rows, %d columns. ", "row_count", "col_count"), F.lit("Completeness: "),
                    F.coalesce(py_float_str(F.col("completeness_pct")), F.lit("N/A")), F.lit("%. "), F.coalesce(years, F.lit("")))
    found = F.lit(f"ESG columns auto-detected: {', '.join(col_map)}." if col_map else None).cast("string")
    return summary.select("company", text.alias("quality"), found.alias("detected"))


def report_datasets(mode: str, cm: DataFrame, ranked: DataFrame, regulation: DataFrame, risks: DataFrame,
                    kpis: DataFrame, bench: DataFrame | None, pillars: DataFrame, timeline: DataFrame,
                    narrative: DataFrame | None = None, quality: DataFrame | None = None) -> dict:
    """The sections of the executive (``mode="executive"``) or
    detailed (any other mode) report. ``narrative`` (``executive_summary``) is the
    overview of the former; ``quality`` (``quality_section``) the data-quality paragraph of the
    latter; both are left out where there is none."""
    cm, regulation = with_report_defaults(cm, regulation)
    fw = (regulation.where(F.col("frameworks") != "")
          .select("company", F.posexplode(F.split("frameworks", r" \| ")).alias("pos", "framework")))
    if mode == "executive":
        return {
            **({} if narrative is None else {"narrative": narrative}),
            "pillars": pillars.select("company", "pillar", "score", "status"),
            "top_actions": ranked.where(F.col("rank") <= 3).select(
                "company", "rank", "name", "category", "investment_display", "payback_display"),
            "frameworks": fw.where(F.col("pos") < 4),
            "regulation": regulation.select("company", "key_deadlines", "regulator", "penalties"),
            "risks": risks.where((F.col("kind") == "risk") & (F.col("ord") <= 3)),
        }
    return {
        "profile": profile_sheet(cm),
        **({} if quality is None else {"quality": quality}),
        "pillars": pillars.select("company", "pillar", "score", "status_detailed"),
        "benchmark": bench if bench is not None else cm.sparkSession.createDataFrame([], "company string"),
        "risks": risks.where(F.col("kind") == "risk"),
        "opportunities": risks.where(F.col("kind") == "opportunity"),
        "solutions": ranked,
        "kpis": kpis.where(F.col("rank") == 1),
        "frameworks": fw,
        "regulation": regulation.select("company", "key_deadlines", "penalties", "regulator"),
        "timeline": timeline,
    }


def kpi_sheet(kpis: DataFrame) -> DataFrame:
    """S5 sheet 3: the KPI projections of every solution with display names."""
    return kpis.select("company", *[F.col(k).alias(v) for k, v in KPI_SHEET.items()])


def benchmark_sheet(bench: DataFrame) -> DataFrame:
    """S5 sheet 4: the benchmark comparison with display names."""
    return bench.select("company", *[F.col(k).alias(v) for k, v in BENCHMARK_SHEET.items()])


def workbook(cm: DataFrame, ranked: DataFrame, kpis: DataFrame, bench: DataFrame | None) -> dict[str, DataFrame]:
    """The four sheets of the export, by name; a missing one is left out."""
    sheets = {"Profile & Maturity": profile_sheet(cm), "Solutions": solutions_sheet(ranked), "KPI Projections": kpi_sheet(kpis)}
    return sheets if bench is None else sheets | {"Benchmarks": benchmark_sheet(bench)}


def bundle(sheets: dict[str, DataFrame]) -> DataFrame:
    """The rows of all sheets in one table: ``company`` (null for a sheet that
    is the same for all), ``sheet`` and a struct column for each sheet, which
    holds the row's cells and is null in the rows of other sheets."""
    def tagged(name: str, df: DataFrame) -> DataFrame:
        company = F.col("company") if "company" in df.columns else F.lit(None).cast("string")
        cells = F.struct(*[named(c) for c in df.columns if c != "company"])
        return df.select(company.alias("company"), F.lit(name).alias("sheet"), cells.alias(name))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tagged(n, df) for n, df in sheets.items()])


def write_bundle(sheets: dict[str, DataFrame], path: str, num_files: int | None = None) -> None:
    """Writes ``bundle`` below ``path`` in one job: a folder per sheet with any
    rows, in it files of neighbouring companies, each company's rows together.
    A read of one company skips the other files by their statistics. Sheets
    that are given by one pass over shared rows are computed in one (see ``shared``)."""
    rows = bundle(sheets).withColumnRenamed("sheet", "_sheet")
    by = ["company", "_sheet"]
    ranged = rows.repartitionByRange(num_files, *by) if num_files else rows.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").partitionBy("_sheet").parquet(path)


def read_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One sheet of a bundle, as it was handed to ``write_bundle`` (``company`` first)."""
    return spark.read.parquet(path).where(F.col("_sheet") == name).select("company", f"{quoted(name)}.*")


def shared(df: DataFrame) -> DataFrame:
    """``df`` dealt once by a hash that names every column: branches of a plan
    that use different columns of it still ask for the same shuffle, so Spark computes it once."""
    return df.repartition(F.xxhash64(*[named(c) for c in df.columns]))
