"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the matching
DuckDB oracle SQL. Every query reads the driver tables (or the panel Spark
derives from them), so its work grows with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdant import fixed
from verdant.plans import oracle_sql as O
from verdant.sources.tables import IDENTITY_MAP, PANEL_COLUMNS, esg_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ----------------------------------------------------------------- core slice
@register("latest_row", O.LATEST_ROW)
def q_latest_row(spark, sf_dir):
    from verdant.operators.latest import latest_rows
    return latest_rows(esg_panel(spark, sf_dir), IDENTITY_MAP).drop("_company", "_row_id")


@register("esg_score", O.ESG_SCORE)
def q_esg_score(spark, sf_dir):
    from verdant.operators.peers import scored_latest
    s = scored_latest(esg_panel(spark, sf_dir), IDENTITY_MAP)
    return s.select("company", "year", "environmental", "social", "governance", "esg_score",
                    "grade", "n_e", "n_s", "n_g", "rationale")


@register("peer_comparison", O.PEER_COMPARISON)
def q_peer_comparison(spark, sf_dir):
    from verdant.operators.peers import peer_comparison
    return peer_comparison(esg_panel(spark, sf_dir), IDENTITY_MAP)


# ----------------------------------------------------------------- quality (V2-V6)
QUALITY_TABLES = ["panel", "lineitem", "orders", "customer", "events", "labels"]


def _dataset(spark, sf_dir, name):
    from verdant.sources.tables import read_table
    return esg_panel(spark, sf_dir) if name == "panel" else read_table(spark, sf_dir, name)


def _union(dfs):
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), dfs)


@register("dq_duplicates", O.DQ_DUPLICATES)
def q_dq_duplicates(spark, sf_dir):
    from verdant.operators.quality import duplicate_count
    return _union([duplicate_count(_dataset(spark, sf_dir, t), t) for t in QUALITY_TABLES])


@register("dq_missing", O.DQ_MISSING)
def q_dq_missing(spark, sf_dir):
    from verdant.operators.quality import missing_share
    return _union([missing_share(_dataset(spark, sf_dir, t), t) for t in QUALITY_TABLES])


@register("dq_constant", O.DQ_CONSTANT)
def q_dq_constant(spark, sf_dir):
    from verdant.operators.quality import constant_columns
    return _union([constant_columns(_dataset(spark, sf_dir, t), t) for t in QUALITY_TABLES])


@register("year_rule", O.YEAR_RULE)
def q_year_rule(spark, sf_dir):
    from verdant.operators.quality import year_rule
    return _union([year_rule(_dataset(spark, sf_dir, t), t)
                   for t in ["panel", "lineitem", "orders", "events", "customer"]])


# ----------------------------------------------------------------- profiling
def _panel_numeric(panel):
    from verdant.operators.quality import numeric_columns
    return numeric_columns(panel)


@register("profile_stats", O.PROFILE_STATS)
def q_profile_stats(spark, sf_dir):
    from verdant.operators.profile import column_stats
    panel = esg_panel(spark, sf_dir)
    return column_stats(panel, _panel_numeric(panel))


@register("describe", O.DESCRIBE)
def q_describe(spark, sf_dir):
    from verdant.operators.profile import describe
    panel = esg_panel(spark, sf_dir)
    return describe(panel, _panel_numeric(panel))


@register("profile_summary", O.PROFILE_SUMMARY)
def q_profile_summary(spark, sf_dir):
    from verdant.operators.profile import company_summary
    return company_summary(esg_panel(spark, sf_dir), IDENTITY_MAP)


@register("companies", O.COMPANIES)
def q_companies(spark, sf_dir):
    from verdant.operators.profile import companies_sorted
    return companies_sorted(esg_panel(spark, sf_dir), IDENTITY_MAP)


@register("companies_seen", O.COMPANIES_SEEN)
def q_companies_seen(spark, sf_dir):
    from verdant.operators.profile import companies_first_seen
    return companies_first_seen(esg_panel(spark, sf_dir), IDENTITY_MAP)


# ----------------------------------------------------------------- trends
@register("trend_metric", O.TREND_METRIC)
def q_trend_metric(spark, sf_dir):
    from verdant.operators.trends import metric_trends
    return metric_trends(esg_panel(spark, sf_dir), IDENTITY_MAP)


@register("trend_direction", O.TREND_DIRECTION)
def q_trend_direction(spark, sf_dir):
    from verdant.operators.trends import company_directions
    return company_directions(esg_panel(spark, sf_dir), IDENTITY_MAP)


@register("trend_unknown", O.TREND_UNKNOWN)
def q_trend_unknown(spark, sf_dir):
    """A11 for the names of all suppliers and customers: a customer has no panel rows."""
    from verdant.operators.trends import company_directions
    from verdant.sources.tables import read_table
    asked = read_table(spark, sf_dir, "supplier").selectExpr("s_name AS company").unionByName(
        read_table(spark, sf_dir, "customer").selectExpr("c_name AS company"))
    return company_directions(esg_panel(spark, sf_dir), IDENTITY_MAP, asked)


@register("yoy_long", O.YOY_LONG)
def q_yoy_long(spark, sf_dir):
    from verdant.operators.trends import yoy_long
    return yoy_long(esg_panel(spark, sf_dir), IDENTITY_MAP)


@register("yoy_pivot", O.YOY_PIVOT)
def q_yoy_pivot(spark, sf_dir):
    from verdant.operators.trends import yoy_pivot
    return yoy_pivot(esg_panel(spark, sf_dir), IDENTITY_MAP, O.YEARS)


# ----------------------------------------------------------------- company context
def _ctx(spark, sf_dir):
    from verdant.operators.companies import company_maturity
    from verdant.sources.tables import company_profiles
    panel = esg_panel(spark, sf_dir)
    profiles = company_profiles(spark, sf_dir)
    cm = company_maturity(profiles, panel, IDENTITY_MAP)
    return panel, profiles, cm


@register("size_class", O.SIZE_CLASS)
def q_size_class(spark, sf_dir):
    from verdant.sources.tables import company_profiles
    return company_profiles(spark, sf_dir).select("company", "employee_count", "business_size")


@register("maturity", O.MATURITY)
def q_maturity(spark, sf_dir):
    from verdant.operators.companies import maturity_view
    return maturity_view(_ctx(spark, sf_dir)[2])


@register("readiness", O.READINESS)
def q_readiness(spark, sf_dir):
    from verdant.operators.benchmark import readiness_view
    return readiness_view(_ctx(spark, sf_dir)[2])


@register("pillar_status", O.PILLAR_STATUS)
def q_pillar_status(spark, sf_dir):
    from verdant.operators.benchmark import pillar_view
    return pillar_view(_ctx(spark, sf_dir)[2])


@register("benchmark_compare", O.BENCHMARK_COMPARE)
def q_benchmark_compare(spark, sf_dir):
    from verdant.operators.benchmark import benchmark_comparison
    return benchmark_comparison(_ctx(spark, sf_dir)[2], IDENTITY_MAP)


@register("gap_below", O.GAP_BELOW)
def q_gap_below(spark, sf_dir):
    from verdant.operators.benchmark import benchmark_comparison, gap_below
    return gap_below(benchmark_comparison(_ctx(spark, sf_dir)[2], IDENTITY_MAP))


@register("regulation", O.REGULATION)
def q_regulation(spark, sf_dir):
    from verdant.operators.benchmark import regulation
    return regulation(_ctx(spark, sf_dir)[2])


def _fact_columns(cm):
    return ["latest", "country", "employee_count", "m_overall", "m_grade"] + [
        c for c in cm.columns if c.startswith(("n_", "first_", "last_"))]


def _ranked(spark, sf_dir, carry: bool = False):
    """Ranked solutions; with ``carry`` every row also holds the company's
    facts, so KPI and narrative steps need no second pass over the panel."""
    from verdant.operators.solutions import rank_solutions
    panel, profiles, cm = _ctx(spark, sf_dir)
    ranked = rank_solutions(cm, carry=_fact_columns(cm) if carry else ())
    return panel, profiles, cm, ranked


@register("rank_solutions", O.RANK_SOLUTIONS)
def q_rank_solutions(spark, sf_dir):
    return _ranked(spark, sf_dir)[3]


@register("roi_timeline", O.ROI_TIMELINE)
def q_roi_timeline(spark, sf_dir):
    from verdant.operators.solutions import roi_timeline
    return roi_timeline(_ranked(spark, sf_dir)[3])


@register("kpi_projection", O.KPI_PROJECTION)
def q_kpi_projection(spark, sf_dir):
    from verdant.operators.kpi import kpi_projection
    return kpi_projection(_ranked(spark, sf_dir, carry=True)[3], IDENTITY_MAP)


@register("kpi_heatmap", O.KPI_HEATMAP)
def q_kpi_heatmap(spark, sf_dir):
    from verdant.operators.kpi import kpi_heatmap, kpi_projection
    return kpi_heatmap(kpi_projection(_ranked(spark, sf_dir, carry=True)[3], IDENTITY_MAP))


@register("kpi_real", O.KPI_REAL)
def q_kpi_real(spark, sf_dir):
    from verdant.operators.kpi import kpi_real
    return kpi_real(_ranked(spark, sf_dir, carry=True)[3], IDENTITY_MAP)


@register("risks", O.RISKS)
def q_risks(spark, sf_dir):
    from verdant.operators.narrative import risks_and_opportunities
    return risks_and_opportunities(_ctx(spark, sf_dir)[2])


@register("risk_severity", O.RISK_SEVERITY)
def q_risk_severity(spark, sf_dir):
    from verdant.operators.narrative import risk_severity, risks_and_opportunities
    return risk_severity(risks_and_opportunities(_ctx(spark, sf_dir)[2]))


@register("scenario_numbers", O.SCENARIO)
def q_scenario_numbers(spark, sf_dir):
    from verdant.operators.narrative import scenario_numbers
    return scenario_numbers(_ctx(spark, sf_dir)[2])


@register("executive_summary", O.EXECUTIVE_SUMMARY)
def q_executive_summary(spark, sf_dir):
    from verdant.operators.narrative import executive_summary
    return executive_summary(_ranked(spark, sf_dir, carry=True)[3])


# ----------------------------------------------------------------- text
@register("pii_scrub", O.PII_SCRUB)
def q_pii_scrub(spark, sf_dir):
    from verdant.functions.text import pii_scrub
    from verdant.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii_scrub("text").alias("scrubbed"))


def _profile_extract(spark, sf_dir):
    from verdant.functions.text import extract_profile
    from verdant.sources.tables import read_table
    return extract_profile(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


@register("profile_extract", O.PROFILE_EXTRACT)
def q_profile_extract(spark, sf_dir):
    return _profile_extract(spark, sf_dir)


@register("missing_fields", O.MISSING_FIELDS)
def q_missing_fields(spark, sf_dir):
    from verdant.operators.quality import profile_form_view
    return profile_form_view(_profile_extract(spark, sf_dir))


@register("latin1", O.LATIN1)
def q_latin1(spark, sf_dir):
    from verdant.functions.text import latin1
    from verdant.sources.tables import read_table
    return read_table(spark, sf_dir, "documents").select("doc_id", latin1("text").alias("text_latin1"))


@register("intent_route", O.INTENT_ROUTE)
def q_intent_route(spark, sf_dir):
    from pyspark.sql import functions as F

    from verdant.functions.text import intent
    from verdant.sources.tables import read_table
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return conv.select("conv_id", "turn", intent("text").alias("intent"))


@register("json_extract", O.JSON_EXTRACT)
def q_json_extract(spark, sf_dir):
    from pyspark.sql import functions as F

    from verdant.functions.jsonx import extract_json
    from verdant.sources.tables import read_table
    src = _union([
        read_table(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("id"),
                                                    F.col("props").alias("txt")),
        read_table(spark, sf_dir, "conversations").select(
            F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("text").alias("txt")),
        read_table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"),
                                                       F.col("doc_id").alias("id"), F.col("text").alias("txt")),
    ])
    return src.select("source", "id", extract_json("txt").alias("json_text"))


# ----------------------------------------------------------------- X8, P8, entry-1 profile flow
@register("data_summary", O.DATA_SUMMARY)
def q_data_summary(spark, sf_dir):
    from verdant.operators.profile import data_summary_text
    return data_summary_text(esg_panel(spark, sf_dir))


@register("profile_text", O.PROFILE_TEXT)
def q_profile_text(spark, sf_dir):
    from verdant.operators.profile import profile_text
    return profile_text(esg_panel(spark, sf_dir))


@register("data_profile", O.DATA_PROFILE)
def q_data_profile(spark, sf_dir):
    """Entry-1 flow: profile text per company -> field extraction -> missing
    fields -> form defaults -> size class."""
    from pyspark.sql import functions as F

    from verdant.functions import text as T
    from verdant.operators.profile import profile_text
    from verdant.operators.quality import fill_profile, missing_fields
    from verdant.operators.score import business_size
    pt = profile_text(esg_panel(spark, sf_dir))
    ex = T.extract_profile(pt, "profile_text", ["company"])
    filled = fill_profile(missing_fields(ex))
    return filled.select("company", F.array_join("missing_fields", ",").alias("missing_fields"),
                         "employee_count", "budget", "industry", "country",
                         business_size(F.col("employee_count")).alias("business_size"))


# ----------------------------------------------------------------- ad-hoc SQL
def _register_smoke():
    from verdant.plans.adhoc import SMOKE

    for _name, _sql in SMOKE.items():
        def _run(spark, sf_dir, _sql=_sql):
            from verdant.plans.adhoc import query_with_sql
            from verdant.sources.tables import read_table
            for t in ("supplier", "nation", "region"):
                read_table(spark, sf_dir, t).createOrReplaceTempView(t)
            return query_with_sql(esg_panel(spark, sf_dir), _sql)
        register(_name, O.adhoc_sql(_sql))(_run)


_register_smoke()


# ----------------------------------------------------------------- streaming (ST1)
@register("stream_route", O.STREAM_ROUTE)
def q_stream_route(spark, sf_dir):
    from verdant.streaming.chat import run_routing
    return spark.read.parquet(run_routing(spark, sf_dir))


# ----------------------------------------------------------------- delimited source
@register("csv_peer_comparison", O.CSV_PEER_COMPARISON)
def q_csv_peer_comparison(spark, sf_dir):
    """Panel written as delimited text, read back through the delimited
    source (header trim, long-row rule, inferred types), then ranked."""
    import os
    import uuid

    from verdant.operators.peers import peer_comparison
    from verdant.session import checkpoint_root
    from verdant.sources.delimited import read_delimited
    path = os.path.join(checkpoint_root(spark), "csv", uuid.uuid4().hex)
    esg_panel(spark, sf_dir).drop("_row_id").write.option("header", "true").csv(path)
    return peer_comparison(read_delimited(spark, path), IDENTITY_MAP)


@register("csv_dirty", O.CSV_DIRTY)
def q_csv_dirty(spark, sf_dir):
    """The customers as delimited text in several files, with padded
    headers, quoted line breaks, long, short and blank rows and missing-value tokens."""
    import os
    import uuid

    from pyspark.sql import functions as F

    from verdant.plans.composed import CSV_DIRTY_HEADER, CSV_DIRTY_LINE, CSV_FILES
    from verdant.session import checkpoint_root
    from verdant.sources.delimited import read_delimited
    from verdant.sources.tables import read_table
    path = os.path.join(checkpoint_root(spark), "csv", uuid.uuid4().hex)
    rows = read_table(spark, sf_dir, "customer").selectExpr(f"c_custkey % {CSV_FILES} AS file", "c_custkey AS at", f"{CSV_DIRTY_LINE} AS line")
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("at"), F.lit(CSV_DIRTY_HEADER).alias("line"))
    (rows.unionByName(heads).repartition("file").sortWithinPartitions("file", "at").select("file", "line")
     .write.partitionBy("file").text(path))
    return read_delimited(spark, path + "/*").select("id", "name", "segment", "balance")


# ----------------------------------------------------------------- exports and reports
@register("profile_sheet", O.PROFILE_SHEET)
def q_profile_sheet(spark, sf_dir):
    from verdant.sources.sinks import profile_sheet
    return profile_sheet(_ctx(spark, sf_dir)[2])


def _shared_ranked(spark, sf_dir):
    """The company context and the ranked solutions, dealt once for all that is derived from them."""
    from verdant.operators.solutions import rank_solutions
    from verdant.sources.sinks import shared
    cm = shared(_ctx(spark, sf_dir)[2])
    return cm, shared(rank_solutions(cm, carry=_fact_columns(cm)))


def _report(spark, sf_dir, mode):
    from verdant.operators import dims
    from verdant.operators.benchmark import benchmark_comparison, pillar_view, regulation
    from verdant.operators.kpi import kpi_projection
    from verdant.operators.narrative import executive_summary, risks_and_opportunities
    from verdant.operators.schema import detect_columns
    from verdant.sources.sinks import quality_section, report_datasets
    cm, ranked = _shared_ranked(spark, sf_dir)
    detected = detect_columns([c for c in PANEL_COLUMNS])
    return report_datasets(mode, cm, ranked.drop(*_fact_columns(cm)), regulation(cm), risks_and_opportunities(cm),
                           kpi_projection(ranked, IDENTITY_MAP), benchmark_comparison(cm, IDENTITY_MAP),
                           pillar_view(cm), dims.timeline(spark), executive_summary(ranked), quality_section(cm, detected))


def _workbook(spark, sf_dir):
    from verdant.operators.benchmark import benchmark_comparison
    from verdant.operators.kpi import kpi_projection
    from verdant.sources.sinks import workbook
    cm, ranked = _shared_ranked(spark, sf_dir)
    return workbook(cm, ranked, kpi_projection(ranked, IDENTITY_MAP), benchmark_comparison(cm, IDENTITY_MAP))


@register("kpi_sheet", O.KPI_SHEET)
def q_kpi_sheet(spark, sf_dir):
    return _workbook(spark, sf_dir)["KPI Projections"]


@register("benchmark_sheet", O.BENCHMARK_SHEET)
def q_benchmark_sheet(spark, sf_dir):
    return _workbook(spark, sf_dir)["Benchmarks"]


@register("workbook", O.WORKBOOK)
def q_workbook(spark, sf_dir):
    """The four sheets written as one bundle and read back: rows and a total of each company's sheets."""
    import os
    import uuid

    from pyspark.sql import functions as F

    from verdant.session import checkpoint_root
    from verdant.sources.sinks import read_sheet, write_bundle
    path = os.path.join(checkpoint_root(spark), "workbook", uuid.uuid4().hex)
    write_bundle(_workbook(spark, sf_dir), path)
    figure = {"Profile & Maturity": "length(value)", "Solutions": "`Fit Score`", "KPI Projections": "Projected", "Benchmarks": "Gap"}
    return _union([read_sheet(spark, path, name).groupBy("company").agg(
        F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.expr(f"CAST({c} AS DOUBLE)")), 4).alias("total"))
        for name, c in figure.items()])


@register("report_narrative", O.EXECUTIVE_SUMMARY)
def q_report_narrative(spark, sf_dir):
    """The overview of the executive report."""
    return _report(spark, sf_dir, "executive")["narrative"]


@register("risk_replies", O.risk_replies())
def q_risk_replies(spark, sf_dir):
    """Good, half, broken and missing risk replies for each company, templates where they don't do."""
    from verdant.operators.narrative import risks_and_opportunities, validate_risks
    from verdant.plans.composed import RISK_REPLY
    from verdant.sources.tables import read_table
    replies = read_table(spark, sf_dir, "supplier").selectExpr("s_name AS company", f"{RISK_REPLY} AS reply")
    return validate_risks(replies, risks_and_opportunities(_ctx(spark, sf_dir)[2]), "reply").drop("reply")


@register("report_top_actions", O.REPORT_TOP_ACTIONS)
def q_report_top_actions(spark, sf_dir):
    return _report(spark, sf_dir, "executive")["top_actions"]


@register("report_frameworks", O.REPORT_FRAMEWORKS)
def q_report_frameworks(spark, sf_dir):
    return _report(spark, sf_dir, "executive")["frameworks"]


# ----------------------------------------------------------------- more profiling
@register("key_metrics", O.KEY_METRICS)
def q_key_metrics(spark, sf_dir):
    """A5 per company: stats of every numeric column."""
    from verdant.operators.profile import column_stats
    panel = esg_panel(spark, sf_dir)
    return column_stats(panel, _panel_numeric(panel), group_cols=["company"])


@register("trend_series", O.TREND_SERIES)
def q_trend_series(spark, sf_dir):
    from verdant.operators.trends import trend_series
    return trend_series(esg_panel(spark, sf_dir), IDENTITY_MAP)


@register("dq_few_rows", O.DQ_FEW_ROWS)
def q_dq_few_rows(spark, sf_dir):
    from verdant.operators.quality import few_rows
    return _union([few_rows(_dataset(spark, sf_dir, t), t) for t in QUALITY_TABLES])


# ----------------------------------------------------------------- S3, P2, P6/S7, X13
@register("preview_rows", O.PREVIEW_ROWS)
def q_preview_rows(spark, sf_dir):
    """S3: first ten rows in row order (the limit is the feature)."""
    from verdant.sources.delimited import preview
    return preview(esg_panel(spark, sf_dir), 10).drop("_row_id")


@register("table_score", O.TABLE_SCORE)
def q_table_score(spark, sf_dir):
    """Whole-table mode (no company column): one score for the table."""
    from verdant.operators.peers import scored_latest
    no_company = {k: v for k, v in IDENTITY_MAP.items() if k != "company"}
    s = scored_latest(esg_panel(spark, sf_dir).drop("company"), no_company)
    return s.select(s["_company"].alias("company"), "year", "environmental", "social", "governance",
                    "esg_score", "grade")


@register("kpi_top_solution", O.KPI_TOP_SOLUTION)
def q_kpi_top_solution(spark, sf_dir):
    """KPI rows of each company's top-ranked solution."""
    return _report(spark, sf_dir, "detailed")["kpis"].drop("rank")


@register("prompt_context", O.PROMPT_CONTEXT)
def q_prompt_context(spark, sf_dir):
    """The data summary capped for each prompt kind."""
    from verdant.functions.narrative_caps import capped
    from verdant.operators.profile import data_summary_text
    return capped(data_summary_text(esg_panel(spark, sf_dir)), caps=fixed.PROMPT_CAPS)


@register("whatif_context", O.WHATIF_CONTEXT)
def q_whatif_context(spark, sf_dir):
    """Profile keep-list, compact solutions and regulation as JSON."""
    from verdant.operators.narrative import whatif_context
    return whatif_context(_ranked(spark, sf_dir, carry=True)[3])


@register("table_summary", O.TABLE_SUMMARY)
def q_table_summary(spark, sf_dir):
    """X8 / W5 for the whole table: summary with the first five companies seen."""
    from verdant.operators.profile import table_summary_text
    return table_summary_text(esg_panel(spark, sf_dir))


@register("whatif_answers", O.WHATIF_ANSWERS)
def q_whatif_answers(spark, sf_dir):
    """X11: the answer text of every intent for every company."""
    from verdant.operators.narrative import whatif_answers
    return whatif_answers(_ctx(spark, sf_dir)[2])


@register("prompts", O.PROMPTS)
def q_prompts(spark, sf_dir):
    """The user prompts of every company, data summary attached."""
    from verdant.operators.companies import company_maturity
    from verdant.operators.narrative import prompt_table
    from verdant.operators.profile import data_summary_text
    from verdant.operators.solutions import rank_solutions
    from verdant.sources.tables import company_profiles
    panel = esg_panel(spark, sf_dir)
    cm = company_maturity(company_profiles(spark, sf_dir), panel, IDENTITY_MAP, data_summary_text(panel))
    carry = ["country", "employee_count", "text_summary", *[c for c in cm.columns if c.startswith("m_")]]
    return prompt_table(rank_solutions(cm, carry=carry), caps=fixed.PROMPT_CAPS)


@register("peer_table", O.PEER_TABLE)
def q_peer_table(spark, sf_dir):
    """The peer table under its display names, one company marked."""
    from verdant.operators.peers import for_display, peer_comparison
    return for_display(peer_comparison(esg_panel(spark, sf_dir), IDENTITY_MAP), O.MARKED_COMPANY)


@register("solutions_sheet", O.SOLUTIONS_SHEET)
def q_solutions_sheet(spark, sf_dir):
    from verdant.sources.sinks import solutions_sheet
    return solutions_sheet(_ranked(spark, sf_dir)[3])


@register("report_regulation", O.REPORT_REGULATION)
def q_report_regulation(spark, sf_dir):
    """Key deadline, regulator and penalties of each company's report."""
    return _report(spark, sf_dir, "executive")["regulation"]


@register("report_quality", O.REPORT_QUALITY)
def q_report_quality(spark, sf_dir):
    """The data-quality paragraph of the detailed report."""
    return _report(spark, sf_dir, "detailed")["quality"]


@register("report_defaults", O.REPORT_DEFAULTS)
def q_report_defaults(spark, sf_dir):
    """Companies of a third of the head counts come without maturity; the
    report fills in its defaults."""
    from pyspark.sql import functions as F

    from verdant.sources.sinks import with_report_defaults
    cm = _ctx(spark, sf_dir)[2]
    scores = ("m_overall", "m_environmental", "m_social", "m_governance", "m_grade")
    there = F.col("employee_count") % 3 != 0
    return with_report_defaults(cm.select("company", *[F.when(there, F.col(c)).alias(c) for c in scores]))[0]


@register("report_no_regulation", O.REPORT_NO_REGULATION)
def q_report_no_regulation(spark, sf_dir):
    """Companies of a third of the head counts come without a regulation."""
    from pyspark.sql import functions as F

    from verdant.operators.benchmark import regulation
    from verdant.sources.sinks import with_report_defaults
    cm = _ctx(spark, sf_dir)[2]
    reg = regulation(cm, keep=("employee_count",))
    there = F.col("employee_count") % 3 != 1
    return with_report_defaults(cm, reg.select("company", *[
        F.when(there, F.col(c)).alias(c) for c in ("frameworks", "key_deadlines", "penalties", "regulator")]))[1]


@register("detected_values", O.DETECTED_VALUES)
def q_detected_values(spark, sf_dir):
    """V1: the detected metric columns of every table, with the values they hold."""
    from verdant.operators.schema import detected_values
    from verdant.sources.tables import TABLES, read_table
    tables = {t: read_table(spark, sf_dir, t) for t in TABLES}
    tables["panel"] = esg_panel(spark, sf_dir)
    return _union([detected_values(df, t) for t, df in tables.items()])


from verdant.plans import composed  # noqa: E402

for _name, (_fn, _sql) in composed.ALL.items():
    register(_name, _sql)(_fn)
