"""Template text per company: risks and opportunities (J6, A8), executive
narrative (X9), what-if scenario figures (X11), prompt context (X13) and
validation of model-returned rankings (X14).

All of it is column expressions over per-company rows plus broadcast joins
to fixed template tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import fixed
from verdant.functions.jsonx import extract_json
from verdant.functions.names import named
from verdant.functions.narrative_caps import cap
from verdant.functions.numeric import py_float_str
from verdant.operators import dims
from verdant.operators.companies import money0

RISK_INDUSTRIES = sorted({t[1] for t in fixed.RISK_OPP_TEMPLATES if t[0] == "risk" and t[1]})
OPP_INDUSTRIES = sorted({t[1] for t in fixed.RISK_OPP_TEMPLATES if t[0] == "opportunity" and t[1]})


def risks_and_opportunities(cm: DataFrame) -> DataFrame:
    """J6 per company: the industry's templates (default set otherwise) with
    country, size, deadlines and frameworks filled in."""
    spark = cm.sparkSession
    reg = dims.with_regulation(cm.select("company", "industry", "country", "business_size"), "country", spark)
    kinds = F.array(
        F.struct(F.lit("risk").alias("kind"),
                 F.when(F.col("industry").isin(RISK_INDUSTRIES), F.col("industry")).alias("tpl_industry")),
        F.struct(F.lit("opportunity").alias("kind"),
                 F.when(F.col("industry").isin(OPP_INDUSTRIES), F.col("industry")).alias("tpl_industry")))
    per_kind = reg.select("*", F.inline(kinds))
    tpl = F.broadcast(dims.risk_templates(spark).withColumnRenamed("kind", "t_kind")
                      .withColumnRenamed("industry", "t_industry"))
    j = per_kind.join(tpl, (per_kind["kind"] == tpl["t_kind"])
                      & per_kind["tpl_industry"].eqNullSafe(tpl["t_industry"]))
    fw = F.col("frameworks")
    first_two = F.when(F.size(fw) > 0, F.array_join(F.slice(fw, 1, 2), ", ")).otherwise(F.col("fw_fallback"))
    slot = F.when(F.col("fw_slot") == 0, first_two).otherwise(
        F.coalesce(F.try_element_at(fw, F.col("fw_slot")), F.col("fw_fallback")))
    text = F.col("description")
    text = F.replace(text, F.lit("{fw}"), F.coalesce(slot, F.lit("")))
    text = F.replace(text, F.lit("{dl}"), F.col("key_deadlines"))
    text = F.replace(text, F.lit("{country}"), F.coalesce(F.col("country"), F.lit("")))
    text = F.replace(text, F.lit("{size}"), F.lower(F.coalesce(F.col("business_size"), F.lit(""))))
    text = F.replace(text, F.lit("{industry}"), F.lower(F.coalesce(F.col("industry"), F.lit(""))))
    return j.select("company", "kind", F.col("ord").cast("bigint").alias("ord"), "title",
                    text.alias("description"), F.col("level"))


def risk_severity(ro: DataFrame) -> DataFrame:
    """Risk count per company and severity."""
    return (ro.where(F.col("kind") == "risk").groupBy("company", F.col("level").alias("severity"))
            .agg(F.count(F.lit(1)).alias("count")))


def executive_summary(ranked: DataFrame) -> DataFrame:
    """X9 per company, template form (no model call): grade, tier, top three
    actions, two frameworks and 60 % of the budget. ``ranked`` carries the
    company's maturity, industry, country and budget on each solution row."""
    spark = ranked.sparkSession
    line = F.format_string(
        "(%d) %s – estimated $%s investment, $%s/yr savings, %.1f-year payback.",
        F.col("rank"), F.col("name"), money0(F.col("avg_cost")), money0(F.col("annual_savings")),
        F.col("payback_years"))
    per = ranked.groupBy("company").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("rank") <= 3, F.struct(F.col("rank"), line.alias("_line"))))),
            lambda x: x["_line"]), "\n").alias("_actions"),
        *[F.first(c).alias(c) for c in ("m_grade", "m_overall", "industry", "budget", "country")])
    j = dims.with_regulation(per, "country", spark)
    tier = F.when(F.col("m_overall") >= 60, "upper").otherwise("lower")
    budget = F.coalesce(F.col("budget").cast("double"), F.lit(0.0))
    text = F.concat(
        F.lit("Your organisation currently holds an ESG maturity grade of "), F.col("m_grade"), F.lit(" ("),
        F.col("m_overall").cast("string"), F.lit("/100), positioning it in the "), tier, F.lit(" tier of "),
        F.lower(F.col("industry")), F.lit(" sector peers.\n\nThree priority actions are recommended:\n"),
        F.coalesce(F.col("_actions"), F.lit("")), F.lit("\n"),
        F.lit("\nRegulatory exposure: "), F.array_join(F.slice(F.col("frameworks"), 1, 2), ", "),
        F.lit(" create compliance obligations. "), F.col("key_deadlines"),
        F.lit("\n\nRecommendation: Allocate $"), money0(budget * F.lit(0.6)),
        F.lit(" to the top-ranked solution immediately, phasing remaining initiatives over 18-24 months "
              "to stay ahead of "), F.col("country"), F.lit(" disclosure deadlines."))
    return j.select("company", text.alias("executive_summary"))


def scenario_numbers(cm: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """X11 per company: the figures each what-if answer quotes, and the
    columns of ``keep``."""
    budget = F.coalesce(F.col("budget").cast("double"), F.lit(0.0))
    emp = F.coalesce(F.col("employee_count").cast("bigint"), F.lit(0).cast("bigint"))
    emp_or_10 = F.when(emp == 0, F.lit(10).cast("bigint")).otherwise(emp)
    large = F.when(F.col("business_size") == "Large", F.lit(2.5)).otherwise(F.lit(1.0))
    return cm.select(
        "company", *keep, "business_size", budget.alias("budget"), emp.alias("employee_count"),
        (budget * F.lit(1.2)).alias("budget_optimistic"), (budget * F.lit(0.8)).alias("budget_pessimistic"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(emp_or_10 / F.lit(50)).cast("bigint")).alias("esg_fte"),
        (emp * F.lit(200)).cast("bigint").alias("attrition_savings"),
        (F.lit(8000.0) * large).alias("compliance_cost_low"), (F.lit(30000.0) * large).alias("compliance_cost_high"),
        (emp * F.lit(50)).cast("bigint").alias("carbon_credit_low"),
        (emp * F.lit(150)).cast("bigint").alias("carbon_credit_high"))


def _filled(template: str, slots: dict[str, F.Column]) -> F.Column:
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[slots[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)])


def whatif_answers(cm: DataFrame) -> DataFrame:
    """X11 per company and intent: the answer text, filled with the company's
    figures and the regulation of its country. Missing numbers count as 0,
    missing names take the fixed stand-ins."""
    d = fixed.WHATIF_DEFAULTS
    reg = dims.with_regulation(scenario_numbers(cm, ("industry", "country")), "country", cm.sparkSession)
    fw = F.col("frameworks")
    first = F.try_element_at(fw, F.lit(1))
    whole = {c: money0(F.col(c).cast("double")) for c in (
        "budget", "budget_optimistic", "budget_pessimistic", "attrition_savings", "compliance_cost_low",
        "compliance_cost_high", "carbon_credit_low", "carbon_credit_high")}
    slots = {
        "size": F.coalesce("business_size", F.lit(d["size"])), "industry": F.coalesce("industry", F.lit(d["industry"])),
        "employees": F.format_string("%,d", "employee_count"), "budget": whole["budget"],
        "budget_up": whole["budget_optimistic"], "budget_down": whole["budget_pessimistic"],
        "first_framework": F.coalesce(first, F.lit(d["first_framework"])),
        "first_standard": F.coalesce(first, F.lit(d["first_standard"])),
        "two_frameworks": F.array_join(F.slice(fw, 1, 2), ", "), "deadlines": F.col("key_deadlines"),
        "penalties": F.col("penalties"), "fte": F.col("esg_fte").cast("string"), "attrition": whole["attrition_savings"],
        "cost_low": whole["compliance_cost_low"], "cost_high": whole["compliance_cost_high"],
        "credit_low": whole["carbon_credit_low"], "credit_high": whole["carbon_credit_high"]}
    rows = F.array(*[F.struct(F.lit(k).alias("intent"), _filled(t, slots).alias("answer"))
                     for k, t in fixed.WHATIF_ANSWERS.items()])
    return reg.select("company", F.inline(rows))


def prompt_table(ranked: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """X13 per company: the user prompts for the narrative, for risks and
    opportunities, and for the ranking of solutions. ``ranked`` carries the
    company's profile, maturity and ``text_summary`` on each solution row; the
    summary is whole, or cut at the limits ``caps`` (code points by kind of prompt)."""
    spark = ranked.sparkSession
    per = ranked.groupBy("company").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "name")))),
                    lambda x: x["name"]).alias("_top"),
        *[F.first(c).alias(c) for c in ("industry", "country", "business_size", "employee_count", "budget", "m_overall",
                                        "m_grade", "m_environmental", "m_social", "m_governance", "text_summary")])
    j = dims.with_regulation(per, "country", spark)
    budget = money0(F.coalesce(F.col("budget").cast("double"), F.lit(0.0)))
    text = {c: F.coalesce(F.col(c), F.lit("N/A")) for c in ("industry", "country", "business_size")}
    score = {c: py_float_str(F.col(f"m_{c}")) for c in ("overall", "environmental", "social", "governance")}

    def data(lead, purpose):
        has = F.length(F.coalesce("text_summary", F.lit(""))) > 0
        return F.when(has, F.concat(F.lit(lead), cap(F.col("text_summary"), caps, purpose), F.lit("\n"))
                      ).otherwise(F.lit(""))

    slots = {**text, **score, "grade": F.col("m_grade"), "budget": budget,
             "employees": F.format_string("%,d", F.coalesce(F.col("employee_count"), F.lit(0)).cast("bigint")),
             "solutions": F.array_join("_top", ", "), "frameworks": F.array_join("frameworks", ", "),
             "three_frameworks": F.array_join(F.slice("frameworks", 1, 3), ", "), "deadlines": F.col("key_deadlines"),
             "regulator": F.col("regulator"),
             "insights": data("\nData insights: ", "narrative"),
             "risk_data": data("\nData characteristics:\n", "risks"),
             "solution_data": data("\nData characteristics:\n", "solutions")}
    return j.select("company", *[_filled(t, slots).alias(f"{k}_prompt") for k, t in fixed.PROMPTS.items()])


def validate_ranking(replies: DataFrame, json_col: str = "reply_json",
                     templates: DataFrame | None = None) -> DataFrame:
    """The JSON found in a reply (fences and prose around it allowed) is
    used as a ranking if it is a list of at least three entries; entries are
    ordered by fit_score (missing = 0, stable) and numbered, all within the
    row: no shuffle, and equal replies stay apart. ``entry`` holds every field
    of the entry as JSON. Other replies give the rows of ``templates`` (name,
    category, fit_score; a small fixed table) with ``from_template`` true, or
    no row without templates."""
    found = replies.withColumn("_json", extract_json(named(json_col)))
    schema = "array<struct<name:string,category:string,fit_score:double>>"
    parsed = found.withColumn("_arr", F.from_json("_json", schema)).withColumn("_raw", F.from_json("_json", "array<variant>"))
    ok = F.coalesce(F.size("_arr") >= 3, F.lit(False))
    entry = F.transform("_arr", lambda e, i: F.struct(
        (-F.coalesce(e["fit_score"], F.lit(0.0))).alias("o"), i.alias("i"), e["name"].alias("name"),
        e["category"].alias("category"), F.to_json(F.get("_raw", i)).alias("entry"), F.lit(False).alias("from_template")))
    fixed_rows = [] if templates is None else templates.collect()
    each = [F.struct(F.lit(-float(r["fit_score"])).alias("o"), F.lit(i).alias("i"), F.lit(r["name"]).alias("name"),
                     F.lit(r["category"]).alias("category"),
                     F.to_json(F.struct(F.lit(r["name"]).alias("name"), F.lit(r["category"]).alias("category"),
                                        F.lit(float(r["fit_score"])).alias("fit_score"))).alias("entry"),
                     F.lit(True).alias("from_template")) for i, r in enumerate(fixed_rows)]
    rows = F.when(ok, F.array_sort(entry))
    if each:
        rows = rows.otherwise(F.array(*each))
    keep = [named(c) for c in replies.columns]
    return (parsed.select(*keep, F.posexplode(rows).alias("_pos", "_e"))
            .select(*keep, (F.col("_pos") + 1).cast("bigint").alias("rank"), F.col("_e.name").alias("name"),
                    F.col("_e.category").alias("category"), (-F.col("_e.o")).alias("fit_score"),
                    F.col("_e.entry").alias("entry"), F.col("_e.from_template").alias("from_template")))


def validate_risks(replies: DataFrame, templates: DataFrame, json_col: str = "reply_json") -> DataFrame:
    """Risks and opportunities from model replies (a row with a
    ``company`` each) as rows (kind, ord, title, description, level,
    from_template) behind the reply's own columns.

    The JSON found in a reply is used if it is an object with both keys,
    ``risks`` and ``opportunities``, and both are lists. Their entries are
    cleaned one by one: what is no object with a title is dropped, a missing
    description is empty, the level is ``severity`` or ``impact`` (null if
    missing); places count what stays. Any other reply, null too, gives the
    company's rows of ``templates`` (``risks_and_opportunities``, a handful for a
    company) with ``from_template`` true, and no row for a company without any."""
    value = replies.withColumn("_v", F.try_parse_json(extract_json(named(json_col))))

    def entries(key: str, kind: str, level: str) -> F.Column:
        field = lambda e, f: F.try_variant_get(e, f"$.{f}", "string")
        whole = F.try_variant_get("_v", f"$.{key}", "array<variant>")
        rows = F.transform(F.filter(whole, lambda e: field(e, "title").isNotNull()), lambda e, i: F.struct(
            F.lit(kind).alias("kind"), (i + 1).cast("bigint").alias("ord"), field(e, "title").alias("title"),
            F.coalesce(field(e, "description"), F.lit("")).alias("description"), field(e, level).alias("level"),
            F.lit(False).alias("from_template")))
        return rows

    given = value.withColumn("_given", F.concat(entries("risks", "risk", "severity"),
                                                entries("opportunities", "opportunity", "impact"))).drop("_v")
    own = templates.groupBy(F.col("company").alias("_of")).agg(F.array_sort(F.collect_list(F.struct(
        "kind", "ord", "title", "description", "level", F.lit(True).alias("from_template")))).alias("_own"))
    rows = given.join(own, F.col("company") == F.col("_of"), "left")
    return rows.select(*[named(c) for c in replies.columns], F.inline(F.coalesce("_given", "_own")))


def whatif_context(ranked: DataFrame) -> DataFrame:
    """X12 per company: the compact context of a what-if prompt: the profile
    keep-list (employee_count, budget, industry, country, business_size), the
    solutions with cost strings (``$aK–$bK``, ``$cK/yr``) in rank order, and
    three frameworks with deadlines and penalties. ``ranked`` carries the
    company's profile fields on each solution row (six rows per company)."""
    from verdant.operators.solutions import thousands
    spark = ranked.sparkSession
    sol = F.struct(
        F.col("name").alias("name"), F.col("category").alias("category"),
        F.concat(F.lit("$"), thousands(F.col("upfront_cost_low")), F.lit("K–$"),
                 thousands(F.col("upfront_cost_high")), F.lit("K")).alias("cost_range"),
        F.concat(F.lit("$"), thousands(F.col("annual_savings")), F.lit("K/yr")).alias("annual_savings"),
        F.col("payback_years").alias("payback_years"))
    per = ranked.groupBy("company").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), sol.alias("s")))),
                    lambda x: x["s"]).alias("_sols"),
        *[F.first(c).alias(c) for c in ("employee_count", "budget", "industry", "country", "business_size")])
    j = dims.with_regulation(per, "country", spark)
    return j.select(
        "company",
        F.to_json(F.struct("employee_count", "budget", "industry", "country", "business_size")).alias("profile_json"),
        F.to_json(F.col("_sols")).alias("solutions_json"),
        F.to_json(F.struct(F.slice("frameworks", 1, 3).alias("frameworks"), "key_deadlines", "penalties"))
         .alias("regulatory_json"))
