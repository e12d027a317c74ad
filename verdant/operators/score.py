"""Scores: data-driven ESG score (B1), profile maturity (B2), size class (B3),
compliance readiness (B9), pillar status (B10), radar reference (B11).

All formulas are column expressions evaluated per row, so scoring every
company is one projection over the latest-row table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from verdant import fixed
from verdant.fixed import MSG_SCORE_RATIONALE
from verdant.functions.names import named, quoted
from verdant.functions.numeric import NUMERIC_TEXT, py_round, py_round_sql, to_num


GRADE_SQL = "CASE " + " ".join(f"WHEN {{0}} >= {bound} THEN '{g}'" for bound, g in fixed.GRADES[:-1]) + f" ELSE '{fixed.GRADES[-1][1]}' END"


def metric_value(df: DataFrame, col_map: dict, metric: str) -> Column | None:
    """The metric's value as DOUBLE (text coerced, NaN as null), or None when
    the metric has no column."""
    name = col_map.get(metric)
    if name is None or name not in df.columns:
        return None
    dtype = df.schema[name].dataType
    if isinstance(dtype, NumericType):
        return F.nanvl(named(name).cast("double"), F.lit(None).cast("double"))
    return to_num(named(name))


def number_sql(types: dict, name: str, prefix: str = "") -> str:
    """A column coerced to DOUBLE as SQL text: numeric types cast (NaN as
    null), text through the strict number pattern (never an ANSI cast error)."""
    c = prefix + quoted(name)
    if isinstance(types[name], NumericType):
        return f"nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE))"
    txt = f"trim(CAST({c} AS STRING))"
    return f"(CASE WHEN lower({txt}) RLIKE {sql_literal(NUMERIC_TEXT)} THEN try_cast({txt} AS DOUBLE) END)"


def metric_sql(types: dict, col_map: dict, metric: str, prefix: str = "") -> str | None:
    """``metric_value`` as SQL text (one JVM call to build, however long).
    ``prefix``: a struct column holding the fields (e.g. ``latest.``)."""
    name = col_map.get(metric)
    if name is None or name not in types:
        return None
    return number_sql(types, name, prefix)


def sql_literal(text: str) -> str:
    """A Spark SQL string literal for ``text`` (backslashes and quotes escaped,
    since the SQL parser unescapes them)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _clamp_sql(x: str, lo=None, hi=None) -> str:
    out = x
    if hi is not None:
        out = f"least({out}, {float(hi)}D)"
    if lo is not None:
        out = f"greatest({out}, {float(lo)}D)"
    return out


def score_terms_sql(types: dict, col_map: dict) -> dict[str, list[str]]:
    """The per-pillar score terms as SQL; a term is null when its input is
    missing (each term is guarded, since least/greatest skip nulls)."""
    v = {m: metric_sql(types, col_map, m) for m in (
        "renewable_energy", "carbon_emissions", "employees", "waste_recycled",
        "gender_diversity", "employee_turnover", "training", "safety",
        "board_independence", "esg_budget", "revenue", "community_investment")}

    def guard(cond, expr):
        return f"(CASE WHEN {cond} THEN {expr} END)"

    e, s, g = [], [], []
    if v["renewable_energy"]:
        x = v["renewable_energy"]
        e.append(guard(f"{x} IS NOT NULL", _clamp_sql(x, None, 100)))
    if v["carbon_emissions"] and v["employees"]:
        em, emp = v["carbon_emissions"], v["employees"]
        e.append(guard(f"{em} IS NOT NULL AND {emp} IS NOT NULL AND {emp} > 0",
                       _clamp_sql(f"90D - ({em} / {emp} - 1D) * 7.8D", 20, 90)))
    if v["waste_recycled"]:
        x = v["waste_recycled"]
        e.append(guard(f"{x} IS NOT NULL", _clamp_sql(x, None, 100)))
    if v["gender_diversity"]:
        x = v["gender_diversity"]
        s.append(guard(f"{x} IS NOT NULL", _clamp_sql(f"{x} * 2D", None, 100)))
    if v["employee_turnover"]:
        x = v["employee_turnover"]
        s.append(guard(f"{x} IS NOT NULL", _clamp_sql(f"90D - ({x} - 5D) * 2.8D", 20, 90)))
    if v["training"]:
        x = v["training"]
        s.append(guard(f"{x} IS NOT NULL", _clamp_sql(f"20D + {x} * 1.75D", 20, 90)))
    if v["safety"]:
        x = v["safety"]
        s.append(guard(f"{x} IS NOT NULL", _clamp_sql(f"95D - {x} * 3.75D", 20, 95)))
    if v["board_independence"]:
        x = v["board_independence"]
        g.append(guard(f"{x} IS NOT NULL", _clamp_sql(x, None, 100)))
    if v["esg_budget"] and v["revenue"]:
        b, r = v["esg_budget"], v["revenue"]
        g.append(guard(f"{b} IS NOT NULL AND {r} IS NOT NULL AND {r} > 0",
                       _clamp_sql(f"30D + ({b} / {r}) * 100D * 60D", 30, 90)))
    if v["community_investment"]:
        x = v["community_investment"]
        g.append(guard(f"{x} IS NOT NULL AND {x} > 0", _clamp_sql(f"40D + log10({x}) * 10D", None, 90)))
    return {"e": e, "s": s, "g": g}


def esg_score(latest: DataFrame, col_map: dict) -> DataFrame:
    """B1 on each row of ``latest`` (one row per company): pillar means of the
    present terms (50 when none), clamped to [10, 95], weighted overall and
    grade, plus the rationale.

    Terms are materialised as columns first, so the pillar formulas refer to
    them by name (small expression trees, one projection per stage)."""
    types = {f.name: f.dataType for f in latest.schema.fields}
    t = score_terms_sql(types, col_map)
    names = {p: [f"_t_{p}{i}" for i in range(len(cols))] for p, cols in t.items()}
    staged = latest.select("*", *[F.expr(c).alias(n) for p in t for c, n in zip(t[p], names[p])])

    def pillar(p):
        if not t[p]:
            return "50D"
        total = " + ".join(["0D"] + [f"coalesce({n}, 0D)" for n in names[p]])
        cnt = " + ".join(f"(CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END)" for n in names[p])
        mean = f"CASE WHEN ({cnt}) > 0 THEN {py_round_sql(f'({total}) / ({cnt})', 1)} ELSE 50D END"
        return f"greatest(least({mean}, 95D), 10D)"

    def count(p):
        if not t[p]:
            return "0"
        return " + ".join(f"(CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END)" for n in names[p])

    out = staged.selectExpr("*", f"{pillar('e')} AS environmental", f"{pillar('s')} AS social",
                            f"{pillar('g')} AS governance", f"{count('e')} AS n_e", f"{count('s')} AS n_s",
                            f"{count('g')} AS n_g")
    out = out.selectExpr("*", py_round_sql("environmental * 0.4D + social * 0.3D + governance * 0.3D", 1)
                         + " AS esg_score")
    out = out.selectExpr(
        "*", GRADE_SQL.format("esg_score") + " AS grade",
        f"format_string({sql_literal(MSG_SCORE_RATIONALE)}, n_e, n_s, n_g) AS rationale")
    return out.drop(*[n for p in names for n in names[p]])


# ---------------------------------------------------------------- B3
def business_size(employees: Column) -> Column:
    emp = F.coalesce(employees, F.lit(0))
    return F.when(emp >= 250, "Large").when(emp >= 50, "Medium").otherwise("Small")


# ---------------------------------------------------------------- B2
def maturity(profiles: DataFrame, modifiers: DataFrame, completeness: str | None = None) -> DataFrame:
    """B2 per profile row. ``modifiers`` is the industry modifier dimension
    (lower-case industry, e, s, g), joined case-insensitively (broadcast: a
    fixed 19-row table). ``completeness`` is the column of the data completeness
    percentage (null = no data summary)."""
    mods = F.broadcast(modifiers.selectExpr("industry_key AS _mod_key", "e AS _me", "s AS _ms", "g AS _mg"))
    staged = profiles.selectExpr(
        "*", "lower(coalesce(industry, 'unknown')) AS _ind_key", "coalesce(CAST(budget AS DOUBLE), 0D) AS _budget",
        "coalesce(CAST(employee_count AS DOUBLE), 0D) AS _emp")
    j = staged.join(mods, staged["_ind_key"] == mods["_mod_key"], "left")
    per_emp = "_budget / greatest(_emp, 1D)"
    base = {"_env": _ladder(per_emp, fixed.MATURITY_BUDGET_STEPS) + " + coalesce(_me, 0)",
            "_soc": _ladder("_emp", fixed.MATURITY_STAFF_STEPS) + " + coalesce(_ms, 0)",
            "_gov": _ladder("_budget", fixed.MATURITY_TOTAL_STEPS) + " + coalesce(_mg, 0)"}
    j = j.selectExpr("*", *[f"greatest(least({x}, 95), 10) AS {n}" for n, x in base.items()])
    gov = "_gov"
    if completeness is not None:
        gov = (f"CASE WHEN {completeness} > 90 THEN least(_gov + 8, 95) WHEN {completeness} < 50 "
               "THEN greatest(_gov - 10, 10) ELSE _gov END")
    j = j.selectExpr(*[quoted(c) for c in profiles.columns], "CAST(_env AS DOUBLE) AS m_environmental",
                     "CAST(_soc AS DOUBLE) AS m_social", f"CAST({gov} AS DOUBLE) AS m_governance")
    j = j.selectExpr("*", py_round_sql("m_environmental * 0.4D + m_social * 0.3D + m_governance * 0.3D", 1) + " AS m_overall")
    return j.selectExpr("*", GRADE_SQL.format("m_overall") + " AS m_grade")


def _ladder(x: str, steps: list) -> str:
    """The value of the first step that ``x`` is above; the last step has no bound."""
    *upper, (_, low) = steps
    return "(CASE " + " ".join(f"WHEN {x} > {float(bound)}D THEN {value}" for bound, value in upper) + f" ELSE {low} END)"


# ---------------------------------------------------------------- B9, B10, B11
def readiness(governance: Column) -> tuple[Column, Column]:
    score = F.least(F.lit(100.0), governance * F.lit(1.2))
    label = F.when(score >= 70, "High").when(score >= 45, "Medium").otherwise("Low")
    return score, label


def pillar_status(score: Column, style: str = "report") -> Column:
    """``report``: Strong/Moderate/Weak; ``detailed``: Strong/Moderate/Needs
    Improvement; ``dashboard``: Strong/Needs Work."""
    if style == "dashboard":
        return F.when(score >= 65, "Strong").otherwise("Needs Work")
    low = "Needs Improvement" if style == "detailed" else "Weak"
    return F.when(score >= 65, "Strong").when(score >= 45, "Moderate").otherwise(low)


def radar_reference(esg_score_avg: Column) -> list[tuple[str, Column]]:
    return [("Environmental", esg_score_avg * F.lit(0.95)), ("Social", esg_score_avg * F.lit(1.0)),
            ("Governance", esg_score_avg * F.lit(1.05))]


__all__ = ["esg_score", "maturity", "business_size", "readiness", "pillar_status",
           "radar_reference", "metric_value", "metric_sql", "score_terms_sql", "py_round"]
