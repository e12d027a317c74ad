"""DuckDB SQL that states each registered query independently of the Spark
plan. Used by the driver's correctness gate and by ``tests/test_oracle.py``.

The SQL is written against the raw driver tables (``lineitem``, ``supplier``,
...). Shared building blocks are CTE strings composed below.
"""

from __future__ import annotations

from verdant import fixed


def R(expr: str, k: int = 1) -> str:
    """Half-even rounding on the decimal value, as DOUBLE (same rule as py_round)."""
    return f"CAST(round_even(CAST(({expr}) AS DECIMAL(38,8)), {k}) AS DOUBLE)"


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


INDUSTRY_CASE = ("CASE MOD(s.s_suppkey, 6) WHEN 0 THEN 'Technology' WHEN 1 THEN 'Finance' "
                 "WHEN 2 THEN 'Manufacturing' WHEN 3 THEN 'Energy' WHEN 4 THEN 'Financial Services' "
                 "ELSE 'Automotive' END")
COUNTRY_CASE = ("CASE MOD(s.s_nationkey, 5) WHEN 0 THEN 'Germany' WHEN 1 THEN 'United States' "
                "WHEN 2 THEN 'Japan' WHEN 3 THEN 'Brazil' ELSE 'Norway' END")

PANEL = f"""
panel AS (
SELECT s.s_name AS company,
       {INDUSTRY_CASE} AS industry,
       {COUNTRY_CASE} AS country,
       YEAR(l.l_shipdate) AS year,
       COUNT(DISTINCT l.l_orderkey) AS employees,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2))) AS DOUBLE) / 10e0 AS esg_budget,
       CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 8e0 AS carbon_emissions,
       CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 3e0 AS energy,
       100e0 * COUNT(CASE WHEN l.l_returnflag = 'N' THEN 1 END) / COUNT(*) AS renewable_energy,
       CAST(SUM(l.l_linenumber) AS DOUBLE) AS water,
       CAST(COUNT(*) AS DOUBLE) AS waste_total,
       100e0 * COUNT(CASE WHEN l.l_linestatus = 'F' THEN 1 END) / COUNT(*) AS waste_recycled,
       CASE WHEN COUNT(*) >= 90 THEN 100e0 * COUNT(CASE WHEN l.l_returnflag = 'A' THEN 1 END) / COUNT(*) END AS gender_diversity,
       400e0 * CAST(SUM(CAST(l.l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS employee_turnover,
       CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS training,
       100e0 * COUNT(CASE WHEN l.l_tax >= 0.04e0 THEN 1 END) / COUNT(*) AS board_independence,
       CAST(COUNT(CASE WHEN l.l_discount < 0.005e0 THEN 1 END) AS DOUBLE) AS safety,
       CASE WHEN MOD(s.s_suppkey, 5) <> 0 THEN CAST(SUM(CAST(l.l_tax AS DECIMAL(18,2))) AS DOUBLE) * 1000e0 END AS community_investment,
       CAST(SUM(CASE WHEN l.l_returnflag = 'A' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS scope1,
       CAST(SUM(CASE WHEN l.l_returnflag = 'N' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS scope2,
       CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS scope3,
       s.s_suppkey * 10000 + YEAR(l.l_shipdate) AS _row_id
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY s.s_name, s.s_suppkey, s.s_nationkey, YEAR(l.l_shipdate)
)"""

LATEST = """
latest AS (
SELECT * EXCLUDE (_rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY company ORDER BY year IS NULL DESC, year DESC, _row_id DESC) AS _rn
  FROM panel WHERE company IS NOT NULL) WHERE _rn = 1
)"""


def _clamp(e: str, lo=None, hi=None) -> str:
    out = e
    if hi is not None:
        out = f"LEAST({out}, {float(hi)}e0)"
    if lo is not None:
        out = f"GREATEST({out}, {float(lo)}e0)"
    return out


def _mean(terms: list[str]) -> str:
    total = " + ".join(["0e0"] + [f"COALESCE({t}, 0e0)" for t in terms])
    cnt = " + ".join(f"(CASE WHEN {t} IS NOT NULL THEN 1 ELSE 0 END)" for t in terms)
    return f"CASE WHEN ({cnt}) > 0 THEN {R(f'({total}) / ({cnt})')} ELSE 50e0 END", cnt


E_TERMS = [
    "CASE WHEN renewable_energy IS NOT NULL THEN LEAST(renewable_energy, 100e0) END",
    "CASE WHEN carbon_emissions IS NOT NULL AND employees IS NOT NULL AND employees > 0 THEN "
    + _clamp("90e0 - (carbon_emissions / employees - 1e0) * 7.8e0", 20, 90) + " END",
    "CASE WHEN waste_recycled IS NOT NULL THEN LEAST(waste_recycled, 100e0) END",
]
S_TERMS = [
    "CASE WHEN gender_diversity IS NOT NULL THEN LEAST(gender_diversity * 2e0, 100e0) END",
    "CASE WHEN employee_turnover IS NOT NULL THEN " + _clamp("90e0 - (employee_turnover - 5e0) * 2.8e0", 20, 90) + " END",
    "CASE WHEN training IS NOT NULL THEN " + _clamp("20e0 + training * 1.75e0", 20, 90) + " END",
    "CASE WHEN safety IS NOT NULL THEN " + _clamp("95e0 - safety * 3.75e0", 20, 95) + " END",
]
G_TERMS = [
    "CASE WHEN board_independence IS NOT NULL THEN LEAST(board_independence, 100e0) END",
    "CASE WHEN esg_budget IS NOT NULL AND revenue IS NOT NULL AND revenue > 0 THEN "
    + _clamp("30e0 + (esg_budget / revenue) * 100e0 * 60e0", 30, 90) + " END",
    "CASE WHEN community_investment IS NOT NULL AND community_investment > 0 THEN "
    "LEAST(40e0 + LOG10(community_investment) * 10e0, 90e0) END",
]


def _pillar(terms):
    m, cnt = _mean(terms)
    return f"GREATEST(LEAST({m}, 95e0), 10e0)", cnt


_E, _NE = _pillar(E_TERMS)
_S, _NS = _pillar(S_TERMS)
_G, _NG = _pillar(G_TERMS)

GRADE = ("CASE WHEN {x} >= 80 THEN 'A' WHEN {x} >= 65 THEN 'B' WHEN {x} >= 50 THEN 'C' "
         "WHEN {x} >= 35 THEN 'D' ELSE 'F' END")

SCORED = f"""
scored0 AS (
SELECT *, {_E} AS environmental, {_S} AS social, {_G} AS governance,
       {_NE} AS n_e, {_NS} AS n_s, {_NG} AS n_g
FROM latest),
scored AS (
SELECT *, {R('environmental * 0.4e0 + social * 0.3e0 + governance * 0.3e0')} AS esg_score
FROM scored0)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


BASE = with_ctes(PANEL, LATEST, SCORED)

ESG_SCORE = BASE + f"""
SELECT company, year, environmental, social, governance, esg_score,
       {GRADE.format(x='esg_score')} AS grade,
       n_e, n_s, n_g,
       printf('Scored from actual uploaded data. E based on %d metric(s), S based on %d metric(s), G based on %d metric(s).', n_e, n_s, n_g) AS rationale
FROM scored"""

PEER_COMPARISON = BASE + f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY esg_score DESC, company ASC) AS BIGINT) AS rank,
       company, esg_score, {GRADE.format(x='esg_score')} AS grade, environmental, social, governance,
       {R('CAST(employees AS DOUBLE)')} AS employees, {R('carbon_emissions')} AS carbon_emissions,
       {R('renewable_energy')} AS renewable_energy, {R('gender_diversity')} AS gender_diversity,
       {R('board_independence')} AS board_independence, {R('waste_recycled')} AS waste_recycled
FROM scored
WHERE (SELECT COUNT(*) FROM scored) >= 2"""

LATEST_ROW = with_ctes(PANEL, LATEST) + """
SELECT * EXCLUDE (_row_id) FROM latest"""


def values_sql(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"{v!r}e0" if "e" not in repr(v) else repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


__all__ = ["R", "q", "PANEL", "LATEST", "SCORED", "BASE", "ESG_SCORE", "PEER_COMPARISON",
           "LATEST_ROW", "values_sql", "GRADE", "with_ctes", "fixed"]


# ----------------------------------------------------------------- quality
# Column lists of the tables the quality checks run on (schema facts of the
# driver tables; the panel is the CTE above).
PANEL_USER_COLUMNS = ["company", "industry", "country", "year", "employees", "revenue", "esg_budget",
                      "carbon_emissions", "energy", "renewable_energy", "water", "waste_total",
                      "waste_recycled", "gender_diversity", "employee_turnover", "training",
                      "board_independence", "safety", "community_investment", "scope1", "scope2", "scope3"]
PANEL_NUMERIC = PANEL_USER_COLUMNS[3:]
PANEL_METRICS = PANEL_USER_COLUMNS[4:]
QUALITY_TABLES = {
    "panel": PANEL_USER_COLUMNS,
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "labels": ["doc_id", "quality", "toxic"],
}
QUALITY_NUMERIC = {
    "panel": PANEL_NUMERIC,
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "events": ["event_id", "user_id", "value"],
    "labels": ["doc_id", "quality", "toxic"],
}

DQ_DUPLICATES = with_ctes(PANEL) + " " + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_rows,
        CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS n_duplicates,
        CASE WHEN COALESCE(SUM(n - 1), 0) > 0 THEN printf('Found %d duplicate row(s). Consider deduplicating.',
             CAST(SUM(n - 1) AS BIGINT)) END AS message
        FROM (SELECT COUNT(*) AS n FROM {t} GROUP BY ALL_COLS_{t})"""
    for t in QUALITY_TABLES)
for _t, _cols in QUALITY_TABLES.items():
    DQ_DUPLICATES = DQ_DUPLICATES.replace(f"ALL_COLS_{_t})", ", ".join(_cols) + ")")

DQ_MISSING = with_ctes(PANEL) + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
        {R(f"100e0 * AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END)")} AS pct_missing,
        100e0 * AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS _raw FROM {t}"""
    for t, cols in QUALITY_TABLES.items() for c in cols) + """) WHERE _raw > 50e0"""
DQ_MISSING = ("SELECT table_name, column_name, pct_missing, printf('Column ''%s'' has %.1f%% missing values.', "
              "column_name, pct_missing) AS message FROM (" + DQ_MISSING + ")")

DQ_CONSTANT = with_ctes(PANEL) + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
        printf('Column ''%s'' has only one unique value (constant).', '{c}') AS message
        FROM {t} HAVING COUNT(DISTINCT {c}) <= 1"""
    for t, cols in QUALITY_NUMERIC.items() for c in cols) + ")"

_PASS = "✅ Data constraint check passed – all records are from 2010 onwards."
_SKIP = "No year/date column found – temporal validation skipped."
YEAR_RULE = with_ctes(PANEL) + f"""
SELECT 'panel' AS table_name, NOT COALESCE(MIN(year) < 2010, FALSE) AS passed,
       CASE WHEN MIN(year) < 2010 THEN printf('Column ''year'' contains data from %d, before 2010.', CAST(MIN(year) AS BIGINT))
            ELSE {q(_PASS)} END AS message FROM panel
UNION ALL
SELECT 'lineitem', NOT COALESCE(MIN(YEAR(l_shipdate)) < 2010, FALSE),
       CASE WHEN MIN(YEAR(l_shipdate)) < 2010 THEN printf('Column ''l_shipdate'' contains dates from %d, before 2010.', CAST(MIN(YEAR(l_shipdate)) AS BIGINT))
            ELSE {q(_PASS)} END FROM lineitem
UNION ALL
SELECT 'orders', NOT COALESCE(MIN(YEAR(o_orderdate)) < 2010, FALSE),
       CASE WHEN MIN(YEAR(o_orderdate)) < 2010 THEN printf('Column ''o_orderdate'' contains dates from %d, before 2010.', CAST(MIN(YEAR(o_orderdate)) AS BIGINT))
            ELSE {q(_PASS)} END FROM orders
UNION ALL
SELECT 'events', TRUE, {q(_SKIP)} FROM (SELECT COUNT(*) FROM events)
UNION ALL
SELECT 'customer', TRUE, {q(_SKIP)} FROM (SELECT COUNT(*) FROM customer)"""

# ----------------------------------------------------------------- detection
DETECT_TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": QUALITY_TABLES["customer"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": QUALITY_TABLES["orders"],
    "lineitem": QUALITY_TABLES["lineitem"],
    "events": QUALITY_TABLES["events"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": QUALITY_TABLES["labels"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "panel": PANEL_USER_COLUMNS + ["_row_id"],
}
_COLS_VALUES = values_sql([(t, i, c) for t, cols in DETECT_TABLES.items() for i, c in enumerate(cols)],
                          ["table_name", "column_ord", "column_name"])
_PATS_VALUES = values_sql([(mo, m, po, p) for mo, (m, ps) in enumerate(fixed.COLUMN_PATTERNS.items())
                           for po, p in enumerate(ps)], ["metric_ord", "metric", "pattern_ord", "pattern"])
COLUMN_DETECT = f"""
WITH cols AS (SELECT * FROM {_COLS_VALUES}),
pats AS (SELECT * FROM {_PATS_VALUES}),
hits AS (SELECT c.table_name, c.column_ord, c.column_name, p.metric, p.pattern, p.pattern_ord
         FROM cols c JOIN pats p ON contains(lower(replace(c.column_name, ' ', '_')), p.pattern)),
first_hit AS (SELECT table_name, column_ord, column_name, metric, arg_min(pattern, pattern_ord) AS pattern
              FROM hits GROUP BY table_name, column_ord, column_name, metric),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name, metric
                                        ORDER BY length(pattern) DESC, column_ord) AS rn FROM first_hit)
SELECT table_name, metric, column_name, CAST(length(pattern) AS BIGINT) AS score FROM ranked WHERE rn = 1"""

# ----------------------------------------------------------------- profiling
_UNPIV = ", ".join(PANEL_NUMERIC)
_NUMCAST = f"""numcast AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PANEL_NUMERIC)} FROM panel)"""
_LONG = _NUMCAST + f""", long AS (SELECT column_name, CAST(value AS DOUBLE) AS value FROM
  (UNPIVOT numcast ON {_UNPIV} INTO NAME column_name VALUE value))"""
_LONG_NULLS = _NUMCAST + f""", long AS (SELECT column_name, CAST(value AS DOUBLE) AS value FROM
  numcast UNPIVOT INCLUDE NULLS (value FOR column_name IN ({_UNPIV})))"""

PROFILE_STATS = with_ctes(PANEL, _LONG) + f"""
SELECT column_name, {R('MIN(value)', 2)} AS min_val, {R('MAX(value)', 2)} AS max_val,
       {R('AVG(value)', 2)} AS mean_val, {R('quantile_cont(value, 0.5)', 2)} AS median_val
FROM long GROUP BY column_name"""

DESCRIBE = with_ctes(PANEL, _LONG_NULLS) + f"""
SELECT column_name, CAST(COUNT(value) AS DOUBLE) AS count, {R('AVG(value)', 2)} AS mean,
       {R('STDDEV_SAMP(value)', 2)} AS std, {R('MIN(value)', 2)} AS min,
       {R('quantile_cont(value, 0.25)', 2)} AS p25, {R('quantile_cont(value, 0.5)', 2)} AS p50,
       {R('quantile_cont(value, 0.75)', 2)} AS p75, {R('MAX(value)', 2)} AS max
FROM long GROUP BY column_name"""

_NULLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in PANEL_USER_COLUMNS)
PROFILE_SUMMARY = with_ctes(PANEL) + f"""
SELECT company, COUNT(*) AS row_count, CAST(MIN(year) AS BIGINT) AS year_min, CAST(MAX(year) AS BIGINT) AS year_max,
       CAST({len(PANEL_USER_COLUMNS)} AS BIGINT) AS col_count,
       {R(f'(1e0 - SUM({_NULLS}) / (COUNT(*) * {float(len(PANEL_USER_COLUMNS))}e0)) * 100e0')} AS completeness_pct
FROM panel WHERE company IS NOT NULL GROUP BY company"""

COMPANIES = with_ctes(PANEL) + " SELECT DISTINCT company FROM panel WHERE company IS NOT NULL"
COMPANIES_SEEN = with_ctes(PANEL) + """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY first_row) AS BIGINT) AS seen_order, company
FROM (SELECT company, MIN(_row_id) AS first_row FROM panel WHERE company IS NOT NULL GROUP BY company)"""

# ----------------------------------------------------------------- trends
_MLONG = f"""mcast AS (SELECT company, year, _row_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PANEL_METRICS)}
   FROM panel WHERE company IS NOT NULL),
mlong AS (SELECT company, CAST(year AS DOUBLE) AS year, _row_id, metric, metric AS column_name,
  CAST(value AS DOUBLE) AS value FROM
  mcast UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(PANEL_METRICS)})))"""
_LOWER = ", ".join(q(m) for m in fixed.LOWER_IS_BETTER)
_HIGHER = ", ".join(q(m) for m in fixed.HIGHER_IS_BETTER)
_TRENDS = f"""trends AS (
SELECT company, metric, column_name, n_values, first_value, last_value,
       CASE WHEN first_value <> 0 THEN {R('(last_value - first_value) / ABS(first_value) * 100e0')} ELSE 0e0 END AS pct_change
FROM (SELECT company, metric, column_name, COUNT(*) AS n_values,
             FIRST(value ORDER BY year IS NULL, year, _row_id) AS first_value,
             LAST(value ORDER BY year IS NULL, year, _row_id) AS last_value
      FROM mlong WHERE value IS NOT NULL GROUP BY company, metric, column_name)
WHERE n_values >= 2),
trends2 AS (SELECT *, CASE WHEN metric IN ({_LOWER}) THEN pct_change < 0
                          WHEN metric IN ({_HIGHER}) THEN pct_change > 0 END AS is_improving FROM trends)"""
TREND_METRIC = with_ctes(PANEL, _MLONG, _TRENDS) + " SELECT * FROM trends2"
TREND_DIRECTION = with_ctes(PANEL, _MLONG, _TRENDS) + """
SELECT c.company, COALESCE(improving_count, 0) AS improving_count, COALESCE(declining_count, 0) AS declining_count,
       CASE WHEN COALESCE(improving_count, 0) + COALESCE(declining_count, 0) = 0 THEN 'Insufficient Data'
            WHEN improving_count / (improving_count + declining_count) >= 0.7 THEN 'Improving'
            WHEN declining_count / (improving_count + declining_count) >= 0.7 THEN 'Declining'
            ELSE 'Mixed' END AS overall_direction
FROM (SELECT DISTINCT company FROM panel WHERE company IS NOT NULL) c
LEFT JOIN (SELECT company, COUNT(*) FILTER (WHERE is_improving) AS improving_count,
                  COUNT(*) FILTER (WHERE NOT is_improving) AS declining_count
           FROM trends2 GROUP BY company) t ON c.company = t.company"""

TREND_UNKNOWN = "WITH found AS (" + TREND_DIRECTION + """)
SELECT a.company, COALESCE(f.improving_count, 0) AS improving_count, COALESCE(f.declining_count, 0) AS declining_count,
       COALESCE(f.overall_direction, 'Unknown') AS overall_direction
FROM (SELECT s_name AS company FROM supplier UNION ALL SELECT c_name FROM customer) a
LEFT JOIN found f ON a.company = f.company"""

_TITLES = values_sql([(m, m.replace("_", " ").title()) for m in PANEL_METRICS], ["metric", "title"])
_YOY = f"""yoy AS (
SELECT l.company, t.title AS metric, l.column_name, CAST(l.year AS BIGINT) AS year,
       {R('arg_max(l.value, l._row_id)')} AS value
FROM mlong l JOIN {_TITLES} ON l.metric = t.metric
WHERE l.year IS NOT NULL
  AND (l.company, l.metric) IN (SELECT company, metric FROM mlong GROUP BY company, metric HAVING COUNT(value) > 0)
GROUP BY l.company, t.title, l.column_name, l.year)"""
YOY_LONG = with_ctes(PANEL, _MLONG, _YOY) + " SELECT * FROM yoy"
#: Ship years of the line items: the pivot's columns.
YEARS = list(range(1995, 2002))
YOY_PIVOT = with_ctes(PANEL, _MLONG, _YOY) + f"""
SELECT company, metric, column_name, {', '.join(f'MAX(CASE WHEN year = {y} THEN value END) AS "{y}"' for y in YEARS)}
FROM yoy GROUP BY company, metric, column_name"""


# ----------------------------------------------------------------- company context
def money0_sql(x: str) -> str:
    return f"printf('%,.0f', CAST(round_even(CAST(({x}) AS DECIMAL(38,8)), 0) AS DOUBLE))"


def thousands_sql(x: str) -> str:
    return f"printf('%.0f', CAST(round_even(CAST(({x}) / 1000e0 AS DECIMAL(38,8)), 0) AS DOUBLE))"


PROFILES = f"""
profiles AS (
SELECT s.s_name AS company, MOD(s.s_suppkey * 37, 2000) AS employee_count, s.s_acctbal * 100e0 AS budget,
       {INDUSTRY_CASE} AS industry, {COUNTRY_CASE} AS country,
       CASE WHEN COALESCE(MOD(s.s_suppkey * 37, 2000), 0) >= 250 THEN 'Large'
            WHEN COALESCE(MOD(s.s_suppkey * 37, 2000), 0) >= 50 THEN 'Medium' ELSE 'Small' END AS business_size
FROM supplier s)"""

COMPLETENESS = f"""
comp AS (
SELECT company, {R(f'(1e0 - SUM({_NULLS}) / (COUNT(*) * {float(len(PANEL_USER_COLUMNS))}e0)) * 100e0')} AS completeness_pct
FROM panel WHERE company IS NOT NULL GROUP BY company)"""

_MODS = values_sql(fixed.INDUSTRY_MODIFIERS, ["industry_key", "e", "s", "g"])
MATURITY_CTE = f"""
cm0 AS (
SELECT p.*, c.completeness_pct, COALESCE(p.budget, 0e0) AS _b, COALESCE(CAST(p.employee_count AS DOUBLE), 0e0) AS _e
FROM profiles p JOIN comp c ON p.company = c.company),
cm1 AS (
SELECT cm0.*, _b / GREATEST(_e, 1e0) AS _pe, COALESCE(t.e, 0) AS _me, COALESCE(t.s, 0) AS _ms, COALESCE(t.g, 0) AS _mg
FROM cm0 LEFT JOIN {_MODS} ON lower(COALESCE(cm0.industry, 'unknown')) = t.industry_key),
cm2 AS (
SELECT *,
  GREATEST(LEAST((CASE WHEN _pe > 2000 THEN 72 WHEN _pe > 1000 THEN 58 WHEN _pe > 500 THEN 45 ELSE 32 END) + _me, 95), 10) AS _env,
  GREATEST(LEAST((CASE WHEN _e > 1000 THEN 60 WHEN _e > 500 THEN 55 WHEN _e > 100 THEN 45 ELSE 35 END) + _ms, 95), 10) AS _soc,
  GREATEST(LEAST((CASE WHEN _b > 1000000 THEN 68 WHEN _b > 500000 THEN 60 WHEN _b > 200000 THEN 52
                       WHEN _b > 50000 THEN 40 ELSE 30 END) + _mg, 95), 10) AS _gov0
FROM cm1),
cm3 AS (
SELECT *, CAST(_env AS DOUBLE) AS m_environmental, CAST(_soc AS DOUBLE) AS m_social,
  CAST(CASE WHEN completeness_pct > 90 THEN LEAST(_gov0 + 8, 95) WHEN completeness_pct < 50 THEN GREATEST(_gov0 - 10, 10)
       ELSE _gov0 END AS DOUBLE) AS m_governance
FROM cm2),
cm AS (
SELECT *, {R('m_environmental * 0.4e0 + m_social * 0.3e0 + m_governance * 0.3e0')} AS m_overall,
  'Based on a ' || lower(COALESCE(business_size, 'Medium')) || ' ' || lower(industry) || ' company with '
  || printf('%,d', CAST(COALESCE(employee_count, 0) AS BIGINT)) || ' employees and $' || {money0_sql('_b')}
  || ' ESG budget. Environmental score reflects per-employee commitment of $' || {money0_sql('_pe')}
  || '. Social score accounts for workforce scale and industry norms. Governance score considers budget magnitude and disclosure readiness.' AS m_rationale
FROM cm3)"""

CTX = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE)

SIZE_CLASS = with_ctes(PROFILES) + " SELECT company, employee_count, business_size FROM profiles"
MATURITY = CTX + f"""
SELECT company, industry, country, employee_count, budget, business_size, completeness_pct,
       m_environmental AS environmental, m_social AS social, m_governance AS governance, m_overall AS overall,
       {GRADE.format(x='m_overall')} AS grade, m_rationale AS rationale FROM cm"""

READINESS = CTX + """
SELECT company, m_governance AS governance, LEAST(100e0, m_governance * 1.2e0) AS readiness_score,
       CASE WHEN LEAST(100e0, m_governance * 1.2e0) >= 70 THEN 'High'
            WHEN LEAST(100e0, m_governance * 1.2e0) >= 45 THEN 'Medium' ELSE 'Low' END AS readiness_label FROM cm"""

_BENCH = values_sql([(i, *map(float, v)) for i, *v in fixed.INDUSTRY_BENCHMARKS],
                    ["b_industry"] + fixed.BENCHMARK_COLUMNS)
_BCOLS = ", ".join(f"COALESCE(t.{c}, {float(d)}e0) AS {c}" for c, d in zip(fixed.BENCHMARK_COLUMNS,
                                                                          fixed.DEFAULT_BENCHMARK))
BENCH_JOIN = f"""
cb AS (SELECT cm.*, {_BCOLS} FROM cm LEFT JOIN {_BENCH} ON cm.industry = t.b_industry)"""


def _status(x):
    return (f"CASE WHEN {x} >= 65 THEN 'Strong' WHEN {x} >= 45 THEN 'Moderate' ELSE 'Weak' END",
            f"CASE WHEN {x} >= 65 THEN 'Strong' WHEN {x} >= 45 THEN 'Moderate' ELSE 'Needs Improvement' END",
            f"CASE WHEN {x} >= 65 THEN 'Strong' ELSE 'Needs Work' END")


PILLAR_STATUS = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, BENCH_JOIN) + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT company, {o} AS pillar_ord, '{p}' AS pillar, {col} AS score, esg_score_avg * {f}e0 AS industry_reference,
        {_status(col)[0]} AS status, {_status(col)[1]} AS status_detailed, {_status(col)[2]} AS status_dashboard FROM cb"""
    for o, p, col, f in [(1, "Environmental", "m_environmental", 0.95), (2, "Social", "m_social", 1.0),
                         (3, "Governance", "m_governance", 1.05)]) + ")"

LATEST_REAL = """
lr AS (SELECT company, renewable_energy AS real_renewable_energy, gender_diversity AS real_gender_diversity,
              esg_budget AS real_esg_budget FROM latest)"""
_B_ROWS = [
    (1, "Overall ESG Score", "m_overall", "esg_score_avg", "esg_score_top_quartile"),
    (2, "Environmental Pillar", "m_environmental", R("esg_score_avg * 0.95e0"), R("esg_score_top_quartile * 0.95e0")),
    (3, "Social Pillar", "m_social", "esg_score_avg", "esg_score_top_quartile"),
    (4, "Governance Pillar", "m_governance", R("esg_score_avg * 1.05e0"), R("esg_score_top_quartile * 1.05e0")),
    (5, "Renewable Energy (%)", f"COALESCE(real_renewable_energy, {R('renewable_energy_pct * 0.7e0')})",
     "renewable_energy_pct", "LEAST(renewable_energy_pct * 1.5e0, 100e0)"),
    (6, "Gender Diversity (%)", f"COALESCE(real_gender_diversity, {R('gender_diversity_pct * 0.85e0')})",
     "gender_diversity_pct", "LEAST(gender_diversity_pct * 1.3e0, 50e0)"),
    (7, "ESG Disclosure (%)", f"COALESCE(real_esg_budget, {R('esg_disclosure_pct * 0.65e0')})",
     "esg_disclosure_pct", "LEAST(esg_disclosure_pct * 1.2e0, 100e0)"),
]
BENCH_ROWS = f"""
brows AS (SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT cb.company, {o} AS metric_ord, {q(n)} AS metric, {R(cv)} AS company_value, {R(ia)} AS industry_avg, "
    f"{R(tq)} AS top_quartile FROM cb LEFT JOIN lr ON cb.company = lr.company"
    for o, n, cv, ia, tq in _B_ROWS) + f""")),
bench AS (SELECT *, {R('company_value - industry_avg')} AS gap FROM brows),
bench2 AS (SELECT *, CASE WHEN gap > 5 THEN 'Above Average' WHEN gap >= -5 THEN 'At Average'
                          ELSE 'Below Average' END AS status FROM bench)"""
BENCH_CTX = with_ctes(PANEL, LATEST, PROFILES, COMPLETENESS, MATURITY_CTE, BENCH_JOIN, LATEST_REAL, BENCH_ROWS)
BENCHMARK_COMPARE = BENCH_CTX + " SELECT * FROM bench2"
GAP_BELOW = BENCH_CTX + """ SELECT *, printf('**%s**: %+.1f points below industry average. Target: %.1f (avg) / %.1f (top quartile)',
    metric, gap, industry_avg, top_quartile) AS message FROM bench2 WHERE status = 'Below Average'"""

_REGS = values_sql([(c, fw, dl, pen, reg) for c, fw, dl, pen, reg in fixed.REGULATIONS if c],
                   ["r_country", "frameworks", "key_deadlines", "penalties", "regulator"])
_DREG = fixed.REGULATIONS[-1]
_DEFAULT_FW = "[" + ", ".join(q(x) for x in _DREG[1]) + "]"
REG_JOIN = f"""
creg AS (SELECT cm.*, COALESCE(t.frameworks, {_DEFAULT_FW}) AS frameworks,
  COALESCE(t.key_deadlines, {q(_DREG[2])}) AS key_deadlines, COALESCE(t.penalties, {q(_DREG[3])}) AS penalties,
  COALESCE(t.regulator, {q(_DREG[4])}) AS regulator
FROM cm LEFT JOIN {_REGS} ON cm.country = t.r_country)"""
REGULATION = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN) + """
SELECT company, country, array_to_string(frameworks, ' | ') AS frameworks, CAST(len(frameworks) AS BIGINT) AS n_frameworks,
       key_deadlines, penalties, regulator FROM creg"""

# ----------------------------------------------------------------- solutions
_SOLS = values_sql([(o, n, c, d, float(lo), float(hi), float(sv), float(pb), fit)
                    for o, n, c, d, lo, hi, sv, pb, fit in fixed.SOLUTIONS],
                   ["template_ord", "name", "category", "description", "cost_low", "cost_high", "savings",
                    "payback_years", "base_fit"])
_BOOSTS = values_sql([(i, n) for i, ns in fixed.INDUSTRY_BOOSTS for n in ns], ["boost_industry", "boost_name"])
_CSCALE = "CASE business_size " + " ".join(f"WHEN {q(k)} THEN {float(v)}e0" for k, v in fixed.COST_SCALE.items()) + " ELSE 1e0 END"
SOL_CTE = f"""
sol0 AS (SELECT p.company, p.industry, p.business_size, p.budget, s.*,
                s.cost_low * ({_CSCALE}) AS upfront_cost_low, s.cost_high * ({_CSCALE}) AS upfront_cost_high,
                s.savings * ({_CSCALE}) AS annual_savings
         FROM profiles p JOIN comp c ON p.company = c.company, {_SOLS.replace(') AS t(', ') AS s(')}),
sol1 AS (SELECT sol0.*, CASE WHEN b.boost_name IS NOT NULL THEN LEAST(base_fit + 5, 100) ELSE base_fit END AS _fit0
         FROM sol0 LEFT JOIN {_BOOSTS.replace(') AS t(', ') AS b(')} ON sol0.industry = b.boost_industry AND sol0.name = b.boost_name),
sol2 AS (SELECT *, CAST(CASE WHEN budget IS NOT NULL AND budget > 0 AND upfront_cost_low > budget * 2e0
                        THEN GREATEST(_fit0 - 15, 10) ELSE _fit0 END AS INTEGER) AS fit_score FROM sol1),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY company ORDER BY fit_score DESC, template_ord) AS BIGINT) AS rank,
                  (upfront_cost_low + upfront_cost_high) / 2e0 AS avg_cost FROM sol2)"""
SOL_CTX = with_ctes(PANEL, PROFILES, COMPLETENESS, SOL_CTE)
RANK_SOLUTIONS = SOL_CTX + f"""
SELECT company, rank, template_ord, name, category, description, fit_score, upfront_cost_low, upfront_cost_high,
       annual_savings, payback_years, avg_cost,
       '$' || {thousands_sql('avg_cost')} || 'K' AS investment_display,
       printf('%.1f yrs', payback_years) AS payback_display,
       '$' || {thousands_sql('upfront_cost_low')} || 'K–$' || {thousands_sql('upfront_cost_high')} || 'K' AS cost_range,
       '$' || {thousands_sql('annual_savings')} || 'K/yr' AS savings_display
FROM ranked"""
ROI_TIMELINE = SOL_CTX + """
SELECT company, rank, name, CAST(y.year AS BIGINT) AS year, -avg_cost + annual_savings * y.year AS cumulative_value
FROM ranked, (SELECT unnest(range(0, 6)) AS year) y WHERE rank <= 4"""

# ----------------------------------------------------------------- KPI
_KSCALE = "CASE business_size " + " ".join(f"WHEN {q(k)} THEN {float(v)}e0" for k, v in fixed.KPI_SCALE.items()) + " ELSE 1e0 END"
_KT = values_sql([(o, k, float(b), i) for o, k, b, i in fixed.KPI_TEMPLATES], ["kpi_ord", "kpi", "base_default", "imp_default"])
_MEAS = {k: (m, i) for m, k, i in fixed.KPI_MEASURED}
_BASE = "CASE " + " ".join(f"WHEN kpi = {q(k)} AND {m} IS NOT NULL THEN {m}" for k, (m, i) in _MEAS.items()) + \
        f" WHEN kpi_ord = 1 THEN base_default * ({_KSCALE}) ELSE base_default END"
_IMP = "CASE " + " ".join(f"WHEN kpi = {q(k)} AND {m} IS NOT NULL THEN {i}" for k, (m, i) in _MEAS.items()) + \
       " ELSE imp_default END"
KPI_CTE = f"""
k0 AS (SELECT r.company, r.rank, r.name AS solution, r.business_size, t.kpi_ord, t.kpi, t.base_default, t.imp_default,
              l.carbon_emissions, l.energy, l.gender_diversity, l.waste_recycled, l.employee_turnover
       FROM ranked r LEFT JOIN latest l ON r.company = l.company, {_KT}),
k1 AS (SELECT company, rank, solution, kpi_ord, kpi, {_BASE} AS _base, CAST({_IMP} AS INTEGER) AS improvement_pct FROM k0),
kpis AS (SELECT company, rank, solution, kpi_ord, kpi, {R('_base')} AS current,
                {R('_base * (1e0 + improvement_pct / 100e0)')} AS projected, improvement_pct FROM k1)"""
KPI_CTX = with_ctes(PANEL, LATEST, PROFILES, COMPLETENESS, SOL_CTE, KPI_CTE)
KPI_PROJECTION = KPI_CTX + " SELECT * FROM kpis"
_KNAMES = {1: "carbon_emissions_tco2e", 2: "energy_efficiency_pct", 3: "employee_satisfaction_pct",
           4: "waste_diversion_rate_pct", 5: "esg_disclosure_score"}
KPI_HEATMAP = KPI_CTX + " SELECT company, solution, " + ", ".join(
    f"MAX(CASE WHEN kpi_ord = {o} THEN improvement_pct END) AS {n}" for o, n in _KNAMES.items()) + \
    " FROM kpis GROUP BY company, solution"
_IMAP = values_sql(fixed.KPI_IMPROVEMENT_MAP, ["metric", "kpi", "improvement"])
KPI_REAL = with_ctes(PANEL, PROFILES, COMPLETENESS, SOL_CTE, _MLONG, _TRENDS) + f"""
SELECT tr.company, r.rank, r.name AS solution, tr.metric, t.kpi, {R('tr.last_value')} AS current,
       {R('tr.last_value * (1e0 + t.improvement / 100e0)')} AS projected, t.improvement AS improvement_pct
FROM trends tr JOIN {_IMAP} ON tr.metric = t.metric JOIN ranked r ON tr.company = r.company WHERE r.rank <= 3"""

# ----------------------------------------------------------------- risks
_TPL = values_sql(fixed.RISK_OPP_TEMPLATES, ["t_kind", "t_industry", "ord", "title", "description", "level",
                                            "fw_slot", "fw_fallback"])
_RISK_IND = ", ".join(q(x) for x in sorted({t[1] for t in fixed.RISK_OPP_TEMPLATES if t[0] == "risk" and t[1]}))
_OPP_IND = ", ".join(q(x) for x in sorted({t[1] for t in fixed.RISK_OPP_TEMPLATES if t[0] == "opportunity" and t[1]}))
RISK_CTE = f"""
kinds AS (SELECT company, industry, country, business_size, frameworks, key_deadlines, 'risk' AS kind,
                 CASE WHEN industry IN ({_RISK_IND}) THEN industry END AS tpl_industry FROM creg
          UNION ALL
          SELECT company, industry, country, business_size, frameworks, key_deadlines, 'opportunity',
                 CASE WHEN industry IN ({_OPP_IND}) THEN industry END FROM creg),
ro0 AS (SELECT k.*, t.ord, t.title, t.description, t.level, t.fw_slot, t.fw_fallback,
               CASE WHEN t.fw_slot = 0 THEN (CASE WHEN len(k.frameworks) > 0
                                                  THEN array_to_string(list_slice(k.frameworks, 1, 2), ', ')
                                                  ELSE t.fw_fallback END)
                    ELSE COALESCE(k.frameworks[t.fw_slot], t.fw_fallback) END AS fw
        FROM kinds k JOIN {_TPL} ON k.kind = t.t_kind AND k.tpl_industry IS NOT DISTINCT FROM t.t_industry),
ro AS (SELECT company, kind, CAST(ord AS BIGINT) AS ord, title,
              replace(replace(replace(replace(replace(description, '{{fw}}', COALESCE(fw, '')), '{{dl}}', key_deadlines),
                      '{{country}}', COALESCE(country, '')), '{{size}}', lower(COALESCE(business_size, ''))),
                      '{{industry}}', lower(COALESCE(industry, ''))) AS description, level
       FROM ro0)"""
RISK_CTX = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN, RISK_CTE)
RISKS = RISK_CTX + " SELECT * FROM ro"
RISK_SEVERITY = RISK_CTX + " SELECT company, level AS severity, COUNT(*) AS count FROM ro WHERE kind = 'risk' GROUP BY company, level"

SCENARIO = CTX + """
SELECT company, business_size, COALESCE(budget, 0e0) AS budget, CAST(COALESCE(employee_count, 0) AS BIGINT) AS employee_count,
       COALESCE(budget, 0e0) * 1.2e0 AS budget_optimistic, COALESCE(budget, 0e0) * 0.8e0 AS budget_pessimistic,
       CAST(GREATEST(1, FLOOR((CASE WHEN COALESCE(employee_count, 0) = 0 THEN 10 ELSE employee_count END) / 50e0)) AS BIGINT) AS esg_fte,
       CAST(COALESCE(employee_count, 0) * 200 AS BIGINT) AS attrition_savings,
       8000e0 * (CASE WHEN business_size = 'Large' THEN 2.5e0 ELSE 1e0 END) AS compliance_cost_low,
       30000e0 * (CASE WHEN business_size = 'Large' THEN 2.5e0 ELSE 1e0 END) AS compliance_cost_high,
       CAST(COALESCE(employee_count, 0) * 50 AS BIGINT) AS carbon_credit_low,
       CAST(COALESCE(employee_count, 0) * 150 AS BIGINT) AS carbon_credit_high
FROM cm"""

# ----------------------------------------------------------------- text
def _scrub_sql(x: str) -> str:
    out = x
    for pattern, marker in fixed.PII_RULES:
        out = f"regexp_replace({out}, {q(pattern)}, {q(marker)}, 'g')"
    return out


PII_SCRUB = f"""
SELECT doc_id, {_scrub_sql('text')} AS scrubbed FROM documents"""


def _first_capture_sql(x: str, patterns) -> str:
    return "COALESCE(" + ", ".join(f"NULLIF(regexp_extract({x}, {q(p)}, 1), '')" for p in patterns) + ")"


def _contained_sql(x: str, names) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(n)}) THEN {q(n.title())}" for n in names) + " END"


_MULT = "CASE {u} " + " ".join(f"WHEN {q(k)} THEN {float(v)}e0" for k, v in fixed.BUDGET_MULTIPLIERS.items()) + " ELSE 1e0 END"
_BUDGET_PARTS = []
for _p in fixed.BUDGET_PATTERNS:
    _raw = f"trim(replace(regexp_extract(low, {q(_p)}, 1), ',', ''))"
    _unit = f"lower(regexp_extract(low, {q(_p)}, 2))"
    _BUDGET_PARTS.append((_raw, f"TRY_CAST({_raw} AS DOUBLE) * ({_MULT.format(u=_unit)})"))
_BUDGET = "CASE " + " ".join(f"WHEN {r} <> '' THEN {a}" for r, a in _BUDGET_PARTS) + " END"

PROFILE_EXTRACT = f"""
SELECT doc_id,
       TRY_CAST(replace({_first_capture_sql('low', fixed.EMPLOYEE_PATTERNS)}, ',', '') AS BIGINT) AS employee_count,
       {_BUDGET} AS budget,
       {_contained_sql('low', fixed.TEXT_INDUSTRIES)} AS industry,
       {_contained_sql('low', fixed.TEXT_COUNTRIES)} AS country
FROM (SELECT doc_id, lower(text) AS low FROM documents)"""

_MISSING = " || ".join(
    f"CASE WHEN {f} IS NULL THEN '{f},' ELSE '' END" for f in fixed.REQUIRED_PROFILE_FIELDS)
MISSING_FIELDS = f"""
WITH ex AS ({PROFILE_EXTRACT})
SELECT doc_id, rtrim({_MISSING}, ',') AS missing_fields,
       CAST(({' + '.join(f'CAST({f} IS NULL AS INTEGER)' for f in fixed.REQUIRED_PROFILE_FIELDS)}) AS BIGINT) AS n_missing,
       COALESCE(employee_count, {fixed.FORM_DEFAULTS['employee_count']}) AS employee_count_filled,
       COALESCE(budget, {fixed.FORM_DEFAULTS['budget']}e0) AS budget_filled,
       COALESCE(employee_count, {fixed.FORM_DEFAULTS['employee_count']}) BETWEEN {fixed.FORM_RANGES['employee_count'][0]} AND {fixed.FORM_RANGES['employee_count'][1]} AS employee_count_in_range,
       COALESCE(budget, {fixed.FORM_DEFAULTS['budget']}e0) BETWEEN {fixed.FORM_RANGES['budget'][0]}e0 AND {fixed.FORM_RANGES['budget'][1]}e0 AS budget_in_range,
       industry IN ({', '.join(q(x) for x in fixed.FORM_INDUSTRIES)}) AS industry_allowed,
       country IN ({', '.join(q(x) for x in fixed.FORM_COUNTRIES)}) AS country_allowed
FROM ex"""


def _latin1_sql(x: str) -> str:
    out = x
    for ch, rep in fixed.LATIN1_REPLACEMENTS:
        out = f"replace({out}, {q(ch)}, {q(rep)})"
    return f"regexp_replace({out}, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')"


LATIN1 = f"SELECT doc_id, {_latin1_sql('text')} AS text_latin1 FROM documents"

_INTENT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(low, {q(w)})" for w in words) + f" THEN {q(name)}"
    for name, words in fixed.INTENT_KEYWORDS) + f" ELSE {q(fixed.INTENT_DEFAULT)} END"
INTENT_ROUTE = f"""
SELECT conv_id, turn, {_INTENT} AS intent
FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE role = 'user')"""

_CLEAN = ("regexp_replace(regexp_replace(replace(regexp_replace(txt, '```(?:json)?\\s*', '', 'g'), '```', ''), "
          "'^\\s+', ''), '\\s+$', '')")
JSON_EXTRACT = f"""
WITH src AS (
  SELECT 'events' AS source, event_id AS id, props AS txt FROM events
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'documents', doc_id, text FROM documents),
c AS (SELECT source, id, {_CLEAN} AS cleaned FROM src),
s AS (SELECT source, id, cleaned,
             NULLIF(regexp_extract(cleaned, '(?s)\\{{.*\\}}', 0), '') AS obj,
             NULLIF(regexp_extract(cleaned, '(?s)\\[.*\\]', 0), '') AS arr FROM c)
SELECT source, id,
       CASE WHEN json_valid(cleaned) THEN cleaned
            WHEN obj IS NOT NULL AND json_valid(obj) THEN obj
            WHEN arr IS NOT NULL AND json_valid(arr) THEN arr END AS json_text
FROM s"""

# ----------------------------------------------------------------- X8 / P8 per company
def _detected_keys() -> str:
    from verdant.operators.schema import detect_columns
    return ", ".join(detect_columns(PANEL_USER_COLUMNS).keys())


_HL = [("carbon_emissions", "Carbon Emissions"), ("renewable_energy", "Renewable Energy"),
       ("gender_diversity", "Gender Diversity"), ("energy", "Energy")]
_HL_AGGS = ", ".join(f"MIN({c}) AS mn_{c}, MAX({c}) AS mx_{c}, AVG({c}) AS av_{c}" for c, _ in _HL)
_HL_TXT = ", ".join(
    f"CASE WHEN mn_{c} IS NOT NULL THEN '{t}: mean=' || CAST({R(f'av_{c}', 2)} AS VARCHAR) || ', range [' || "
    f"CAST({R(f'mn_{c}', 2)} AS VARCHAR) || ', ' || CAST({R(f'mx_{c}', 2)} AS VARCHAR) || '].' END"
    for c, t in _HL)
SUMMARY_CTE = f"""
summ AS (
SELECT company, COUNT(*) AS row_count, CAST({len(PANEL_USER_COLUMNS)} AS BIGINT) AS col_count,
       {R(f'(1e0 - SUM({_NULLS}) / (COUNT(*) * {float(len(PANEL_USER_COLUMNS))}e0)) * 100e0')} AS completeness_pct,
       CAST(MIN(year) AS BIGINT) AS year_min, CAST(MAX(year) AS BIGINT) AS year_max, {_HL_AGGS}
FROM panel WHERE company IS NOT NULL GROUP BY company),
summ_txt AS (
SELECT company, row_count, col_count, completeness_pct,
       concat_ws(' ', printf('Dataset: %d rows, %d columns.', row_count, col_count),
                 'Completeness: ' || CAST(completeness_pct AS VARCHAR) || '%.',
                 CASE WHEN year_min IS NOT NULL THEN printf('Year range: %d-%d.', year_min, year_max) END,
                 'Companies: ' || company || '.',
                 'ESG columns detected: {_detected_keys()}.',
                 {_HL_TXT}) AS text_summary
FROM summ)"""
DATA_SUMMARY = with_ctes(PANEL, SUMMARY_CTE) + " SELECT * FROM summ_txt"


def _cell(c: str) -> str:
    if c in ("company", "industry", "country"):
        return f"COALESCE(CAST({c} AS VARCHAR), 'None')"
    return f"COALESCE(CAST({c} AS VARCHAR), 'nan')"


_SAMPLE = " || ' | ' || ".join(f"'{c}: ' || {_cell(c)}" for c in PANEL_USER_COLUMNS)
PROFILE_TEXT_CTE = f"""
first_row AS (SELECT company, arg_min({_SAMPLE}, _row_id) AS sample FROM panel WHERE company IS NOT NULL GROUP BY company),
ptext AS (SELECT s.company, 'Columns: {', '.join(PANEL_USER_COLUMNS)}. Row count: ' || CAST(s.row_count AS VARCHAR) || '. '
                 || s.text_summary || chr(10) || 'Sample record: ' || f.sample AS profile_text
          FROM summ_txt s JOIN first_row f ON s.company = f.company)"""
PROFILE_TEXT = with_ctes(PANEL, SUMMARY_CTE, PROFILE_TEXT_CTE) + " SELECT * FROM ptext"

DATA_PROFILE = with_ctes(PANEL, SUMMARY_CTE, PROFILE_TEXT_CTE) + f""",
ex AS (
SELECT company,
       TRY_CAST(replace({_first_capture_sql('low', fixed.EMPLOYEE_PATTERNS)}, ',', '') AS BIGINT) AS employee_count,
       {_BUDGET} AS budget,
       {_contained_sql('low', fixed.TEXT_INDUSTRIES)} AS industry,
       {_contained_sql('low', fixed.TEXT_COUNTRIES)} AS country
FROM (SELECT company, lower(profile_text) AS low FROM ptext)),
filled AS (
SELECT company, rtrim({_MISSING}, ',') AS missing_fields,
       COALESCE(employee_count, {fixed.FORM_DEFAULTS['employee_count']}) AS employee_count,
       COALESCE(budget, {fixed.FORM_DEFAULTS['budget']}e0) AS budget, industry, country
FROM ex)
SELECT *, CASE WHEN employee_count >= 250 THEN 'Large' WHEN employee_count >= 50 THEN 'Medium' ELSE 'Small' END AS business_size
FROM filled"""

# ----------------------------------------------------------------- ad-hoc SQL, stream, CSV, sheets
def adhoc_sql(body: str) -> str:
    return with_ctes(PANEL, "\ncompany_data AS (SELECT * EXCLUDE (_row_id) FROM panel)") + " " + body


STREAM_ROUTE = f"""
SELECT conv_id, turn, {_INTENT} AS intent, {_scrub_sql('text')} AS question_scrubbed
FROM (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user')"""

CSV_PEER_COMPARISON = PEER_COMPARISON

_PF = [("Industry", "COALESCE(industry, 'N/A')"), ("Country", "COALESCE(country, 'N/A')"),
       ("Employees", "COALESCE(CAST(employee_count AS VARCHAR), 'N/A')"),
       ("ESG Budget", "'$' || " + money0_sql("COALESCE(budget, 0e0)")),
       ("Business Size", "COALESCE(business_size, 'N/A')"),
       ("ESG Grade", GRADE.format(x="m_overall")), ("Overall Score", "CAST(m_overall AS VARCHAR)"),
       ("Environmental", "CAST(m_environmental AS VARCHAR)"), ("Social", "CAST(m_social AS VARCHAR)"),
       ("Governance", "CAST(m_governance AS VARCHAR)")]
PROFILE_SHEET = CTX + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT company, {i + 1} AS field_ord, {q(f)} AS field, {v} AS value FROM cm" for i, (f, v) in enumerate(_PF)) + ")"

REPORT_TOP_ACTIONS = SOL_CTX + f"""
SELECT company, rank, name, category, '$' || {thousands_sql('avg_cost')} || 'K' AS investment_display,
       printf('%.1f yrs', payback_years) AS payback_display
FROM ranked WHERE rank <= 3"""

REPORT_FRAMEWORKS = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN) + """
SELECT company, CAST(pos - 1 AS INTEGER) AS pos, frameworks[pos] AS framework
FROM creg, (SELECT unnest(range(1, 10)) AS pos) p WHERE pos <= len(frameworks) AND pos <= 4"""

KEY_METRICS = with_ctes(PANEL, f"""
kcast AS (SELECT company, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PANEL_NUMERIC)} FROM panel
          WHERE company IS NOT NULL),
klong AS (SELECT company, column_name, value FROM kcast UNPIVOT (value FOR column_name IN ({', '.join(PANEL_NUMERIC)})))""") + f"""
SELECT company, column_name, {R('MIN(value)', 2)} AS min_val, {R('MAX(value)', 2)} AS max_val,
       {R('AVG(value)', 2)} AS mean_val, {R('quantile_cont(value, 0.5)', 2)} AS median_val
FROM klong GROUP BY company, column_name"""

TREND_SERIES = with_ctes(PANEL, _MLONG) + """
SELECT company, metric, CAST(ROW_NUMBER() OVER (PARTITION BY company, metric ORDER BY year NULLS LAST, _row_id) - 1 AS BIGINT) AS pos,
       CAST(year AS BIGINT) AS year, value
FROM mlong WHERE value IS NOT NULL"""

DQ_FEW_ROWS = with_ctes(PANEL) + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, 'Dataset has fewer than 2 rows – results may be unreliable.' AS message "
    f"FROM (SELECT COUNT(*) AS n FROM (SELECT 1 FROM {t} LIMIT 2)) WHERE n < 2" for t in QUALITY_TABLES) + ")"

_ACTION = ("printf('(%d) %s – estimated $%s investment, $%s/yr savings, %.1f-year payback.', rank, name, "
           + money0_sql("avg_cost") + ", " + money0_sql("annual_savings") + ", payback_years)")
EXECUTIVE_SUMMARY = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN, SOL_CTE) + f""",
acts AS (SELECT company, string_agg({_ACTION}, chr(10) ORDER BY rank) AS actions FROM ranked WHERE rank <= 3 GROUP BY company)
SELECT c.company,
  'Your organisation currently holds an ESG maturity grade of ' || {GRADE.format(x='c.m_overall')} || ' (' || CAST(c.m_overall AS VARCHAR)
  || '/100), positioning it in the ' || CASE WHEN c.m_overall >= 60 THEN 'upper' ELSE 'lower' END || ' tier of '
  || lower(c.industry) || ' sector peers.' || chr(10) || chr(10) || 'Three priority actions are recommended:' || chr(10)
  || COALESCE(a.actions, '') || chr(10) || chr(10) || 'Regulatory exposure: ' || array_to_string(list_slice(c.frameworks, 1, 2), ', ')
  || ' create compliance obligations. ' || c.key_deadlines || chr(10) || chr(10) || 'Recommendation: Allocate $'
  || {money0_sql('COALESCE(c.budget, 0e0) * 0.6e0')} || ' to the top-ranked solution immediately, phasing remaining initiatives over 18-24 months to stay ahead of '
  || c.country || ' disclosure deadlines.' AS executive_summary
FROM creg c LEFT JOIN acts a ON c.company = a.company"""

PREVIEW_ROWS = with_ctes(PANEL) + " SELECT * EXCLUDE (_row_id) FROM panel ORDER BY _row_id LIMIT 10"

# No company column -> the whole table is one group ('ALL'); its latest
# row is the one a sort by year puts last.
TABLE_SCORE = with_ctes(PANEL, """
latest AS (SELECT * FROM panel ORDER BY year IS NULL DESC, year DESC, _row_id DESC LIMIT 1)""", SCORED) + f"""
SELECT 'ALL' AS company, year, environmental, social, governance, esg_score, {GRADE.format(x='esg_score')} AS grade
FROM scored"""

KPI_TOP_SOLUTION = KPI_CTX + " SELECT company, solution, kpi_ord, kpi, current, projected, improvement_pct FROM kpis WHERE rank = 1"

PROMPT_CONTEXT = with_ctes(PANEL, SUMMARY_CTE) + f"""
SELECT company, substring(text_summary, 1, {fixed.PROMPT_CAPS['narrative']}) AS narrative_context,
       substring(text_summary, 1, {fixed.PROMPT_CAPS['risks']}) AS risks_context,
       substring(text_summary, 1, {fixed.PROMPT_CAPS['solutions']}) AS solutions_context,
       substring(text_summary, 1, {fixed.PROMPT_CAPS['what_if']}) AS what_if_context
FROM summ_txt"""

WHATIF_CONTEXT = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN, SOL_CTE) + f""",
sols AS (SELECT company, CAST(to_json(list({{'name': name, 'category': category,
            'cost_range': '$' || {thousands_sql('upfront_cost_low')} || 'K–$' || {thousands_sql('upfront_cost_high')} || 'K',
            'annual_savings': '$' || {thousands_sql('annual_savings')} || 'K/yr', 'payback_years': payback_years}}
            ORDER BY rank)) AS VARCHAR) AS solutions_json
         FROM ranked GROUP BY company)
SELECT c.company,
       CAST(to_json({{'employee_count': c.employee_count, 'budget': c.budget, 'industry': c.industry,
                 'country': c.country, 'business_size': c.business_size}}) AS VARCHAR) AS profile_json,
       s.solutions_json,
       CAST(to_json({{'frameworks': c.frameworks[1:3], 'key_deadlines': c.key_deadlines, 'penalties': c.penalties}}) AS VARCHAR)
         AS regulatory_json
FROM creg c JOIN sols s ON c.company = s.company"""

_WHOLE_HL = ", ".join(
    f"CASE WHEN mn_{c} IS NOT NULL THEN '{t}: mean=' || CAST({R(f'av_{c}', 2)} AS VARCHAR) || ', range [' || "
    f"CAST({R(f'mn_{c}', 2)} AS VARCHAR) || ', ' || CAST({R(f'mx_{c}', 2)} AS VARCHAR) || '].' END"
    for c, t in _HL)
TABLE_SUMMARY = with_ctes(PANEL) + f""",
first5 AS (SELECT string_agg(company, ', ' ORDER BY first_row) AS names, COUNT(*) AS nn FROM (
  SELECT company, MIN(_row_id) AS first_row FROM panel WHERE company IS NOT NULL GROUP BY company
  ORDER BY first_row LIMIT 5)),
st AS (SELECT COUNT(*) AS row_count, CAST({len(PANEL_USER_COLUMNS)} AS BIGINT) AS col_count,
  {R(f'(1e0 - SUM({_NULLS}) / (COUNT(*) * {float(len(PANEL_USER_COLUMNS))}e0)) * 100e0')} AS completeness_pct,
  CAST(MIN(year) AS BIGINT) AS year_min, CAST(MAX(year) AS BIGINT) AS year_max, {_HL_AGGS} FROM panel)
SELECT row_count, col_count, completeness_pct,
  concat_ws(' ', printf('Dataset: %d rows, %d columns.', row_count, col_count),
            'Completeness: ' || CAST(completeness_pct AS VARCHAR) || '%.',
            CASE WHEN year_min IS NOT NULL THEN printf('Year range: %d-%d.', year_min, year_max) END,
            CASE WHEN nn > 0 THEN 'Companies: ' || names || '.' END,
            'ESG columns detected: {_detected_keys()}.', {_WHOLE_HL}) AS text_summary
FROM st, first5"""

# ----------------------------------------------------------------- filled texts
def _fill_sql(template: str, slots: dict[str, str]) -> str:
    out = q(template)
    for name, value in slots.items():
        if "{" + name + "}" in template:
            out = f"replace({out}, '{{{name}}}', {value})"
    return out


_WD = fixed.WHATIF_DEFAULTS
_WHOLE = "printf('%,d', CAST({} AS BIGINT))".format
_EMP0, _BUD0 = "COALESCE(employee_count, 0)", "COALESCE(budget, 0e0)"
_ADOPT = "(CASE WHEN business_size = 'Large' THEN 2.5e0 ELSE 1e0 END)"
_SLOTS = {
    "size": f"COALESCE(business_size, {q(_WD['size'])})", "industry": f"COALESCE(industry, {q(_WD['industry'])})",
    "employees": _WHOLE(_EMP0), "budget": money0_sql(_BUD0), "budget_up": money0_sql(f"{_BUD0} * 1.2e0"),
    "budget_down": money0_sql(f"{_BUD0} * 0.8e0"),
    "first_framework": f"COALESCE(frameworks[1], {q(_WD['first_framework'])})",
    "first_standard": f"COALESCE(frameworks[1], {q(_WD['first_standard'])})",
    "two_frameworks": "array_to_string(frameworks[1:2], ', ')", "deadlines": "key_deadlines", "penalties": "penalties",
    "fte": f"CAST(GREATEST(1, CASE WHEN {_EMP0} = 0 THEN 10 ELSE {_EMP0} END // 50) AS VARCHAR)",
    "attrition": _WHOLE(f"{_EMP0} * 200"), "cost_low": money0_sql(f"8000e0 * {_ADOPT}"),
    "cost_high": money0_sql(f"30000e0 * {_ADOPT}"), "credit_low": _WHOLE(f"{_EMP0} * 50"),
    "credit_high": _WHOLE(f"{_EMP0} * 150")}
WHATIF_ANSWERS = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN) + " " + " UNION ALL ".join(
    f"SELECT company, {q(k)} AS intent, {_fill_sql(t, _SLOTS)} AS answer FROM creg" for k, t in fixed.WHATIF_ANSWERS.items())


def _data_sql(lead: str, purpose: str) -> str:
    return f"CASE WHEN length(text_summary) > 0 THEN {q(lead)} || substring(text_summary, 1, {fixed.PROMPT_CAPS[purpose]}) || chr(10) ELSE '' END"


_PSLOTS = {
    "industry": "COALESCE(industry, 'N/A')", "country": "COALESCE(country, 'N/A')",
    "business_size": "COALESCE(business_size, 'N/A')", "employees": _WHOLE(_EMP0), "budget": money0_sql(_BUD0),
    **{c: f"CAST(m_{c} AS VARCHAR)" for c in ("overall", "environmental", "social", "governance")},
    "grade": GRADE.format(x="m_overall"), "solutions": "top3", "frameworks": "array_to_string(frameworks, ', ')",
    "three_frameworks": "array_to_string(frameworks[1:3], ', ')", "deadlines": "key_deadlines", "regulator": "regulator",
    "insights": _data_sql("\nData insights: ", "narrative"), "risk_data": _data_sql("\nData characteristics:\n", "risks"),
    "solution_data": _data_sql("\nData characteristics:\n", "solutions")}
PROMPTS = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN, SOL_CTE, SUMMARY_CTE) + """,
best AS (SELECT company, string_agg(name, ', ' ORDER BY rank) AS top3 FROM ranked WHERE rank <= 3 GROUP BY company),
p AS (SELECT c.*, b.top3, s.text_summary FROM creg c JOIN best b ON c.company = b.company
      JOIN summ_txt s ON c.company = s.company)
SELECT company, """ + ", ".join(f"{_fill_sql(t, _PSLOTS)} AS {k}_prompt" for k, t in fixed.PROMPTS.items()) + " FROM p"

# ----------------------------------------------------------------- display, sheets, report sections
MARKED_COMPANY = "Supplier#000000001"
PEER_TABLE = BASE + f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY esg_score DESC, company ASC) AS BIGINT) AS "Rank", company AS "Company",
       esg_score AS "ESG Score", {GRADE.format(x='esg_score')} AS "Grade", environmental AS "Environmental",
       social AS "Social", governance AS "Governance", {R('CAST(employees AS DOUBLE)')} AS "Employees",
       {R('carbon_emissions')} AS "Carbon Emissions", {R('renewable_energy')} AS "Renewable Energy",
       {R('gender_diversity')} AS "Gender Diversity", {R('board_independence')} AS "Board Independence",
       {R('waste_recycled')} AS "Waste Recycled", company = {q(MARKED_COMPANY)} AS is_selected
FROM scored WHERE (SELECT COUNT(*) FROM scored) >= 2"""
SOLUTIONS_SHEET = SOL_CTX + """
SELECT company, rank AS "Rank", name AS "Solution", category AS "Category", fit_score AS "Fit Score",
       upfront_cost_low AS "Cost Low ($)", upfront_cost_high AS "Cost High ($)", annual_savings AS "Annual Savings ($)",
       payback_years AS "Payback (yrs)" FROM ranked"""
REPORT_REGULATION = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN) + """
SELECT company, COALESCE(key_deadlines, 'N/A') AS key_deadlines, COALESCE(regulator, 'N/A') AS regulator,
       COALESCE(penalties, 'N/A') AS penalties FROM creg"""
REPORT_QUALITY = with_ctes(PANEL, SUMMARY_CTE) + f"""
SELECT company, printf('Dataset: %d rows, %d columns. ', row_count, col_count) || 'Completeness: '
       || CAST(completeness_pct AS VARCHAR) || '%. '
       || COALESCE(CASE WHEN year_min IS NOT NULL THEN printf('Year range: %d-%d. ', year_min, year_max) END, '') AS quality,
       'ESG columns auto-detected: {_detected_keys()}.' AS detected FROM summ"""
REPORT_DEFAULTS = CTX + " SELECT company, " + ", ".join(
    f"CASE WHEN employee_count % 3 = 0 THEN 50e0 ELSE {c} END AS {c}"
    for c in ("m_overall", "m_environmental", "m_social", "m_governance")) + f""",
  CASE WHEN employee_count % 3 = 0 THEN 'C' ELSE {GRADE.format(x='m_overall')} END AS m_grade FROM cm"""
REPORT_NO_REGULATION = with_ctes(PANEL, PROFILES, COMPLETENESS, MATURITY_CTE, REG_JOIN) + """
SELECT company, CASE WHEN employee_count % 3 = 1 THEN '' ELSE array_to_string(frameworks, ' | ') END AS frameworks, """ + ", ".join(
    f"CASE WHEN employee_count % 3 = 1 THEN 'N/A' ELSE {c} END AS {c}" for c in ("key_deadlines", "penalties", "regulator")) + " FROM creg"

_USER_TABLES = {**DETECT_TABLES, "panel": PANEL_USER_COLUMNS}
_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS n_rows, COUNT({c}) AS n_values FROM {t}"
    for t, cols in _USER_TABLES.items() for c in cols)
DETECTED_VALUES = with_ctes(PANEL) + f""", picked AS ({COLUMN_DETECT.strip()}), held AS ({_COUNTS})
SELECT p.table_name, p.metric, p.column_name, h.n_rows, h.n_values FROM picked p
JOIN held h ON p.table_name = h.table_name AND p.column_name = h.column_name"""

KPI_SHEET = KPI_CTX + """
SELECT company, solution AS "Solution", kpi AS "KPI", current AS "Current", projected AS "Projected",
       improvement_pct AS "Improvement_Pct" FROM kpis"""
BENCHMARK_SHEET = BENCH_CTX + """
SELECT company, metric AS "Metric", company_value AS "Company_Value", industry_avg AS "Industry_Avg",
       top_quartile AS "Top_Quartile", gap AS "Gap", status AS "Status" FROM bench2"""


def _sheet_total(sql: str, sheet: str, figure: str) -> str:
    return (f"SELECT company, {q(sheet)} AS sheet, COUNT(*) AS n_rows, ROUND(SUM(CAST({figure} AS DOUBLE)), 4) AS total "
            f"FROM ({sql}) GROUP BY company")


WORKBOOK = " UNION ALL ".join([
    _sheet_total(PROFILE_SHEET, "Profile & Maturity", "length(value)"), _sheet_total(SOLUTIONS_SHEET, "Solutions", '"Fit Score"'),
    _sheet_total(KPI_SHEET, "KPI Projections", '"Projected"'), _sheet_total(BENCHMARK_SHEET, "Benchmarks", '"Gap"')])


def risk_replies() -> str:
    from verdant.plans.composed import RISK_REPLY  # which imports this module
    good = """SELECT company, 'risk' AS kind, CAST(1 AS BIGINT) AS ord, 'supply of ' || company AS title, 'd' AS description, 'High' AS level,
       FALSE AS from_template FROM made WHERE k IN (0, 1)
UNION ALL SELECT company, 'risk', 2, 'second', '', 'Low', FALSE FROM made WHERE k IN (0, 1)
UNION ALL SELECT company, 'opportunity', 1, 'growth', 'more', 'Medium', FALSE FROM made WHERE k IN (0, 1)"""
    n = RISK_REPLY.split(" % ")[1].split()[0]
    return RISK_CTX + f""", made AS (SELECT s_name AS company, s_suppkey % {n} AS k FROM supplier)
{good}
UNION ALL SELECT ro.*, TRUE FROM ro JOIN made ON ro.company = made.company WHERE k NOT IN (0, 1, 3)"""


def _csv_dirty() -> str:
    names = [("c_name", "c_mktsegment"), ("c_name || chr(10) || 'line two'", "c_mktsegment"), None, ("c_name", "NULL"),
             ("'say \"' || c_name || '\", ok'", "c_mktsegment"), ("NULL", "c_mktsegment"),
             ("'a' || chr(10) || chr(10) || ',b'", "c_mktsegment")]
    return " UNION ALL ".join(
        f"SELECT c_custkey AS id, {p[0]} AS name, {p[1]} AS segment, "
        f"{'NULL' if k in (3, 5) else 'CAST(c_acctbal AS DOUBLE)'} AS balance FROM customer WHERE c_custkey % {len(names)} = {k}"
        for k, p in enumerate(names) if p)


CSV_DIRTY = _csv_dirty()
