"""Ad-hoc SQL over a table called ``company_data``; any failure, when the
query is analysed or when it runs, is raised as one error type. Spark SQL
covers the query classes (Q1): joins of every kind, grouping sets / rollup /
cube, window frames, set operations, subqueries.

The table is bound to its own statement: no view of the session is made, so
queries over different tables can be built and run in any order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame


class QueryError(RuntimeError):
    pass


@contextmanager
def query_errors() -> Iterator[None]:
    """Spark's errors as ``QueryError``: put the actions on a query's result in it."""
    try:
        yield
    except (PySparkException, ValueError) as e:
        raise QueryError(f"SQL query failed: {e}") from e


#: Comments and blanks before a statement, and its WITH.
_LEAD = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)
_WITH = re.compile(r"WITH\b(\s+RECURSIVE\b)?", re.I)


def query_with_sql(df: DataFrame, sql: str, name: str = "company_data") -> DataFrame:
    """The result of ``sql`` in which ``name`` stands for ``df``."""
    body = sql[_LEAD.match(sql).end():]
    own = _WITH.match(body)
    recursive = own[1] or "" if own else ""
    rest = f", {body[own.end():]}" if own else f" {body}"
    braced = rest.replace("{", "{{").replace("}", "}}")  # braces stand for bound tables
    with query_errors():
        return df.sparkSession.sql(f"WITH{recursive} {name} AS (SELECT * FROM {{bound}}){braced}", bound=df)


def run_sql(df: DataFrame, sql: str, action: Callable[[DataFrame], Any], name: str = "company_data") -> Any:
    """``action`` on the result of ``query_with_sql``; its failures are ``QueryError`` too."""
    result = query_with_sql(df, sql, name)
    with query_errors():
        return action(result)


# Smoke queries, one per class; the same text runs on DuckDB over the same view.
SMOKE = {
    "sql_join": """
SELECT r.r_name AS region, COUNT(DISTINCT cd.company) AS n_companies,
       CAST(SUM(CAST(cd.revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM company_data cd
JOIN supplier s ON cd.company = s.s_name
JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE EXISTS (SELECT 1 FROM company_data x WHERE x.company = cd.company AND x.year = 1998)
  AND NOT EXISTS (SELECT 1 FROM company_data z WHERE z.company = cd.company AND z.gender_diversity > 40)
GROUP BY r.r_name""",
    "sql_rollup": """
SELECT industry, country, COUNT(*) AS n_rows, CAST(SUM(employees) AS BIGINT) AS employees,
       CAST(GROUPING(industry) AS INT) AS g_industry, CAST(GROUPING(country) AS INT) AS g_country
FROM company_data
GROUP BY ROLLUP (industry, country)""",
    "sql_window": """
SELECT company, year, revenue,
       CAST(SUM(CAST(revenue AS DECIMAL(18,2))) OVER (PARTITION BY company ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_revenue,
       LAG(employees, 1) OVER (PARTITION BY company ORDER BY year) AS prev_employees,
       CAST(RANK() OVER (PARTITION BY company ORDER BY employees DESC) AS BIGINT) AS employee_rank,
       MAX(training) OVER (PARTITION BY company ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS training_max_3y
FROM company_data""",
    "sql_setop": """
SELECT company, 'all_years' AS tag FROM (
  SELECT company FROM company_data WHERE year = 1995
  INTERSECT
  SELECT company FROM company_data WHERE year = 2001)
UNION ALL
SELECT company, 'not_1998' FROM (
  SELECT company FROM company_data
  EXCEPT
  SELECT company FROM company_data WHERE year = 1998)""",
    "sql_subquery": """
SELECT company, year, revenue
FROM company_data cd
WHERE revenue > (SELECT AVG(revenue) FROM company_data x WHERE x.year = cd.year)
  AND year = (SELECT MAX(year) FROM company_data y WHERE y.company = cd.company)""",
}
