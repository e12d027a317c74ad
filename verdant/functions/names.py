"""Column references by exact name (dots, quotes, blanks and backticks included)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column that keeps row order; not one of the user's.
ROW_ID = "_row_id"


def quoted(name: str) -> str:
    """``name`` as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def user_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c != ROW_ID]
