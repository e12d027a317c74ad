"""Pull the JSON value out of a model reply, and X15: profile merge.

Steps, all built-in expressions: strip code fences and outer whitespace; the
whole text if it is valid JSON; else the span from the first ``{`` to the
last ``}``; else from the first ``[`` to the last ``]``; else null. A failed
extraction is null, not an error.

Validity: ``try_parse_json`` accepts a valid prefix followed by more text
(``{"a":1},{"b":2}``), so a candidate must also parse as exactly one element
when wrapped in ``[...]`` and as one member when wrapped in ``{"v":...}``
(which rejects a stray closing bracket). ``NaN`` and repeated keys are not
valid JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def is_json(x: Column) -> Column:
    one = F.size(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<variant>",
                             {"mode": "PERMISSIVE"}))
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
    return F.coalesce(F.try_parse_json(x).isNotNull() & alone.isNotNull() & (one == 1), F.lit(False))


def strip_fences(text: Column | str) -> Column:
    t = F.regexp_replace(_c(text), r"```(?:json)?\s*", "")
    t = F.replace(t, F.lit("```"), F.lit(""))
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def _span(x: Column, open_ch: str, close_ch: str) -> Column:
    """First ``open_ch`` to last ``close_ch`` (greedy match), or null."""
    pattern = "(?s)\\" + open_ch + ".*\\" + close_ch
    return F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))


def extract_json(text: Column | str) -> Column:
    """The JSON text found in ``text`` (see module doc), or null."""
    cleaned = strip_fences(text)
    obj = _span(cleaned, "{", "}")
    arr = _span(cleaned, "[", "]")
    return (F.when(is_json(cleaned), cleaned)
            .when(obj.isNotNull() & is_json(obj), obj)
            .when(arr.isNotNull() & is_json(arr), arr))


def merge_profile(df: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """Keys present and non-null in the JSON override the row's fields.

    ``fields``: field name -> Spark SQL type."""
    schema = "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"
    parsed = F.from_json(F.col(json_col), schema)
    out = df.withColumn("_parsed", parsed)
    for k, v in fields.items():
        out = out.withColumn(k, F.coalesce(F.col(f"_parsed.{k}"), F.col(k).cast(v)))
    return out.drop("_parsed")
