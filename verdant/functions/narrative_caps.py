"""The per-prompt caps on attached data summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.fixed import PROMPT_CAPS


def cap(text: Column, caps: dict[str, int] | None, kind: str) -> Column:
    """``text``, cut only where ``caps`` has a limit (in code points) for the kind."""
    return text if (caps or {}).get(kind) is None else F.substring(text, 1, caps[kind])


def capped(summary: DataFrame, text_col: str = "text_summary", caps: dict[str, int] | None = None) -> DataFrame:
    """The summary for each kind of prompt: whole, or cut at the limits ``caps``."""
    return summary.select("company", *[cap(F.col(text_col), caps, kind).alias(f"{kind}_context") for kind in PROMPT_CAPS])
