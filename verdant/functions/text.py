"""Text column functions (X1, X3-X7, X10): regular expressions and keyword
tests as built-in expressions, evaluated per row inside whole-stage codegen.

Regular expressions run on Java's engine: ``\\d``, ``\\s`` and ``\\b`` are
ASCII classes (Python's are Unicode), a documented difference that matters
only for non-ASCII digits and spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdant import fixed


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- X1
def pii_scrub(text: Column | str, max_chars: int | None = None, local: bool = False) -> Column:
    """Mask e-mails, phone numbers, URLs and IDs, in that order, in the whole
    text; with ``max_chars`` in its first so many code points (the limits of
    prompts are ``fixed.PII_MAX_CHARS`` and ``fixed.PII_MAX_CHARS_LOCAL``).
    ``local=True`` (local model backend) masks nothing."""
    out = _c(text) if max_chars is None else F.substring(_c(text), 1, max_chars)
    if local:
        return out
    for (pattern, marker), need in zip(fixed.PII_RULES, PII_PREFILTERS):
        out = F.when(need(out), F.regexp_replace(out, pattern, marker)).otherwise(out)
    return out


# Cheap tests that must hold for each scrub pattern to match at all (an
# e-mail needs '@', a URL needs '://', a phone number digits, an ID five
# digits in a row); a text failing the test is left as it is, which is what
# the regex would do, only without scanning it.
PII_PREFILTERS = [
    lambda x: F.instr(x, "@") > 0,
    lambda x: x.rlike("[0-9]"),
    lambda x: F.instr(x, "://") > 0,
    lambda x: x.rlike("[0-9]{5}"),
]


# ---------------------------------------------------------------- X3-X6
def _first_capture(text: Column, patterns: list[str], group: int = 1,
                   needs: list[list[str]] | None = None) -> Column:
    """First non-empty capture over the patterns in order. ``needs``: per
    pattern, literals of which one must occur for the pattern to match; the
    regex is skipped otherwise (same result, no scan)."""
    outs = []
    for i, p in enumerate(patterns):
        cap = F.nullif(F.regexp_extract(text, p, group), F.lit(""))
        if needs is not None:
            cond = None
            for lit in needs[i]:
                c = F.instr(text, lit) > 0
                cond = c if cond is None else (cond | c)
            cap = F.when(cond, cap)
        outs.append(cap)
    return F.coalesce(*outs)


# Literals each extraction pattern cannot match without (in pattern order).
EMPLOYEE_NEEDS = [["employees"], ["employee"], ["headcount"], ["staff"], ["workforce"]]
BUDGET_NEEDS = [["budget", "spend", "investment"], ["$"]]


def employee_count(text: Column | str, lowered: bool = False) -> Column:
    """First of the employee patterns that matches (lower-cased text),
    commas removed, as BIGINT. ``lowered``: the text is already lower-case
    (lower-case once in a projection when several extractors share it)."""
    low = _c(text) if lowered else F.lower(_c(text))
    raw = _first_capture(low, fixed.EMPLOYEE_PATTERNS, needs=EMPLOYEE_NEEDS)
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("bigint")


def budget(text: Column | str, lowered: bool = False) -> Column:
    """Budget amount with optional multiplier; a pattern whose amount is
    only commas falls through to the next pattern."""
    low = _c(text) if lowered else F.lower(_c(text))
    mult = F.create_map(*[x for k, v in fixed.BUDGET_MULTIPLIERS.items() for x in (F.lit(k), F.lit(float(v)))])
    value = F.lit(None).cast("double")
    for p, need in reversed(list(zip(fixed.BUDGET_PATTERNS, BUDGET_NEEDS))):
        present = None
        for lit in need:
            c = F.instr(low, lit) > 0
            present = c if present is None else (present | c)
        # The first match only (search semantics), then its groups from the
        # short matched span.
        match = F.when(present, F.regexp_extract(low, p, 0)).otherwise(F.lit(""))
        raw = F.trim(F.replace(F.regexp_extract(match, "^" + p, 1), F.lit(","), F.lit("")))
        unit = F.lower(F.regexp_extract(match, "^" + p, 2))
        amount = raw.try_cast("double") * F.coalesce(F.try_element_at(mult, unit), F.lit(1.0))
        value = F.when(raw != "", amount).otherwise(value)
    return value


def _first_contained(text: Column, names: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.contains(text, F.lit(name)), F.initcap(F.lit(name))).otherwise(out)
    return out


def industry(text: Column | str, lowered: bool = False) -> Column:
    """First listed industry contained in the lower-cased text, title-cased."""
    return _first_contained(_c(text) if lowered else F.lower(_c(text)), fixed.TEXT_INDUSTRIES)


def country(text: Column | str, lowered: bool = False) -> Column:
    """First listed country contained in the lower-cased text, title-cased."""
    return _first_contained(_c(text) if lowered else F.lower(_c(text)), fixed.TEXT_COUNTRIES)


def extract_profile(df, text_col: str, keep: list[str]):
    """X3-X6 on a DataFrame: lower-case the text once in a projection, then
    run the four extractors on that column (a CASE chain would otherwise
    lower-case the text again for every test)."""
    low = df.select(*keep, F.lower(F.col(text_col)).alias("_low"))
    return low.select(*keep, employee_count("_low", True).alias("employee_count"),
                      budget("_low", True).alias("budget"), industry("_low", True).alias("industry"),
                      country("_low", True).alias("country"))


# ---------------------------------------------------------------- X7
def latin1(text: Column | str) -> Column:
    """Typographic replacements, then every code point outside Latin-1 -> '?'.
    The one-to-one replacements run as a single ``translate`` pass, the
    multi-character ones as ``replace`` (outputs are ASCII, so the order of
    the replacements does not matter)."""
    out = _c(text)
    single = [(a, b) for a, b in fixed.LATIN1_REPLACEMENTS if len(b) == 1]
    multi = [(a, b) for a, b in fixed.LATIN1_REPLACEMENTS if len(b) != 1]
    out = F.translate(out, "".join(a for a, _ in single), "".join(b for _, b in single))
    for ch, rep in multi:
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return F.regexp_replace(out, r"[^\x{00}-\x{FF}]", "?")


# ---------------------------------------------------------------- X10
def intent(question: Column | str, lowered: bool = False) -> Column:
    """First keyword group contained in the lower-cased question."""
    low = _c(question) if lowered else F.lower(_c(question))
    out = F.lit(fixed.INTENT_DEFAULT)
    for name, words in reversed(fixed.INTENT_KEYWORDS):
        hit = None
        for w in words:
            h = F.contains(low, F.lit(w))
            hit = h if hit is None else (hit | h)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
