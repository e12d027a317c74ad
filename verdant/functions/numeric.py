"""Column helpers for numbers: rounding, coercion, clamps, grades.

All helpers return Columns built from built-in functions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number written as text: optional sign, digits with optional fraction (or a
# bare fraction), optional exponent; or an infinity. Anything else is null.
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity)$"


def py_round(c: Column | str, digits: int = 1) -> Column:
    """Round half to even on the decimal value, returned as DOUBLE.

    Casting to DECIMAL(38,8) first makes the tie test exact (64.25 -> 64.2),
    which is what a half-even round of a short decimal gives.
    """
    col = F.col(c) if isinstance(c, str) else c
    # try_cast: NaN, infinities and magnitudes beyond DECIMAL(38,8) keep their
    # value (such doubles have no fractional digits left to round).
    return F.coalesce(F.bround(col.try_cast("decimal(38,8)"), digits).cast("double"), col.cast("double"))


def py_round_sql(expr: str, digits: int = 1) -> str:
    """``py_round`` as SQL text."""
    return (f"coalesce(CAST(bround(try_cast(({expr}) AS DECIMAL(38,8)), {digits}) AS DOUBLE), "
            f"CAST(({expr}) AS DOUBLE))")


def to_num(c: Column | str) -> Column:
    """Coerce a value to DOUBLE; text that is not a plain number becomes null."""
    col = F.col(c) if isinstance(c, str) else c
    txt = F.trim(col.cast("string"))
    return F.when(F.lower(txt).rlike(NUMERIC_TEXT), txt.try_cast("double"))


def grade(score: Column) -> Column:
    return (F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C")
            .when(score >= 35, "D").otherwise("F"))


def weighted_overall(e: Column, s: Column, g: Column) -> Column:
    return py_round(e * F.lit(0.4) + s * F.lit(0.3) + g * F.lit(0.3), 1)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so ``body`` can use it many times
    without copying its expression tree (keeps generated code small)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_float_str(x: Column) -> Column:
    """DOUBLE -> text the way Python's ``repr(float)`` writes it (fixed
    notation for decimal exponents -4..15, else ``1.5e-05`` / ``1e+16``),
    built from Spark's shortest-digits cast plus string arithmetic."""
    def parse(s):
        body = F.regexp_replace(s, "^-", "")
        has_e = F.contains(body, F.lit("E"))
        mant = F.when(has_e, F.substring_index(body, "E", 1)).otherwise(body)
        exp = F.when(has_e, F.substring_index(body, "E", -1).cast("int")).otherwise(F.lit(0))
        int_part = F.substring_index(mant, ".", 1)
        frac = F.when(F.contains(mant, F.lit(".")), F.substring_index(mant, ".", -1)).otherwise(F.lit(""))
        return F.struct(F.startswith(s, F.lit("-")).alias("neg"), int_part.alias("ip"), frac.alias("fr"),
                        exp.alias("ex"))

    def digits(p):
        all_digits = F.concat(p["ip"], p["fr"])
        lz = F.length(F.regexp_extract(all_digits, "^0*", 0))
        d = F.regexp_replace(F.regexp_replace(all_digits, "^0+", ""), "0+$", "")
        return F.struct(p["neg"].alias("neg"), d.alias("d"), (F.length(p["ip"]) + p["ex"] - lz).alias("pos"))

    def render(q):
        d, pos = q["d"], q["pos"]          # value = 0.d * 10^pos
        nd = F.length(d)
        e10 = pos - 1
        zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
        fixed_txt = (F.when(pos <= 0, F.concat(F.lit("0."), zeros(-pos), d))
                     .when(pos >= nd, F.concat(d, zeros(pos - nd), F.lit(".0")))
                     .otherwise(F.concat(F.substr(d, F.lit(1), pos), F.lit("."),
                                         F.substr(d, pos + 1, nd - pos))))
        sci_txt = F.concat(F.substr(d, F.lit(1), F.lit(1)),
                           F.when(nd > 1, F.concat(F.lit("."), F.substr(d, F.lit(2), nd - 1))).otherwise(F.lit("")),
                           F.lit("e"), F.when(e10 >= 0, F.lit("+")).otherwise(F.lit("-")),
                           F.when(F.abs(e10) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e10).cast("string"))
        txt = F.when(nd == 0, F.lit("0.0")).when((e10 >= -4) & (e10 < 16), fixed_txt).otherwise(sci_txt)
        return F.concat(F.when(q["neg"], F.lit("-")).otherwise(F.lit("")), txt)

    txt = let(x.cast("string"), lambda s: let(parse(s), lambda p: let(digits(p), render)))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(txt))


_PY_FLOAT_SQL = """CASE WHEN ({x}) IS NULL THEN CAST(NULL AS STRING)
 WHEN isnan({x}) THEN 'nan' WHEN ({x}) = double('inf') THEN 'inf' WHEN ({x}) = double('-inf') THEN '-inf'
 ELSE element_at(transform(array(CAST(({x}) AS STRING)), s ->
  element_at(transform(array(named_struct(
     'neg', startswith(s, '-'),
     'ip', substring_index(CASE WHEN instr(s, 'E') > 0 THEN substring_index(regexp_replace(s, '^-', ''), 'E', 1)
                                ELSE regexp_replace(s, '^-', '') END, '.', 1),
     'fr', CASE WHEN instr(s, '.') > 0 THEN substring_index(CASE WHEN instr(s, 'E') > 0
                THEN substring_index(s, 'E', 1) ELSE s END, '.', -1) ELSE '' END,
     'ex', CASE WHEN instr(s, 'E') > 0 THEN CAST(substring_index(s, 'E', -1) AS INT) ELSE 0 END)), p ->
   element_at(transform(array(named_struct(
      'neg', p.neg,
      'd', regexp_replace(regexp_replace(concat(p.ip, p.fr), '^0+', ''), '0+$', ''),
      'pos', length(p.ip) + p.ex - length(regexp_extract(concat(p.ip, p.fr), '^0*', 0)))), q ->
    concat(CASE WHEN q.neg THEN '-' ELSE '' END,
     CASE WHEN length(q.d) = 0 THEN '0.0'
          WHEN q.pos - 1 >= -4 AND q.pos - 1 < 16 THEN
            CASE WHEN q.pos <= 0 THEN concat('0.', repeat('0', -q.pos), q.d)
                 WHEN q.pos >= length(q.d) THEN concat(q.d, repeat('0', q.pos - length(q.d)), '.0')
                 ELSE concat(substr(q.d, 1, q.pos), '.', substr(q.d, q.pos + 1)) END
          ELSE concat(substr(q.d, 1, 1), CASE WHEN length(q.d) > 1 THEN concat('.', substr(q.d, 2)) ELSE '' END,
                      'e', CASE WHEN q.pos - 1 >= 0 THEN '+' ELSE '-' END,
                      CASE WHEN abs(q.pos - 1) < 10 THEN '0' ELSE '' END, CAST(abs(q.pos - 1) AS STRING)) END)
   ), 1)), 1)), 1) END"""


def py_float_str_sql(x: str) -> str:
    """``py_float_str`` as SQL text over a DOUBLE expression ``x`` (one JVM
    call to build, however many times it is used)."""
    return _PY_FLOAT_SQL.format(x=f"CAST(({x}) AS DOUBLE)")
