"""Latest row per company.

Sorting by year and taking the last row (a null year sorts last, so it counts
as the latest; ties keep file order) is the same as the maximum of one
order-preserving key packed from (year is null, year, row id). The maximum is
a hash aggregation with map-side partials over numbers only, so a company
holding a third of all rows is reduced before the shuffle; the row itself is
fetched by its key, never carried through the aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegralType, TimestampNTZType, TimestampType

from verdant.functions.names import named, quoted
from verdant.plans.quantiles import with_ordered_key

ALL_COMPANIES = "ALL"
#: Weight of the year in the packed key, above any row id, and the place of a null year, above any year.
_YEAR_WEIGHT, _NULL_YEAR = "10000000000000000000BD", "9300000000000000000BD"


def company_key(df: DataFrame, col_map: dict) -> DataFrame:
    """Add ``_company``: the mapped company column, or one constant group for
    whole-table mode (no company column). Rows with a null company are
    dropped, as no company name ever equals null."""
    if "company" in col_map:
        return (df.where(named(col_map["company"]).isNotNull())
                  .withColumn("_company", named(col_map["company"]).cast("string")))
    return df.withColumn("_company", F.lit(ALL_COMPANIES))


def with_row_order(df: DataFrame, col_map: dict, row_id: str = "_row_id", name: str = "_order") -> DataFrame:
    """``name``: a key by which the rows sort as by (year is null, year, row
    id), NaN being a null year. A DECIMAL(38, 0) of 19 digits each for the year and the
    row id (0 or more; a hash of the row where there is none) if the year is
    a number or a date; a text year keeps a struct, as its order is that of the text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rid = (f"CAST({quoted(row_id)} AS DECIMAL(19, 0))" if row_id in types
           else f"CAST(xxhash64({', '.join(quoted(c) for c in df.columns)}) & 9223372036854775807L AS DECIMAL(19, 0))")
    if "year" not in col_map:
        return df.withColumn(name, F.expr(f"CAST({rid} AS DECIMAL(38, 0))"))
    kind, year = types[col_map["year"]], quoted(col_map["year"])
    if isinstance(kind, (DoubleType, FloatType)):
        keyed = with_ordered_key(df.withColumn("__year", F.expr(f"CAST({year} AS DOUBLE)")), "__year")
        return keyed.withColumn(name, F.expr(_packed("__key", rid))).drop("__year", "__key")
    number = {IntegralType: f"CAST({year} AS BIGINT)", DateType: f"CAST(unix_date({year}) AS BIGINT)",
              TimestampType: f"unix_micros({year})", TimestampNTZType: f"unix_micros(CAST({year} AS TIMESTAMP))"}
    for of, value in number.items():
        if isinstance(kind, of):
            return df.withColumn(name, F.expr(_packed(value, rid)))
    return df.withColumn(name, F.expr(f"struct({year} IS NULL, {year}, {rid})"))


def _packed(year: str, rid: str) -> str:
    return f"CAST(coalesce(CAST({year} AS DECIMAL(19, 0)), {_NULL_YEAR}) * {_YEAR_WEIGHT} + {rid} AS DECIMAL(38, 0))"


def latest_rows(df: DataFrame, col_map: dict, null_year: str = "keep",
                row_id: str = "_row_id") -> DataFrame:
    """One row per company: the row a sort by year would put last.

    ``null_year="drop"`` ignores rows with a null year instead of treating
    them as the latest."""
    if "year" not in col_map and row_id not in df.columns:
        raise ValueError("latest_rows needs a year column or a row id")
    keyed = company_key(df, col_map)
    if "year" in col_map and null_year == "drop":
        keyed = keyed.where(named(col_map["year"]).isNotNull())
    # The hash names every column, so both uses of the rows ask for the same columns and share their last shuffle.
    keyed = with_row_order(keyed, col_map, row_id).withColumn("_hash", F.xxhash64(*[named(c) for c in df.columns]))
    last = keyed.groupBy("_company").agg(F.max("_order").alias("__o"), F.max_by("_hash", "_order").alias("__h")) \
        .withColumnRenamed("_company", "__c")
    rows = keyed.join(last, (F.col("_company") == F.col("__c")) & (F.col("_order") == F.col("__o"))
                      & (F.col("_hash") == F.col("__h")))
    if row_id not in df.columns:  # the very same row may stand there twice
        rows = rows.dropDuplicates(["_company"])
    return rows.select("_company", *[named(c) for c in df.columns])


def latest_metrics(df: DataFrame, col_map: dict, null_year: str = "keep", row_id: str = "_row_id") -> DataFrame:
    """``_company`` and, under their names, the company, the year and the mapped
    metrics of each company's latest row, the latter as numbers: one hash
    aggregation, no row is fetched."""
    from verdant.operators.score import number_sql
    keyed = company_key(df, col_map)
    if "year" in col_map and null_year == "drop":
        keyed = keyed.where(named(col_map["year"]).isNotNull())
    types = {f.name: f.dataType for f in df.schema.fields}
    # A column stands for itself once, whatever metrics are mapped to it.
    columns = dict.fromkeys(c for m, c in col_map.items() if m not in ("company", "industry", "country") and c in types)
    number = {c: quoted(c) if c == col_map.get("year") and isinstance(types[c], IntegralType) else number_sql(types, c)
              for c in columns}
    latest = with_row_order(keyed, col_map, row_id).groupBy("_company").agg(
        F.max("_order").alias("_last"), *[F.expr(f"max_by({v}, _order) AS {quoted(c)}") for c, v in number.items()])
    name = [F.col("_company").alias(col_map["company"])] if "company" in col_map else []
    return latest.select("_company", *name, *[named(c) for c in number])
