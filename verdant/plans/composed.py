"""Queries on rows composed from the given tables so that every branch of the
text, reply and quality operators occurs: the sentence, reply or defect of a row
depends on its key. The composing SQL is shared by Spark and DuckDB; what is
compared is what the operators make of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import fixed
from verdant.plans import oracle_sql as O
from verdant.sources.tables import read_table

ALL: dict[str, tuple] = {}


def composed(table: str, select: list[str], sql: str):
    """Register a query on ``select`` over ``table``, given to the function as
    a DataFrame and to the oracle as the view ``made``."""
    def deco(fn):
        def run(spark, sf_dir):
            return fn(read_table(spark, sf_dir, table).selectExpr(*select))
        ALL[fn.__name__] = (run, f"WITH made AS (SELECT {', '.join(select)} FROM {table})" + sql)
        return fn
    return deco


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _on_made(sql: str, table: str) -> str:
    """An oracle over ``table`` put on the composed rows; keeps its WITH list."""
    sql = sql.strip().replace(f"FROM {table}", "FROM made")
    return ", " + sql[len("WITH "):] if sql.startswith("WITH ") else " " + sql


# ---------------------------------------------------------------- X3-X6, V7, V8
_K = "CAST(s_suppkey AS STRING)"
_INDUSTRY = _pick("s_suppkey", [O.q(x.title()) for x in fixed.TEXT_INDUSTRIES])
_COUNTRY = _pick("s_suppkey", [O.q(x.title()) for x in fixed.TEXT_COUNTRIES])
_SENTENCE = _pick("s_suppkey", [
    f"concat(s_name, ' has 1,', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0'), ' employees in ', {_COUNTRY}, '; budget: $', {_K}, 'k for ', {_INDUSTRY}, '.')",
    f"concat('Headcount: ', {_K}, '. We are a ', {_INDUSTRY}, ' firm based in ', {_COUNTRY}, '. Budget ', {_K}, ' million.')",
    f"concat('Staff of ', CAST(s_suppkey - 2 AS STRING), ', willing to spend $', {_K}, '.5 thousand on ', upper({_INDUSTRY}), '.')",
    f"concat('Workforce: ', {_K}, ' in ', {_COUNTRY}, '.')",
    f"concat('Employee count: ', {_K}, ', we hold $', {_K}, 'm; investment: ,,')",
    "'No figures are known.'",
    "CAST(NULL AS STRING)",
])
_SUPPLIER_TEXT = ["s_suppkey AS doc_id", f"{_SENTENCE} AS text"]


@composed("supplier", _SUPPLIER_TEXT, _on_made(O.PROFILE_EXTRACT, "documents"))
def profile_sentences(made: DataFrame) -> DataFrame:
    from verdant.functions.text import extract_profile
    return extract_profile(made, "text", ["doc_id"])


@composed("supplier", _SUPPLIER_TEXT, _on_made(O.MISSING_FIELDS, "documents"))
def profile_form(made: DataFrame) -> DataFrame:
    from verdant.functions.text import extract_profile
    from verdant.operators.quality import profile_form_view
    return profile_form_view(extract_profile(made, "text", ["doc_id"]))


# ---------------------------------------------------------------- X7
_CHARS = _pick("c_custkey", [O.q(a) for a, _ in fixed.LATIN1_REPLACEMENTS] + [O.q(x) for x in ("漢", "é", "🙂", "x")])


@composed("customer", ["c_custkey AS doc_id", f"concat(c_name, ' ', {_CHARS}, c_mktsegment, {_CHARS}) AS text"],
          _on_made(O.LATIN1, "documents"))
def latin1_names(made: DataFrame) -> DataFrame:
    from verdant.functions.text import latin1
    return made.select("doc_id", latin1("text").alias("text_latin1"))


# ---------------------------------------------------------------- X1
_C = "CAST(c_custkey AS STRING)"
_CONTACT = _pick("c_custkey", [
    f"concat('write to buyer.', {_C}, '@mail.example.org now')",
    "concat('call +49 171 555 ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' today')",
    f"concat('see https://shop.example.org/c/', {_C}, '?a=b for more')",
    "concat('the ref AB-', lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'), ' is ours')",
    f"concat('a@b.co, https://x.example/', {_C}, ' and XYZ12345')",
    "concat('nothing to hide, ', c_name)",
])


@composed("customer", ["c_custkey AS doc_id", f"{_CONTACT} AS text"], _on_made(O.PII_SCRUB, "documents"))
def pii_contacts(made: DataFrame) -> DataFrame:
    from verdant.functions.text import pii_scrub
    return made.select("doc_id", pii_scrub("text").alias("scrubbed"))


# ---------------------------------------------------------------- X10
_ASK = _pick("p_partkey", [O.q(w) for _, words in fixed.INTENT_KEYWORDS for w in words] + ["'colour'"])


@composed("part", ["p_partkey AS conv_id", "CAST(0 AS BIGINT) AS turn", "'user' AS role",
                   f"concat('About ', p_name, ': ', upper({_ASK}), ' of ', p_brand, '?') AS text"],
          _on_made(O.INTENT_ROUTE, "conversations"))
def intent_questions(made: DataFrame) -> DataFrame:
    from verdant.functions.text import intent
    return made.select("conv_id", "turn", intent("text").alias("intent"))


# ---------------------------------------------------------------- X2, X14, X15 on replies
_E = "CAST(event_id AS STRING)"


def _entry(i: int) -> str:
    return (f"concat('{{\"name\":\"plan {i} of ', {_E}, '\",\"category\":\"', event_type, '\",\"fit_score\":', "
            f"CAST((event_id * {3 * i + 1}) % 7 AS STRING), '}}')")


_LIST = "concat('[', " + ", ',', ".join(_entry(i) for i in range(4)) + ", ']')"
_REPLY = _pick("event_id", [
    "concat('```json', chr(10), props, chr(10), '```')",
    "concat('Sure: ', props, ' and that is all.')",
    _LIST,
    f"concat('Here is the list: ', {_LIST}, ' as asked.')",
    f"concat('[', {_entry(0)}, ',', {_entry(1)}, ']')",
    "concat(props, ']')",
    "'{\"k\": '",
    "CAST(NULL AS STRING)",
    "'I have no answer.'",
])
_REPLIES = ["event_id AS id", "user_id", f"{_REPLY} AS reply"]
_FOUND = f""", c AS (SELECT id, user_id, {O._CLEAN.replace('txt', 'reply')} AS cleaned FROM made),
s AS (SELECT *, NULLIF(regexp_extract(cleaned, '(?s)\\{{.*\\}}', 0), '') AS obj,
             NULLIF(regexp_extract(cleaned, '(?s)\\[.*\\]', 0), '') AS arr FROM c),
found AS (SELECT id, user_id, CASE WHEN json_valid(cleaned) THEN cleaned WHEN obj IS NOT NULL AND json_valid(obj) THEN obj
                           WHEN arr IS NOT NULL AND json_valid(arr) THEN arr END AS j FROM s)"""


@composed("events", _REPLIES, _FOUND + " SELECT id, j AS json_text FROM found")
def json_replies(made: DataFrame) -> DataFrame:
    from verdant.functions.jsonx import extract_json
    return made.select("id", extract_json("reply").alias("json_text"))


_TEMPLATES = [(o, n, c, float(fit)) for o, n, c, *_, fit in fixed.SOLUTIONS]
_RANKING = _FOUND + f""",
judged AS (SELECT id, j, COALESCE(json_type(j) = 'ARRAY' AND json_array_length(j) >= 3, FALSE) AS ok FROM found),
entries AS (SELECT id, i, json_extract_string(j, '$[' || i || '].name') AS name,
                   json_extract_string(j, '$[' || i || '].category') AS category,
                   CAST(COALESCE(json_extract_string(j, '$[' || i || '].fit_score'), '0') AS DOUBLE) AS fit_score
            FROM (SELECT id, j, unnest(range(0, CAST(json_array_length(j) AS BIGINT))) AS i FROM judged WHERE ok))
SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY fit_score DESC, i) AS BIGINT) AS rank, name, category, fit_score,
       FALSE AS from_template FROM entries
UNION ALL
SELECT id, CAST(t.o AS BIGINT), t.name, t.category, t.fit_score, TRUE
FROM judged, {O.values_sql(_TEMPLATES, ['o', 'name', 'category', 'fit_score'])} WHERE NOT ok"""


@composed("events", _REPLIES, _RANKING)
def ranking_replies(made: DataFrame) -> DataFrame:
    from verdant.operators.narrative import validate_ranking
    templates = made.sparkSession.createDataFrame([t[1:] for t in _TEMPLATES], "name string, category string, fit_score double")
    return validate_ranking(made, "reply", templates).drop("entry", "reply", "user_id")


@composed("events", _REPLIES, _FOUND + """
SELECT id, CAST(COALESCE(CASE WHEN json_type(j) = 'OBJECT' THEN TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) END, user_id) AS BIGINT) AS k FROM found""")
def merged_profiles(made: DataFrame) -> DataFrame:
    from verdant.functions.jsonx import extract_json, merge_profile
    rows = made.select("id", F.col("user_id").alias("k"), extract_json("reply").alias("found"))
    return merge_profile(rows, "found", {"k": "bigint"}).drop("found")


# ---------------------------------------------------------------- X14 risk replies (by supplier)
_GOOD = ("concat('{\"risks\": [{\"title\": \"supply of ', s_name, '\", \"description\": \"d\", \"severity\": \"High\"}, 7, "
         "{\"severity\": \"Low\"}, {\"title\": \"second\", \"severity\": \"Low\"}], \"opportunities\": "
         "[{\"title\": \"growth\", \"description\": \"more\", \"impact\": \"Medium\"}]}')")
RISK_REPLY = _pick("s_suppkey", [
    _GOOD,
    f"concat('Here you are:', chr(10), '```json', chr(10), {_GOOD}, chr(10), '```')",
    "'{\"risks\": [{\"title\": \"alone\"}]}'",
    "'{\"risks\": [], \"opportunities\": []}'",
    "'{\"risks\": \"many\", \"opportunities\": []}'",
    "'[{\"title\": \"a list\"}]'",
    "CAST(NULL AS STRING)",
    "'no answer'",
])

# ---------------------------------------------------------------- S1 on a dirty file
CSV_FILES = 3
CSV_DIRTY_HEADER = " id , name,segment , balance "
_K1, _BAL = "CAST(c_custkey AS STRING)", "CAST(c_acctbal AS STRING)"
CSV_DIRTY_LINE = _pick("c_custkey", [
    f"concat({_K1}, ',', c_name, ',', c_mktsegment, ',', {_BAL})",
    f"concat({_K1}, ',\"', c_name, chr(10), 'line two\",', c_mktsegment, ',', {_BAL})",
    f"concat({_K1}, ',', c_name, ',', c_mktsegment, ',', {_BAL}, ',too long')",
    f"concat({_K1}, ',', c_name)",
    f"concat({_K1}, ',\"say \"\"', c_name, '\"\", ok\",', c_mktsegment, ',', {_BAL})",
    f"concat({_K1}, ',n/a,', c_mktsegment, ',NULL')",
    f"concat({_K1}, ',\"a', chr(10), chr(10), ',b\",', c_mktsegment, ',', {_BAL}, chr(10))",
])

# ---------------------------------------------------------------- V3-V6 on a table with every defect
_DIRTY = ["o_orderkey", "o_custkey", "CAST(7 AS BIGINT) AS fixed_fee", "CAST(NULL AS DOUBLE) AS lost",
          "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price"]
_DIRTY_COLS = ["o_orderkey", "o_custkey", "fixed_fee", "lost", "price"]


def _check_sql(name: str, column: str, message: str) -> str:
    return f"SELECT {O.q(name)} AS check_name, {column} AS column_name, {message} AS message"


_DQ = """, twice AS (SELECT * FROM made UNION ALL SELECT * FROM made WHERE o_orderkey % 10 = 0),
one AS (SELECT * FROM made WHERE o_orderkey = (SELECT MIN(o_orderkey) FROM made)) """ + " UNION ALL ".join([
    _check_sql("duplicates", "CAST(NULL AS VARCHAR)", "printf('Found %d duplicate row(s). Consider deduplicating.', n)")
    + " FROM (SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM twice)) AS n FROM twice) WHERE n > 0",
    _check_sql("few_rows", "CAST(NULL AS VARCHAR)", O.q(fixed.MSG_FEW_ROWS)) + " FROM (SELECT COUNT(*) AS n FROM one) WHERE n < 2",
    *[_check_sql("missing", O.q(c), f"printf('Column ''{c}'' has %.1f%% missing values.', {O.R('pct')})")
      + f" FROM (SELECT 100e0 * AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS pct FROM twice) WHERE pct > 50e0"
      for c in _DIRTY_COLS],
    *[_check_sql("constant", O.q(c), O.q(f"Column '{c}' has only one unique value (constant)."))
      + f" FROM (SELECT COUNT(DISTINCT {c}) AS n FROM twice) WHERE n <= 1" for c in _DIRTY_COLS]])


@composed("orders", _DIRTY, _DQ)
def dq_defects(made: DataFrame) -> DataFrame:
    from verdant.operators.quality import constant_columns, duplicate_count, few_rows, missing_share
    twice = made.unionByName(made.where("o_orderkey % 10 = 0"))
    first = made.agg(F.min("o_orderkey").alias("least"))
    one = made.join(F.broadcast(first), F.col("o_orderkey") == F.col("least")).drop("least")
    none = F.lit(None).cast("string")
    found = [("duplicates", none, duplicate_count(twice, "t").where("n_duplicates > 0")), ("few_rows", none, few_rows(one, "t")),
             ("missing", F.col("column_name"), missing_share(twice, "t")),
             ("constant", F.col("column_name"), constant_columns(twice, "t"))]
    parts = [df.select(F.lit(k).alias("check_name"), c.alias("column_name"), "message") for k, c, df in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
