"""Delimited text against a pandas read: strategies, bad rows, quoted line breaks over splits, row order."""

import csv
import os
import random
import tempfile
from io import BytesIO, StringIO

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdant.sources.delimited import DelimitedReadError, preview, read_delimited, sniff_delimiter
from verdant.sources.records import records, text_lines


def folder(files):
    d = tempfile.mkdtemp(prefix="verdant-csv-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    return d


def by_pandas(text, strict=True):
    """The table of the first strategy with rows."""
    strategies = [",", None, ";", "\t"] if strict else [None, ",", ";", "\t"]
    for sep in strategies:
        try:
            df = pd.read_csv(BytesIO(text.encode()), sep=sep, engine="python", on_bad_lines="skip")
        except Exception:
            continue
        if not df.empty:
            df.columns = df.columns.str.strip()
            return df
    return None


def same(df, want):
    rows = [tuple(r)[:-1] for r in df.orderBy("_row_id").collect()]
    assert df.columns[:-1] == list(want.columns)
    clean = [tuple(None if pd.isna(x) else x for x in r) for r in want.itertuples(index=False, name=None)]
    assert [tuple(str(float(x)) if isinstance(x, (int, float)) else x for x in r) for r in rows] == [
        tuple(str(float(x)) if isinstance(x, (int, float)) else x for x in r) for r in clean]


FILES = {
    "comma": " company , year,value\nA,2020,1.5\nC,2022\nB,2021,2.5,9\nD,2023,4.0\nE,2024,5,\n",
    "semicolon": "a;b\n1;2\n3;4\n",
    "decimal commas": "a;b\n1,5;2,5\n3;4\n",
    "tab": "a\tb\n1\t2\n3\t4\n",
    "pipe": "a|b\n1|2\n",
    "first row long": "a,b\n1,2,3\n4,5\n6,7,8,9\n",
    "first row ends in a delimiter": "a,b,c\n5,6,7,\n1,2,3\n8,9\n",
    "blank lines": "\n\na,b\n\n1,2\n  \n3,4\n",
    "quotes": 'a,b\n"x\ny",1\nz"q,2\n"p""r",3\n"l,m",4\n',
    "header again": "a,b\n1,2\na,b\n",
    "header over lines": '"a\nb",c\n1,2\n',
    "one column": "a\nx\ny\n",
}


@pytest.mark.parametrize("name", sorted(FILES))
def test_tables_equal_a_pandas_read(spark, name):
    want = by_pandas(FILES[name])
    same(read_delimited(spark, folder({"f.csv": FILES[name]})), want)


@pytest.mark.parametrize("name", ["comma", "semicolon", "tab", "pipe", "decimal commas"])
def test_sniffed_tables_equal_a_pandas_read(spark, name):
    df = read_delimited(spark, folder({"f.csv": FILES[name]}), strict_order=False)
    want = by_pandas(FILES[name], strict=False)
    assert df.columns[:-1] == list(want.columns) and df.count() == len(want)


def test_sniffing_scores_consistency():
    assert sniff_delimiter(["a;b;c", "1,5;2;3", "4;5,25;6"]) == ";"
    assert sniff_delimiter(["x|y", '"a,b,c"|1', '"d,e,f"|2']) == "|"
    with pytest.raises(DelimitedReadError, match="Could not determine"):
        sniff_delimiter(["word", "other"])


def test_next_strategy_when_a_parse_is_empty(spark):
    """With ',' an open quote swallows all rows; ';' is next to give any."""
    text = 'a;b\n1,"x;2\n3,"y;4\n5;6\n'
    df = read_delimited(spark, folder({"f.csv": text}), sep=None)
    assert df.count() > 0


@pytest.mark.parametrize("text,cause", [("", "No columns"), ("a,b\n", "no data rows|determine"), ("\n\n", "No columns")])
def test_empty_files_give_the_last_error(spark, text, cause):
    with pytest.raises(DelimitedReadError, match="Failed to parse CSV. Last error: .*(" + cause + ")"):
        read_delimited(spark, folder({"f.csv": text}))


def dirty(seed, rows):
    rng = random.Random(seed)
    out = StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "note", "rest"])
    for k in range(rows):
        note = "".join(rng.choice(['a', 'b,', '\n', '"', ' ', '""', '\n\n', 'é', ';']) for _ in range(rng.randint(0, 12)))
        w.writerow([k, "n" + note, rng.choice(["x", 'q"', "l\nm", ""])])
    return out.getvalue()


@pytest.mark.parametrize("split", [40, 97, 1000])
def test_quoted_line_breaks_over_splits_equal_a_whole_read(spark, split):
    """Splits of a few dozen bytes begin anywhere, within records of several lines too."""
    d = folder({f"part {k}.csv": dirty(k, 60) for k in range(4)})
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in zip(keys, (str(split), "0", "400")):
            spark.conf.set(k, v)
        assert text_lines(spark, d, ",").rdd.getNumPartitions() > 12
        got = read_delimited(spark, d, schema={"id": "int"}, multi_line=True)
        rows = [(r.id, r.note, r.rest) for r in got.orderBy("_row_id").collect()]
        want = []
        for k in range(4):
            want += [(int(a), b, c or None) for a, b, c in list(csv.reader(StringIO(dirty(k, 60))))[1:]]
        assert rows == want
        assert got.select("_row_id").distinct().count() == len(want)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    whole = spark.read.csv(d, header=True, multiLine=True, quote='"', escape='"').select(F.col("id").cast("int"), "note", "rest")
    assert sorted(rows, key=str) == sorted((tuple(r) for r in whole.collect()), key=str)


def test_line_breaks_are_found_without_being_told(spark):
    d = folder({"a.csv": 'a,b\r\n"x\r\ny",1\r\nz,2\r\n'})
    assert [tuple(r)[:2] for r in read_delimited(spark, d).orderBy("_row_id").collect()] in (
        [("x\r\ny", 1), ("z", 2)], [("x\ny", 1), ("z", 2)])


def test_a_quote_that_never_closes(spark, monkeypatch):
    d = folder({"a.csv": 'a,b\n1,2\n"open,1\nz,2\n'})
    assert [r.record for r in records(spark, d, ",").collect()] == ["1,2"]


def test_rows_keep_the_order_of_many_files(spark):
    names = [f"p{k:03d} x.csv" for k in range(120)]
    d = folder({n: f"id,name\n{k * 2},a\n{k * 2 + 1},b\n" for k, n in enumerate(names)})
    df = read_delimited(spark, d, schema={"id": "int"})
    assert [r.id for r in df.orderBy("_row_id").collect()] == list(range(240))
    assert [r.id for r in preview(df, 3).collect()] == [0, 1, 2]
    assert "LocalTableScan" not in df._jdf.queryExecution().executedPlan().toString()  # no list from the driver
