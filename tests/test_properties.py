"""Property tests: scores do not depend on row order
given the row id, the one-company view equals the batch row, grades are
monotone in the score."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_operators import IDENT, PANEL_SCHEMA

metric = st.one_of(st.none(), st.floats(min_value=0, max_value=5000, allow_nan=False))
row = st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(min_value=2010, max_value=2015),
                st.integers(min_value=0, max_value=5000), *[metric] * 11)


def _rows(draw_rows):
    out = []
    for i, (c, y, emp, *ms) in enumerate(draw_rows):
        out.append((c, "Technology", "Germany", y, emp, *ms, i))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(row, min_size=1, max_size=12), st.randoms())
def test_score_independent_of_row_order(spark, rows, rnd):
    from verdant.operators.peers import scored_latest
    data = _rows(rows)
    shuffled = data[:]
    rnd.shuffle(shuffled)
    a = {r.company: (r.esg_score, r.grade) for r in scored_latest(spark.createDataFrame(data, PANEL_SCHEMA), IDENT).collect()}
    b = {r.company: (r.esg_score, r.grade)
         for r in scored_latest(spark.createDataFrame(shuffled, PANEL_SCHEMA).repartition(3), IDENT).collect()}
    assert a == b
    for score, grade in a.values():
        assert 10 <= score <= 95
        assert grade == ("A" if score >= 80 else "B" if score >= 65 else "C" if score >= 50 else
                         "D" if score >= 35 else "F")


def test_one_company_view_equals_batch_row(spark):
    from conftest import SF_SMALL
    from verdant.operators.peers import scored_latest
    from verdant.sources.tables import IDENTITY_MAP, esg_panel
    panel = esg_panel(spark, SF_SMALL)
    batch = {r.company: r for r in scored_latest(panel, IDENTITY_MAP).collect()}
    name = random.Random(7).choice(sorted(batch))
    one = scored_latest(panel.where(F.col("company") == name), IDENTITY_MAP).collect()
    assert len(one) == 1 and one[0].asDict() == batch[name].asDict()
