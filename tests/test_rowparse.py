import csv
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidloom.operators import rowparse as R

OK = "F-0123456789ab,a,b,c,d,e,f,g,h,open,note,rv,2024-01-09"


def one(raw, width=3):
    fields, reasons, offsets = R.tokenize([raw.encode()], width)
    return fields[0], reasons[0], offsets[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a,b,c", (["a", "b", "c"], None, None)),
        (",,", (["", "", ""], None, None)),
        ('"a,b","c""d",""', (["a,b", 'c"d', ""], None, None)),
        ('"a\nb",c,d', (["a\nb", "c", "d"], None, None)),
        ('a"b,c,d', (None, "quoting", 1)),
        ('"a"b,c,d', (None, "quoting", 3)),
        ('a,b,"c', (None, "quoting", 6)),
        ('a, "b",c', (None, "quoting", 3)),
        ("a,b", (None, "column_count", 3)),
        ("a,b,c,d", (None, "column_count", 5)),
        ("", (None, "column_count", 0)),
        ("ä,ö,ü", (["ä", "ö", "ü"], None, None)),
    ],
)
def test_records(raw, want):
    assert one(raw) == want


@given(st.lists(st.lists(st.text(alphabet='ab",\n é', max_size=400), min_size=3, max_size=3), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_round_trip_with_a_csv_writer(rows):
    records = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
        records.append(out.getvalue().encode())
    assert R.tokenize(records, 3) == (rows, [None] * len(rows), [None] * len(rows))


@given(st.text(alphabet='a",b', max_size=700), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_chunk_composition_equals_stepping(text, chunk):
    kinds = {'"': R.QUOTE, ",": R.COMMA}
    classes = np.array([kinds.get(c, R.OTHER) for c in text], np.uint8)
    state, want = R.START, []
    for c in classes.tolist():
        want.append(state)
        state = int(R._T[c, state])
    assert R.state_before(classes, chunk).tolist() == want


def load(spark, lines):
    df = spark.createDataFrame([(i, "b", x, "clash") for i, x in enumerate(lines)], "line_no long, batch_name string, raw_line string, reason string")
    statuses = spark.createDataFrame([("open",), (None,), ("open",)], "canon_value string")
    return {r.line_no: r for r in R.load_review_lines(df, statuses).collect()}


def test_reasons_in_order(spark):
    def but(i, v):
        parts = OK.split(",")
        parts[i] = v
        return ",".join(parts)

    lines = [OK, None, "", 'x"', but(0, "F-0123456789AB"), but(0, " F-0123456789ab"), but(9, "Open"), but(9, ""), but(12, ""), but(12, "2023-02-29"), but(12, "2024-02-29T23:59:59+05:30"),
             but(12, "2024-02-29T24:00:00Z"), but(12, "2024-01-09T10:00"), but(0, "") .replace("open", "Open"), but(12, "2024-01-09\n"), OK + "," + "x" * 100000]
    want = [None, "column_count", "column_count", "quoting", "finding_id", "finding_id", "review_status", None, None, "reviewed_at", None, "reviewed_at", "reviewed_at", "finding_id", "reviewed_at", "column_count"]
    got = load(spark, lines)
    assert [got[i].reason for i in range(len(lines))] == want
    assert got[0].finding_id == "F-0123456789ab" and got[0].reviewed_at == "2024-01-09"


def test_empty_table(spark):
    assert load(spark, []) == {}
