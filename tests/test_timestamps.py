import datetime as dt

import pytest

from evidloom.operators.timestamps import extend_dictionary, is_canonical, normalize_timestamps, parse_instant


def at(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.UTC).timestamp())


BERLIN, NEW_YORK = "Europe/Berlin", "America/New_York"


@pytest.mark.parametrize(
    ("raw", "zone", "order", "want"),
    [
        ("2024-01-09T15:55:01Z", None, None, at(2024, 1, 9, 15, 55, 1)),
        (" 2026-04-22t23:22:15z ", None, None, at(2026, 4, 22, 23, 22, 15)),
        ("2024-01-09 15:55:01-0500", None, None, at(2024, 1, 9, 20, 55, 1)),
        ("20250829T005330+1000", None, None, at(2025, 8, 28, 14, 53, 30)),
        ("2025-09-14T10:17:51,577118+02:00", None, None, at(2025, 9, 14, 8, 17, 51)),
        ("Jan 30, 2026 2:10:16 AM UTC", None, None, at(2026, 1, 30, 2, 10, 16)),
        ("Jan 30, 2026 12:10:16 AM UTC", None, None, at(2026, 1, 30, 0, 10, 16)),
        ("Sat, 15 Apr 2023 16:12:40 -0500", None, None, at(2023, 4, 15, 21, 12, 40)),
        ("1687127670", None, None, 1687127670),
        ("1716132739487", None, None, 1716132739),
        ("23. März 2023, 20:11 Uhr", BERLIN, "dmy", at(2023, 3, 23, 19, 11)),
        ("11.05.2023 06:09:17 +05:30", None, None, at(2023, 5, 11, 0, 39, 17)),
        ("12/03/2024 01:36:14", BERLIN, "dmy", at(2024, 3, 12, 0, 36, 14)),
        ("12/03/2024 01:36:14", NEW_YORK, "mdy", at(2024, 12, 3, 6, 36, 14)),
        ("27/02/2025 07:12 PM", BERLIN, "dmy", at(2025, 2, 27, 18, 12)),
        ("2023-08-15T18:41:46 America/New_York", None, None, at(2023, 8, 15, 22, 41, 46)),
        ("2024-03-26T17:22:30[America/St_Johns]", None, None, at(2024, 3, 26, 19, 52, 30)),
        ("2024-10-27 02:47:37 CEST", BERLIN, "dmy", at(2024, 10, 27, 0, 47, 37)),
        ("2024-10-27 02:47:37 CET", BERLIN, "dmy", at(2024, 10, 27, 1, 47, 37)),
        ("2025-04-09T15:07", BERLIN, "dmy", at(2025, 4, 9, 13, 7)),
        ("2024-01-15 10:00 CST", "Asia/Shanghai", None, at(2024, 1, 15, 2)),
        ("2024-01-15 10:00 CST", "America/Chicago", None, at(2024, 1, 15, 16)),
        ("2024-07-15 10:00 BST", "Europe/London", None, at(2024, 7, 15, 9)),
        ("2024-01-15 10:00 IST", "Asia/Kolkata", None, at(2024, 1, 15, 4, 30)),
        ("2024-01-15 10:00 CET", NEW_YORK, None, at(2024, 1, 15, 9)),
        ("2024/01/15 10:00:00Z", None, None, at(2024, 1, 15, 10)),
        ("Mon Jan 15 10:00:00 2024", BERLIN, None, at(2024, 1, 15, 9)),
        ("Mon Jan 15 10:00:00 UTC 2024", None, None, at(2024, 1, 15, 10)),
        ("Jan 15 2024 10:00", BERLIN, None, at(2024, 1, 15, 9)),
        ("15-Jan-2024 10:00", BERLIN, None, at(2024, 1, 15, 9)),
        ("20240115100000", BERLIN, None, at(2024, 1, 15, 9)),
        ("15.01.24 10:00", BERLIN, None, at(2024, 1, 15, 9)),
        ("01/15/24 10:00", BERLIN, "mdy", at(2024, 1, 15, 9)),
        ("Monday, 15 January 2024 10:00 UTC", None, None, at(2024, 1, 15, 10)),
        ("Montag, 15. Januar 2024 um 10:00 Uhr", BERLIN, None, at(2024, 1, 15, 9)),
        ("January 15th, 2024 at 10:00 AM UTC", None, None, at(2024, 1, 15, 10)),
        ("2024-01-15 10:00 UTC+2", None, None, at(2024, 1, 15, 8)),
        ("2024-01-15 10:00 GMT-05:30", None, None, at(2024, 1, 15, 15, 30)),
        ("987654321", None, None, 987654321),
        ("-1234567890", None, None, -1234567890),
        ("1687127670.25", None, None, 1687127670),
        ("-1687127670.25", None, None, -1687127671),
        ("2024-01-15T10:00:00.1234567890Z", None, None, at(2024, 1, 15, 10)),
    ],
)
def test_instants(raw, zone, order, want):
    assert parse_instant(raw, zone, order)[0] == want


@pytest.mark.parametrize(
    ("raw", "zone", "verdict"),
    [
        (None, BERLIN, "blank"),
        (" \t", BERLIN, "blank"),
        ("2024-02-08", BERLIN, "date_only"),
        ("25.03.2024", BERLIN, "date_only"),
        ("2025-02-30T10:00:00Z", BERLIN, "impossible"),
        ("2024-13-05 08:00:00+01:00", BERLIN, "impossible"),
        ("Sun, 15 Apr 2023 16:12:40 -0500", BERLIN, "impossible"),
        ("2024-03-31 02:19", BERLIN, "local_time_skipped"),
        ("2024-10-27T02:18:33", BERLIN, "local_time_repeats"),
        ("2024-10-27T02:18:33", None, "no_zone"),
        ("2025-06-1?T10:00:00Z", BERLIN, "unparsed"),
        ("yesterday", BERLIN, "unparsed"),
        ("2024-01-15 10:00 BST", "Asia/Dhaka", "zone_ambiguous"),
        ("2024-01-15 10:00 CST", BERLIN, "zone_ambiguous"),
        ("2024-01-15 10:00 EST", None, "zone_ambiguous"),
        ("Tue Jan 15 10:00:00 2024", BERLIN, "impossible"),
        ("15-Jan-2024", BERLIN, "date_only"),
        ("20241315100000", BERLIN, "impossible"),
        ("12345", BERLIN, "unparsed"),
        ("1716132739487.5", BERLIN, "unparsed"),
    ],
)
def test_no_instant(raw, zone, verdict):
    assert parse_instant(raw, zone, "dmy") == (None, None, verdict)


def test_operator_keeps_rows_and_dictionary_grows(spark, tmp_path):
    data = [(1, "2024-01-09 15:55:01", BERLIN, "dmy", "x"), (1, "2024-01-09 15:55:01", BERLIN, "dmy", "x"), (2, None, BERLIN, "dmy", "y"), (3, "  ", None, None, "z"), (4, "10.10.2024 10:10", None, None, "z")]
    rows = spark.createDataFrame(data, "id int, t string, z string, o string, verdict string")
    path = f"file://{tmp_path}/dictionary"
    got = sorted((r.id, r.utc_second, r.verdict) for r in normalize_timestamps(rows, "t", "z", "o", path).collect())
    assert got == [(1, at(2024, 1, 9, 14, 55, 1), "instant")] * 2 + [(2, None, "blank"), (3, None, "blank"), (4, None, "no_zone")]
    size = spark.read.parquet(path).count()
    normalize_timestamps(rows, "t", "z", "o", path).count()
    assert spark.read.parquet(path).count() == size == 2
    more = spark.createDataFrame([("s", "1687127670", None, None)], "source string, raw string, home_zone string, date_order string")
    assert extend_dictionary(more, path).count() == 1 and spark.read.parquet(path).count() == 3
    assert extend_dictionary(more, path).count() == 1 and spark.read.parquet(path).count() == 3


def test_a_value_in_a_third_of_all_rows(spark, tmp_path):
    rows = spark.range(90_000).selectExpr("id", "if(id % 3 = 0, '2024-01-09T15:55:01', string(1600000000 + id % 50)) as t", "'Europe/Berlin' as z", "'dmy' as o", "'s' as source_table")
    got = normalize_timestamps(rows, "t", "z", "o", f"file://{tmp_path}/hot", "source_table")
    assert got.groupBy().agg({"utc_second": "sum"}).first()[0] == 30_000 * at(2024, 1, 9, 14, 55, 1) + sum(1600000000 + i % 50 for i in range(90_000) if i % 3)
    assert got.count() == 90_000 and "Generate" in got._jdf.queryExecution().simpleString()


def test_the_dictionary_outlives_the_application(spark):
    from evidloom.operators.timestamps import PARSER_VERSION, dictionary_path, zone_rules

    assert spark.sparkContext.applicationId not in dictionary_path(spark) and f"parser{PARSER_VERSION}" in dictionary_path(spark) and zone_rules() in dictionary_path(spark)


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, t string, z string, o string")
    assert normalize_timestamps(rows, "t", "z", "o", f"file://{tmp_path}/d").count() == 0


def test_canonical_form(spark):
    df = spark.createDataFrame([("2024-01-09T15:55:01Z",), ("2024-01-09T15:55:01z",), (None,)], "t string")
    assert [r[0] for r in df.select(is_canonical(df.t)).collect()] == [True, False, None]
