from datetime import datetime, timezone

import numpy as np
import pytest

from sableflow.operators.timestamps import mixture, normalise, readings, stated_times


def us(*args):
    t = datetime(*args, tzinfo=timezone.utc)
    return int(t.timestamp()) * 1_000_000 + t.microsecond


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [
        ("2024-03-20T17:18:58+0800", None, us(2024, 3, 20, 9, 18, 58)),
        ("2024-12-04 20:44:40+09:00", "Europe/Paris", us(2024, 12, 4, 11, 44, 40)),
        ("2022-10-07T13:30:35+02:00[Europe/Paris]", None, us(2022, 10, 7, 11, 30, 35)),
        ("20220621T232850Z", None, us(2022, 6, 21, 23, 28, 50)),
        ("1680700702", None, 1680700702 * 10**6),
        ("1746737349071", None, 1746737349071 * 1000),
        ("1631812489093618", None, 1631812489093618),
        ("Sun, 06 Apr 2025 02:04:13 +1000", None, us(2025, 4, 5, 16, 4, 13)),
        ("2025-04-30 06:44:35 CST", "Asia/Shanghai", us(2025, 4, 29, 22, 44, 35)),
        ("2025-04-30 06:44:35 CST", "America/Chicago", us(2025, 4, 30, 12, 44, 35)),
        ("Aug 13, 2022 4:30 PM GST", "Asia/Dubai", us(2022, 8, 13, 12, 30)),
        ("12 Mar 2024 12:05", "Asia/Tokyo", us(2024, 3, 12, 3, 5)),
        ("23 de febrero de 2021, 09:44", "Europe/Madrid", us(2021, 2, 23, 8, 44)),
        ("30. März 2025, 00:30 Uhr", "Europe/Berlin", us(2025, 3, 29, 23, 30)),
        ("31 de outubro de 2023 às 22h22", "America/Sao_Paulo", us(2023, 11, 1, 1, 22)),
        ("19 novembre 2025 à 3h51", "Europe/Paris", us(2025, 11, 19, 2, 51)),
        ("2022年2月28日 2時25分", "Asia/Tokyo", us(2022, 2, 27, 17, 25)),
        ("2022-03-17", "America/New_York", us(2022, 3, 17, 4)),
        ("2024-11-03 01:30:00", "America/New_York", us(2024, 11, 3, 5, 30)),  # comes twice: the earlier
        ("2024-11-03 01:30:00 EST", "America/New_York", us(2024, 11, 3, 6, 30)),
        ("1631812489093618123", None, 1631812489093618),
        ("1680700702.25", None, 1680700702 * 10**6 + 250_000),
        ("2024-W05-3 10:00", "UTC", us(2024, 1, 31, 10)),
        ("Aug 13, 2022 5pm", "UTC", us(2022, 8, 13, 17)),
        ("13 August 2022 5 a.m.", "UTC", us(2022, 8, 13, 5)),
        ("2024-04-19T13:37:06.336", "Asia/Kolkata", us(2024, 4, 19, 8, 7, 6, 336000)),
    ],
)
def test_forms(value, zone, want):
    assert readings(value, zone) == ("one", ((want, "ok"),))


@pytest.mark.parametrize("value", ["", "-", "n/a", "pending", "0000-00-00 00:00:00", "2024-13-01", "12345", "31 Foo 2024 10:00", "2024-02-30T10:00:00Z", "9" * 50])
def test_no_instant(value):
    assert readings(value, "Europe/Paris") == ("one", ((None, "none"),))


def test_skipped_and_zoneless():
    assert readings("2024-03-31 02:30:00", "Europe/Paris")[1] == ((None, "skipped"),)
    assert readings("2024-03-31 02:30:00", None)[1] == ((None, "no_zone"),)


ROWS = "tbl string, row_no bigint, value string, source string, site_id string, status string"
FEEDS = "source string, site_id bigint, zone_name string, date_order string, home_lang string"


def test_orders_of_day_and_month(spark):
    feeds = spark.createDataFrame([("D", 1, "UTC", "DMY", "en"), ("M", 2, "UTC", "MDY", "en"), ("U", 3, "UTC", None, "en"), ("V", 4, "UTC", None, "en"), (None, None, None, None, None)], FEEDS)
    rows = [("t", 1, "03/04/2024 10:00", "D", None, "x"), ("t", 2, "03/04/2024 10:00", "M", None, "x"), ("t", 3, "05/05/2024 10:00", "U", None, "x"), ("t", 4, "03/04/2024 10:00", "V", None, "x")]
    rows += [("t", 100 + i, f"{13 + i}/04/2024 10:00", "U", None, "x") for i in range(12)] + [("t", 5, "03/04/2024 10:00", "U", None, "x")]
    rows += [("t", 6, "03/04/2024 10:00", None, "2", "x"), ("t", 7, "03/04/2024 10:00", None, None, "x"), ("t", 8, None, "D", None, None), ("t", 9, " 2024-01-01T00:00:00Z ", "D", None, None), ("t", 10, "2024-01-01T00:00:00Z", "D", None, None), ("t", 10, "2024-01-01T00:00:00Z", "D", None, None)]
    out = {}
    got = normalise(spark.createDataFrame(rows, ROWS), feeds).collect()
    for r in got:
        out[r.row_no] = (r.utc_us, r.status)
    april3, march4 = us(2024, 4, 3, 10), us(2024, 3, 4, 10)
    assert out[1] == (april3, "ok")
    assert out[2] == (march4, "ok")
    assert out[3] == (us(2024, 5, 5, 10), "ok")  # the same either way
    assert out[4] == (None, "ambiguous")  # nothing tells
    assert out[5] == (april3, "ok")  # its source's other dates tell
    assert out[6] == (march4, "ok")  # source by site
    assert out[7] == (None, "no_zone")
    assert out[8] == (None, "none")
    assert out[9] == (us(2024, 1, 1), "ok")
    assert out[10][1] == "normal"
    assert len(got) == len(rows)  # repeated rows stay


def test_empty_tables(spark):
    feeds = spark.createDataFrame([], FEEDS)
    assert normalise(spark.createDataFrame([], ROWS), feeds).count() == 0
    one = spark.createDataFrame([("t", 1, "2024-01-01 10:00", "D", None, None)], ROWS)
    assert normalise(one, feeds).first().status == "no_zone"


def test_tables_in_one_shape(spark, sf):
    sot = spark.read.parquet(f"{sf}/sot_sugar.parquet")
    assert stated_times(None, sot, None).count() == sot.count()


def test_two_digit_years_have_three_readings():
    kind, found = readings("03/04/05", "UTC")
    assert kind == "num" and [x[0] for x in found] == [us(2005, 4, 3), us(2005, 3, 4), us(2003, 4, 5)]
    assert [x[1] for x in readings("31/12/70", "UTC")[1]] == ["ok", "none", "none"]


def test_shares_are_the_fixed_point_whatever_is_shared():
    """Shared values tell nothing by themselves: the shares are those of the decided ones and the prior, however many are shared."""
    for both in (0, 10, 5000):
        shares = mixture(np.array([[1.0, 0, 0], [0, 1.0, 0], [1.0, 1.0, 0]]), np.array([10.0, 90.0, both]), np.array([1.0, 1.0, 1e-9]))
        assert shares[0] == pytest.approx(11 / 102, abs=1e-5)
    # and a likelihood moves them
    shares = mixture(np.array([[0.9, 0.1, 0.0]]), np.array([50.0]), np.array([1.0, 1.0, 1.0]))
    assert shares[0] > 0.9


def test_dates_overturn_a_wrong_declaration(spark):
    feeds = spark.createDataFrame([("W", 1, "UTC", "DMY", "en")], FEEDS)
    rows = [("t", i, f"04/{13 + i % 15}/2024 10:00", "W", None, None) for i in range(50)] + [("t", 100 + i, f"0{1 + i % 9}/0{1 + i % 7}/2024 10:00", "W", None, None) for i in range(500)]
    out = {r.row_no: r for r in normalise(spark.createDataFrame(rows, ROWS), feeds).collect()}
    assert all(r.status == "ok" for r in out.values())
    assert out[101].utc_us == us(2024, 2, 2, 10) and out[107].utc_us == us(2024, 8, 1, 10)  # 08/01 is August


def test_reference_times_tell_where_the_source_does_not(spark):
    """A source that mixes both orders: what lies far from when the row was received is the less likely reading."""
    feeds = spark.createDataFrame([("X", 1, "UTC", None, "en"), ("Y", 2, "UTC", "DMY", "en")], FEEDS)
    sure = [("t", 1000 + i, f"{13 + i % 15}/04/2024 10:00", "Y", None, datetime(2024, 4, 13 + i % 15, 12)) for i in range(200)]
    rows = sure + [("t", i, f"{13 + i}/04/2024 10:00", "X", None, datetime(2024, 4, 13 + i, 12)) for i in range(5)] + [("t", 5 + i, f"04/{13 + i}/2024 10:00", "X", None, datetime(2024, 4, 13 + i, 12)) for i in range(5)]
    rows += [("t", 50, "03/04/2024 10:00", "X", None, datetime(2024, 4, 3, 11)), ("t", 51, "03/04/2024 10:00", "X", None, datetime(2024, 3, 4, 11)), ("t", 52, "03/04/2024 10:00", "X", None, None)]
    out = {r.row_no: r for r in normalise(spark.createDataFrame(rows, ROWS.replace("status string", "near timestamp_ntz")), feeds).collect()}
    assert out[50].utc_us == us(2024, 4, 3, 10) and out[51].utc_us == us(2024, 3, 4, 10)
    assert out[52].status == "ambiguous" and out[52].utc_us is None
