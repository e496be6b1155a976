import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from folioflow.operators import timestamps as T

SITES = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("to", "Asia/Tokyo", "ymd"), ("kt", "Asia/Kathmandu", "dmy")]


def us(*a, zone="UTC", micro=0):
    return int((datetime(*a, tzinfo=ZoneInfo(zone)) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) + micro


def run(spark, rows, sites=SITES, **more):
    df = spark.createDataFrame([(i, d, v, datetime(2021, 1, 1) + timedelta(hours=i), "x") for i, (d, v) in enumerate(rows)], "article_id bigint, domain string, date string, fetched_at timestamp, fmt string")
    s = spark.createDataFrame(sites, "domain string, time_zone string, date_order string")
    return {r["article_id"]: r for r in T.normalise(spark, df, s, **more).collect()}


CASES = [
    ("ny", "2019-01-21T22:38:09Z", us(2019, 1, 21, 22, 38, 9)), ("ny", "12/18/2018 05:56 am", us(2018, 12, 18, 5, 56, zone="America/New_York")), ("be", "05/03/2019 12:10 am", us(2019, 3, 5, 0, 10, zone="Europe/Berlin")),
    ("be", "14 de marzo de 2019, 23:10 h", us(2019, 3, 14, 23, 10, zone="Europe/Berlin")), ("be", "27. Juni 2019, 14:37 Uhr", us(2019, 6, 27, 14, 37, zone="Europe/Berlin")), ("to", "2019年4月12日 19時36分", us(2019, 4, 12, 19, 36, zone="Asia/Tokyo")),
    ("kt", "2019-05-11 05:15:25 +05:45", us(2019, 5, 10, 23, 30, 25)), ("ny", "Sun, 25 Mar 2018 01:18:59 GMT", us(2018, 3, 25, 1, 18, 59)), ("ny", "March 13, 2019 9:19 PM EDT", us(2019, 3, 14, 1, 19)), ("ny", "Nov. 5, 2018 at 1.49 a.m.", us(2018, 11, 5, 1, 49, zone="America/New_York")),
    ("ny", "1542079822311", 1542079822311000), ("ny", "1544602581.14", 1544602581140000), ("ny", "2018-362T14:04:23Z", us(2018, 12, 28, 14, 4, 23)), ("ny", "20181114T203952Z", us(2018, 11, 14, 20, 39, 52)), ("ny", "2018-12-13T05:08:35.631620999Z", us(2018, 12, 13, 5, 8, 35, micro=631620)),
    ("be", "28 mars 2021 à 12h46", us(2021, 3, 28, 12, 46, zone="Europe/Berlin")), ("ny", "Updated 2019-11-01 19:26:24\n", us(2019, 11, 1, 19, 26, 24, zone="America/New_York")), ("ny", "2019-01-20T11:30:28-06:00[America/Chicago]", us(2019, 1, 20, 17, 30, 28)), ("ny", "2019-01-07T17:31:01[Asia/Tokyo]", us(2019, 1, 7, 8, 31, 1)),
]


def test_formats(spark):
    got = run(spark, [(d, v) for d, v, _ in CASES])
    for i, (_, v, want) in enumerate(CASES):
        assert got[i]["utc_us"] == want and got[i]["fixed"], v


@pytest.mark.parametrize("value", ["2019-02-30T10:00:00Z", "2019-01-01T25:40:00Z", "0000-00-00 00:00:00", "yesterday", "9 hours ago", "2019-06", "02:34", "n/a", "", None, "31/12/2018 10:00", "2018-366T01:00:00Z", "2019-05-05T10:00:00[Not/AZone]"])
def test_no_instant(spark, value):
    assert not any(r["fixed"] for r in run(spark, [("ny", value)]).values())


def test_clock_changes(spark):
    got = run(spark, [("ny", "2018-03-11 02:30:00"), ("ny", "2018-11-04 00:30:00"), ("ny", "2018-11-04 01:30:00"), ("ny", "2018-11-04 01:20:00"), ("ny", "2018-11-04 01:40:00 EST")])
    assert 0 not in got and got[1]["fixed"] and not got[2]["fixed"] and got[2]["n_readings"] == 2 and got[4]["fixed"]
    # 01:20 after 01:30: the later reading is the one that does not step back
    assert got[2]["utc_us"] == us(2018, 11, 4, 5, 30) and got[3]["utc_us"] == us(2018, 11, 4, 6, 20)


def test_order_unknown_follows_neighbours(spark):
    rows = [("zz", "25/01/2019 10:00 UTC"), ("zz", "04/02/2019 10:00 UTC"), ("zz", "13/02/2019 10:00 UTC")]
    got = run(spark, rows)
    assert got[1]["utc_us"] == us(2019, 2, 4, 10) and not got[1]["fixed"]


def test_blocks_give_what_one_pass_gives(spark, monkeypatch):
    rows = [("zz", f"{1 + i % 12:02d}/{1 + (i * 5) % 12:02d}/2019 10:{i % 60:02d} UTC") for i in range(60)]
    whole = {k: r["utc_us"] for k, r in run(spark, rows).items()}
    monkeypatch.setattr(T, "BLOCK_ROWS", 7)
    assert {k: r["utc_us"] for k, r in run(spark, rows).items()} == whole


def test_many_rows_without_a_time_give_what_one_pass_gives(spark, monkeypatch):
    rows = [(i, "zz", f"{1 + i % 12:02d}/{1 + (i * 5) % 12:02d}/2019 10:{i % 60:02d} UTC", None) for i in range(90)]
    df = spark.createDataFrame(rows, "article_id bigint, domain string, date string, fetched_at timestamp")
    s = spark.createDataFrame(SITES, "domain string, time_zone string, date_order string")
    get = lambda: {r["article_id"]: r["utc_us"] for r in T.normalise(spark, df, s).collect()}
    whole = get()
    monkeypatch.setattr(T, "BLOCK_ROWS", 7)
    assert get() == whole and len(whole) == 90


def test_viterbi_against_first_readings_on_planted_orders(spark):
    """Sources that declare no order, one of them writing months first: share of instants right, and without the chain."""
    rng, rows, want = random.Random(4), [], []
    for src, form in (("mm", "%m/%d/%Y %H:%M UTC"), ("dd", "%d/%m/%Y %H:%M UTC")):
        at = datetime(2019, 1, 1, tzinfo=timezone.utc)
        for _ in range(150):
            at += timedelta(hours=rng.randrange(2, 60))
            rows.append((src, at.strftime(form)))
            want.append(us(at.year, at.month, at.day, at.hour, at.minute))
    right = lambda got: sum(got[i]["utc_us"] == w for i, w in enumerate(want)) / len(want)
    chained = right(run(spark, rows))
    alone = right(run(spark, rows, costs=T.Costs(switch=0.0, backward=0.0)))
    assert chained >= 0.97 and alone <= 0.85


def test_empty_and_repeats(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "ny", "2019-01-21T22:38:09Z", None)] * 2 + [(2, None, "2019-01-21 22:38:09", None)], "article_id bigint, domain string, date string, fetched_at timestamp")
    s = spark.createDataFrame(SITES, "domain string, time_zone string, date_order string")
    assert [r["article_id"] for r in T.normalise(spark, df, s).collect()] == [1, 1]
