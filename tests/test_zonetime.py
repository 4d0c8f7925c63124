"""Timestamps against an independent reading with datetime and zoneinfo."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from quirewise.operators.zonetime import to_utc

OFFICES = [("LDN", "Europe/London", "DMY"), ("NYC", "America/New_York", "MDY"), ("TYO", "Asia/Tokyo", "YMD"), ("KTM", "Asia/Kathmandu", "YMD"), ("SAO", "America/Sao_Paulo", "DMY")]


def wall(tz, *parts):
    """Brute force: every UTC minute offset that could give this wall-clock time."""
    local = datetime(*parts)
    z = ZoneInfo(tz)
    hits = {local - timedelta(seconds=s) for s in range(-14 * 3600, 14 * 3600 + 1, 900) if (local - timedelta(seconds=s)).replace(tzinfo=timezone.utc).astimezone(z).replace(tzinfo=None) == local}
    if len(hits) != 1:
        return "ambiguous" if hits else "invalid"
    return hits.pop().strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"


CASES = [
    ("LDN", "2020-08-11 07:06", wall("Europe/London", 2020, 8, 11, 7, 6)),
    ("LDN", "2023-10-29 01:30", "ambiguous"),
    ("LDN", "2023-03-26 01:30", "invalid"),
    ("LDN", "2023-03-26 02:00", wall("Europe/London", 2023, 3, 26, 2, 0)),
    ("LDN", "2023-10-29 01:30 BST", "2023-10-29T00:30:00.000000Z"),
    ("LDN", "2023-10-29T01:30:00+01:00[Europe/London]", "2023-10-29T00:30:00.000000Z"),
    ("NYC", "2024-11-03 01:10 EST", "2024-11-03T06:10:00.000000Z"),
    ("NYC", "2/12/2025 4:58 AM", wall("America/New_York", 2025, 2, 12, 4, 58)),
    ("LDN", "2/12/2025 12:58 AM", wall("Europe/London", 2025, 12, 2, 0, 58)),
    ("LDN", "2/12/25", wall("Europe/London", 2025, 12, 2)),
    ("TYO", "24/06/22", wall("Asia/Tokyo", 2024, 6, 22)),
    ("KTM", "2024/05/08 9:34 PM", wall("Asia/Kathmandu", 2024, 5, 8, 21, 34)),
    ("LDN", "13/13/2024", "invalid"),
    ("NYC", "13/12/2024 1:00 PM", "invalid"),
    ("SAO", "19.07.2023 18:06", wall("America/Sao_Paulo", 2023, 7, 19, 18, 6)),
    ("LDN", "31.04.2024 09:15", "invalid"),
    ("LDN", "30 February 2025", "invalid"),
    ("LDN", "2023-02-29", "invalid"),
    ("LDN", "1587889486291", "2020-04-26T08:24:46.291000Z"),
    ("LDN", "1603409630", "2020-10-22T23:33:50.000000Z"),
    ("KTM", "45484.40103009", wall("Asia/Kathmandu", 2024, 7, 11, 9, 37, 29)),
    ("TYO", "2024-W29-6", wall("Asia/Tokyo", 2024, 7, 20)),
    ("TYO", "2021-W53-1", "invalid"),
    ("TYO", "2020-W53-7", wall("Asia/Tokyo", 2021, 1, 3)),
    ("LDN", "Tue, 06 Jun 2023 13:17:58 -0700", "2023-06-06T20:17:58.000000Z"),
    ("LDN", "2020-03-28 23:55:43 +0000", "2020-03-28T23:55:43.000000Z"),
    ("SAO", "2 mars 2024 à 0h07", wall("America/Sao_Paulo", 2024, 3, 2, 0, 7)),
    ("SAO", "19 août 2022 à 8h44", wall("America/Sao_Paulo", 2022, 8, 19, 8, 44)),
    ("KTM", "20. Mai 2022 02:56 Uhr", wall("Asia/Kathmandu", 2022, 5, 20, 2, 56)),
    ("KTM", "3. März 2022 02:56 Uhr", wall("Asia/Kathmandu", 2022, 3, 3, 2, 56)),
    ("KTM", " 10-JUL-2021 14:36:47 ", wall("Asia/Kathmandu", 2021, 7, 10, 14, 36, 47)),
    ("NYC", "Mar 17, 2022 8:09:22 PM", wall("America/New_York", 2022, 3, 17, 20, 9, 22)),
    ("NYC", "May 1, 2022 12:09:22 PM", wall("America/New_York", 2022, 5, 1, 12, 9, 22)),
    ("NYC", "May 1, 2022 13:09:22 PM", "invalid"),
    ("LDN", "8 August 2022, 11:58", wall("Europe/London", 2022, 8, 8, 11, 58)),
    ("LDN", "20220324T035041", wall("Europe/London", 2022, 3, 24, 3, 50, 41)),
    ("LDN", "20250611", wall("Europe/London", 2025, 6, 11)),
    ("LDN", "2021-11-18T15:12:46.621551Z", "2021-11-18T15:12:46.621551Z"),
    ("LDN", "2021-05-19T15:35:46.636+10:00", "2021-05-19T05:35:46.636000Z"),
    ("NYC", "2020-02-22T20:28:33[Asia/Kathmandu]", wall("Asia/Kathmandu", 2020, 2, 22, 20, 28, 33)),
    ("NYC", "2020-11-01T01:28:33[America/New_York]", "ambiguous"),
    ("LDN", "unknown", "invalid"),
    ("LDN", "-", "invalid"),
    ("LDN", "24:61", "invalid"),
    ("LDN", "2024-05-05 25:00", "invalid"),
    ("LDN", "2024-05-05 10:00 XQZ", "invalid"),
    (None, "2024-05-05 10:00", "invalid"),
    (None, "2024-05-05T10:00:00Z", "2024-05-05T10:00:00.000000Z"),
    ("LDN", "", None),
    ("LDN", "  ", None),
    ("LDN", None, None),
    ("LDN", "x" * 100_000, "invalid"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, o, d, "kept") for i, (o, d, _) in enumerate(CASES)], "id int, office string, date string, tz string")
    offices = spark.createDataFrame(OFFICES, "office string, tz string, date_order string")
    got = {r["id"]: r["utc"] for r in to_utc(df, offices).collect()}
    wrong = [(o, (d or "")[:60], want, got[i]) for i, (o, d, want) in enumerate(CASES) if got[i] != want]
    assert not wrong


@pytest.mark.parametrize("tz,office", [("Europe/London", "LDN"), ("America/New_York", "NYC"), ("America/Sao_Paulo", "SAO")])
def test_every_hour_of_a_changing_month(spark, tz, office):
    start = datetime(2018, 10, 20)
    stamps = [start + timedelta(minutes=30 * k) for k in range(48 * 25)]
    df = spark.createDataFrame([(office, t.strftime("%Y-%m-%d %H:%M")) for t in stamps], "office string, date string")
    offices = spark.createDataFrame(OFFICES, "office string, tz string, date_order string")
    got = {r["date"]: r["utc"] for r in to_utc(df, offices).collect()}
    z = ZoneInfo(tz)
    for t in stamps:
        folds = {t.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        real = {u for u in folds if u.astimezone(z).replace(tzinfo=None) == t}
        want = "invalid" if not real else "ambiguous" if len(real) > 1 else real.pop().strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
        assert got[t.strftime("%Y-%m-%d %H:%M")] == want


def test_empty(spark):
    offices = spark.createDataFrame(OFFICES, "office string, tz string, date_order string")
    assert to_utc(spark.createDataFrame([], "office string, date string"), offices).count() == 0


def test_abbreviations_hold_as_of_their_time(spark):
    """One abbreviation, two offsets in one zone: Moscow's MSK was four hours ahead from 2011 to 2014."""
    offices = spark.createDataFrame([("MOW", "Europe/Moscow", "DMY"), ("BAD", "No/Where", "DMY"), ("NUL", None, None)], "office string, tz string, date_order string")
    rows = [("MOW", "2012-07-01 12:00 MSK", "2012-07-01T08:00:00.000000Z"), ("MOW", "2020-07-01 12:00 MSK", "2020-07-01T09:00:00.000000Z"), ("MOW", "2020-07-01 12:00 MSD", "2020-07-01T08:00:00.000000Z"), ("MOW", "2020-07-01 12:00 XYZ", "invalid")]
    rows += [("BAD", "2020-07-01 12:00", "invalid"), ("NUL", "2020-07-01 12:00", "invalid"), ("NUL", "2020-07-01 12:00 UTC", "2020-07-01T12:00:00.000000Z"), ("MOW", "2020-07-01T12:00:00[Asia/Tokyo]", "2020-07-01T03:00:00.000000Z"), ("MOW", "2020-07-01T12:00:00[No/Where]", "invalid")]
    got = to_utc(spark.createDataFrame(rows, "office string, date string, want string"), offices)
    assert not [tuple(r) for r in got.filter("not utc <=> want").collect()]


def test_years_outside_the_table(spark):
    offices = spark.createDataFrame([("LDN", "Europe/London", "DMY")], "office string, tz string, date_order string")
    rows = [("LDN", "2150-07-01 12:00", "2150-07-01T11:00:00.000000Z"), ("LDN", "2150-01-01 12:00", "2150-01-01T12:00:00.000000Z"), ("LDN", "1850-01-01 12:00", "1850-01-01T12:00:00.000000Z")]
    got = to_utc(spark.createDataFrame(rows, "office string, date string, want string"), offices)
    assert not [tuple(r) for r in got.filter("not utc <=> want").select("date", "utc").collect()]
