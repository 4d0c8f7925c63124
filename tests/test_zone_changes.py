"""Short spells of an offset, which a sparse look at the clock misses."""

import zoneinfo
from datetime import datetime, timezone

import pytest

from quirewise.operators import zonetime as Z


def seconds(*day):
    return int(datetime(*day, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize("zone,day", [("America/Argentina/Tucuman", (2004, 6, 6)), ("America/Argentina/Catamarca", (2004, 6, 10)), ("America/Argentina/Ushuaia", (2004, 6, 10)), ("Asia/Gaza", (2053, 9, 15))])
def test_short_spells(zone, day):
    z = zoneinfo.ZoneInfo(zone)
    at = seconds(*day)
    (found,) = [x for x in Z._intervals_of(zone, 2000, 2090) if x[0] <= at < x[1]]
    assert found[2] == int(datetime.fromtimestamp(at, z).utcoffset().total_seconds())
    around = [t for x in Z._intervals_of(zone, 2000, 2090) for t in (x[0], x[1] - 1) if seconds(2000, 1, 1) < t < seconds(2091, 1, 1)]
    for lo, hi, off, name in Z._intervals_of(zone, 2000, 2090):
        for t in (max(lo, seconds(2000, 1, 1)), min(hi, seconds(2091, 1, 1)) - 1):
            x = datetime.fromtimestamp(t, z)
            assert (int(x.utcoffset().total_seconds()), x.tzname()) == (off, name)
    assert around


@pytest.mark.parametrize("zone", ["Asia/Gaza", "Asia/Hebron", "America/Argentina/Tucuman", "Europe/London", "Africa/Casablanca", "UTC"])
def test_every_day(zone):
    z = zoneinfo.ZoneInfo(zone)
    spans = Z._intervals_of(zone, 1990, 2090)
    k = 0
    for t in range(seconds(1990, 1, 1), seconds(2091, 1, 1), 86400):
        while spans[k][1] <= t:
            k += 1
        assert int(datetime.fromtimestamp(t, z).utcoffset().total_seconds()) == spans[k][2]
