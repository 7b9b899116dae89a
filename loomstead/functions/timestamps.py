"""Reading timestamps of any of the usual spellings as wall times and instants."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions.text import strip

#: The only spelling that needs no change.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z$"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r" *([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?(?:\[([^\]]+)\])?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"([A-Za-z]{3})[a-z]*\.?"
#: Each spelling as a pattern, and its year, month, day, hour, minute, second, fraction, half, zone and region by group.
SPELLINGS = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ] *{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +{_TIME}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    "slashed": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +{_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    "named": (rf"^{_MONTH} (\d{{1,2}}),? (\d{{4}}),? +{_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    "mail": (rf"^(?:[A-Za-z]{{3,9}}, *)?(\d{{1,2}}) {_MONTH} (\d{{4}}),? +{_TIME}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
}
_DAY, _SECOND = 86_400_000_000, 1_000_000
#: Plain numbers are read in the unit that gives a time from here ...
NUMBERS_FROM = int(dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * _SECOND
#: ... to before here.
NUMBERS_TO = int(dt.datetime(2027, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * _SECOND
#: Overlaps of a wall time: half an hour, one hour and two hours are all there are.
OVERLAPS = (1_800_000_000, 3_600_000_000, 7_200_000_000)


@lru_cache(None)
def known_zones() -> tuple[str, ...]:
    return tuple(sorted(z for z in available_timezones() if "/" in z or z == "UTC"))


def abbreviations(zone: str, years: range = range(2000, 2038)) -> dict[str, int]:
    """Seconds east of UTC of each abbreviation that a zone uses; the latest use counts."""
    info, out = ZoneInfo(zone), {}
    day = dt.datetime(years.start, 1, 1, 12, tzinfo=dt.timezone.utc)
    while day.year < years.stop:
        local = day.astimezone(info)
        out[local.tzname()] = int(local.utcoffset().total_seconds())
        day += dt.timedelta(days=7)
    return out


def fields(raw: Column) -> Column:
    """A struct of wall (micros as if in UTC), offset (micros), mark (zone abbreviation), region, epoch and form.

    All null if the text denotes no existing date and time. Plain numbers have epoch instead of wall.
    """
    s = strip(raw)
    parts, form = None, None
    for name, (pattern, order) in SPELLINGS.items():
        hit = s.rlike(pattern)
        order = F.split(F.regexp_replace(s, pattern, order), r"\|")
        parts = F.when(hit, order) if parts is None else parts.when(hit, order)
        form = F.when(hit, name) if form is None else form.when(hit, name)
    return F.struct(parts.alias("parts"), form.alias("form"), s.alias("s"))


def swapped(f: Column) -> Column:
    """fields() with month and day of slashed dates the other way round; null for other spellings."""
    p = f["parts"]
    parts = F.concat(F.array(p[0], p[2], p[1]), F.slice(p, 4, 10))
    return F.when(f["form"] == "slashed", F.struct(parts.alias("parts"), F.lit("slashed, day first").alias("form"), f["s"].alias("s")))


def read(f: Column) -> dict[str, Column]:
    """The parts of fields() as columns: wall, offset, mark, region, epoch."""
    p, s = f["parts"], f["s"]
    text = lambda i: F.nullif(p[i], F.lit(""))
    number = lambda i: p[i].try_cast("int")
    month = F.coalesce(number(1), F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(p[1])).cast("int"))
    half, hour = F.lower(text(7)), number(3)
    hour = (
        F.when(half.isNull(), hour)
        .when((hour < 1) | (hour > 12), None)
        .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    second = F.coalesce(text(5).try_cast("int"), F.lit(0))
    at = F.try_make_timestamp(number(0), month, number(2), hour, number(4), F.when(second < 60, second).cast("decimal(16,6)"), F.lit("UTC"))
    micros = F.rpad(F.substring(F.coalesce(text(6), F.lit("")), 1, 6), 6, "0").try_cast("long")
    zone = F.upper(text(8))
    signed = zone.rlike("^[+-]")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    size = F.when((hours <= 18) & (minutes < 60), (hours * 3600 + minutes * 60).cast("long") * _SECOND)
    valid_offset = ~F.coalesce(signed, F.lit(False)) | size.isNotNull()
    offset = F.when(zone.isin("Z", "UTC"), F.lit(0)).when(signed, F.when(zone.startswith("-"), -size).otherwise(size))
    plain = F.when(s.rlike(r"^\d{1,20}(\.\d+)?$"), s.try_cast("decimal(38,12)"))
    readings = [F.floor(plain * F.lit(scale).cast("decimal(10,3)")).try_cast("long") for scale in ("1000000", "1000", "1", "0.001")]
    inside = [F.when((r >= NUMBERS_FROM) & (r < NUMBERS_TO), r) for r in readings]
    return {
        "wall": F.when(valid_offset, F.unix_micros(at) + micros),
        "offset": offset,
        "mark": F.when(~signed & ~zone.isin("Z", "UTC"), zone),
        "region": text(9),
        "epoch": F.coalesce(*inside),
    }


def first_reading(wall: Column, zone: Column) -> Column:
    """The instant of a wall time in a zone: of two readings the earlier; a skipped time by the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def second_reading(wall: Column, first: Column, zone: Column) -> Column:
    """The other instant of a wall time that occurs twice, else null."""
    return F.coalesce(
        *(F.when(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(first + d), zone)) == wall, first + d) for d in OVERLAPS)
    )


def stored_instant(raw: Column) -> Column:
    """Microseconds of what a store reads plainly: ISO dates (UTC without a zone), seconds or, above 10^10, milliseconds; else null."""
    s = strip(raw)
    number = F.when(s.rlike(r"^[0-9]{1,13}$"), s.try_cast("long"))
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$")
    zoned = F.when(s.rlike(r"(Z|[+-]\d{2}:\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    return F.coalesce(
        F.when(number > 10_000_000_000, number * 1000).otherwise(number * _SECOND), F.when(iso, F.unix_micros(zoned.try_cast("timestamp")))
    )


#: stored_instant() of a text {s}, in SQL.
STORED_INSTANT_SQL = r"""case when regexp_matches({s}, '^[0-9]{1,13}$') then case when {s}::bigint > 10000000000 then {s}::bigint * 1000 else {s}::bigint * 1000000 end
   when regexp_matches({s}, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$') then epoch_us(try_cast(replace({s}, 'T', ' ') as timestamp))
   when regexp_matches({s}, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$') then epoch_us(try_cast({s} as timestamptz)) end"""
