"""Column functions on dates and clock times: built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def valid_event_date(text: Column) -> Column:
    """The date of an exact yyyy-mm-dd that exists, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def parse_any_date(text: Column) -> Column:
    """The first date that reads as ISO, y/m/d, m/d/y, m.d.y or a written month; null if none is a real day."""
    forms = [(r"\b(\d{4}-\d{1,2}-\d{1,2})\b", "yyyy-M-d"), (r"\b(\d{4}/\d{1,2}/\d{1,2})\b", "yyyy/M/d"), (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", "M/d/yyyy"), (r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b", "M.d.yyyy"), (r"\b([A-Za-z]{3,9} \d{1,2}, ?\d{4})\b", "MMMM d,yyyy"), (r"\b([A-Za-z]{3}[a-z]*\.? \d{1,2}, ?\d{4})\b", "MMM d,yyyy")]

    def read(pattern: str, form: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        if "MMM" in form:
            found = F.regexp_replace(F.regexp_replace(found, r", ", ","), r"\.", "")
            if form.startswith("MMM "):
                found = F.regexp_replace(found, r"^([A-Za-z]{3})[a-z]*", "$1")
        return F.try_to_timestamp(F.when(found != "", found), F.lit(form)).cast("date")

    return F.coalesce(*[read(p, f) for p, f in forms])


def expand_compact_dates(text: Column) -> Column:
    """All real days of yyyymmdd runs with -dd or -mmdd tails, ranges filled in, distinct and sorted."""
    day = lambda s: F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date")
    runs = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{8}(?:-\d{4}|-\d{2})?)(?!\d)"), F.lit(1))

    def days(run: Column) -> Column:
        start = day(F.substring(run, 1, 8))
        end = F.when(F.length(run) == 11, day(F.concat(F.substring(run, 1, 6), F.substring(run, 10, 2)))).when(F.length(run) == 13, day(F.concat(F.substring(run, 1, 4), F.substring(run, 10, 4))))
        whole = F.when(end >= start, F.sequence(start, end)).otherwise(F.filter(F.array(start, end), lambda d: d.isNotNull()))
        return F.when(start.isNull(), F.array().cast("array<date>")).otherwise(F.coalesce(whole, F.array(start)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, days))))


def zone_tag(text: Column) -> Column:
    """The zone of the last tag such as ET or PDT."""
    tags = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"\b([ECMP])[SD]?T\b"), F.lit(1))
    last = F.get(tags, F.size(tags) - 1)
    zones = list(dims.ZONE_OF_LETTER.items())
    return reduce(lambda c, z: c.when(last == z[0], z[1]), zones[1:], F.when(last == zones[0][0], zones[0][1]))


def _minutes(half: Column) -> Column:
    """Minutes after midnight of a 12-hour clock time, else null."""
    p = r"(?i)^\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?\s*$"
    hour, minute, mark = F.regexp_extract(half, p, 1), F.regexp_extract(half, p, 2), F.lower(F.regexp_extract(half, p, 3))
    return F.when(hour != "", (hour.cast("int") % 12 + F.when(mark == "p", 12).otherwise(0)) * 60 + F.when(minute != "", minute).otherwise("0").cast("int"))


def parse_meeting_time(text: Column) -> Column:
    """struct(start_min, end_min) of a time or a time span, zone tags stripped; both null if the start cannot be read."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b[ECMP][SD]?T\b\.?", ""))
    halves = F.split(bare, r"\s*[-–]\s*")
    start = _minutes(F.get(halves, F.lit(0)))
    return F.struct(start.alias("start_min"), F.when(start.isNotNull(), _minutes(F.get(halves, F.lit(1)))).alias("end_min"))


def time_in_text(text: Column) -> Column:
    """The first clock time, or span of two, in free text; null if none."""
    # Fixed value: it must equal the original system's for right results.
    clock = r"\d{1,2}:\d{2}\s*(?:a\.m\.|p\.m\.|AM|PM|am|pm)"
    found = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"({clock}(?:\s*[-–]\s*{clock})?(?:\s*(?:E[PDS]T|ET))?)", 1))
    return F.when(found != "", found)


def _offset(at: Column, zone: Column) -> Column:
    """Minutes by which a zone is ahead of UTC at a time of UTC."""
    return ((F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)) / 60).cast("int")


def zone_short(at: Column, zone: Column) -> Column:
    """A zone's short name at a time of UTC: EST or EDT and the like where the zone has such names, else its distance from GMT."""
    ahead = _offset(at, zone)
    named = [(dims.ZONE_OF_LETTER[x], x, hours) for x, hours in dims.STANDARD_HOURS.items()]
    letter = reduce(lambda c, n: c.when(zone == n[0], F.concat(F.lit(n[1]), F.when(ahead == n[2] * 60, "ST").otherwise("DT"))), named[1:], F.when(zone == named[0][0], F.concat(F.lit(named[0][1]), F.when(ahead == named[0][2] * 60, "ST").otherwise("DT"))))
    minutes = F.abs(ahead) % 60
    gmt = F.concat(F.lit("GMT"), F.when(ahead < 0, "-").otherwise("+"), (F.abs(ahead) / 60).cast("int").cast("string"), F.when(minutes > 0, F.concat(F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))).otherwise(""))
    return letter.when(zone == "UTC", "UTC").when(ahead == 0, "GMT").otherwise(gmt)


def clock_range(start: Column, end: Column, zone: Column) -> Column:
    """A time of UTC, or a span of two, on the 12-hour clock of a zone, with the zone's short name at the start."""
    clock = lambda at: F.date_format(F.from_utc_timestamp(at, zone), "h:mm a")
    return F.when(start.isNotNull(), F.concat(clock(start), F.when(end.isNotNull(), F.concat(F.lit(" – "), clock(end))).otherwise(""), F.lit(" "), zone_short(start, zone)))


def resolve_meeting_time(date: Column, text: Column, rto: Column, viewer: str = "America/New_York") -> Column:
    """struct(zone, start_utc, end_utc, start_viewer, end_viewer, time24, raw, shown, zone_short, source_shown): the tag's zone
    before the operator's.

    shown is the span on the viewer's clock, source_shown that of the source's zone where it is another. Without a zone the clock
    time stands as written: time24 is its start, raw and shown the text. An end before the start is the same day's.
    """
    zone = F.coalesce(zone_tag(text), F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.ZONES.items() for x in kv]), rto))
    time = parse_meeting_time(text)
    utc = lambda minutes: F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(date).cast("long") * 86400 + minutes * 60), zone)
    start, end = utc(time["start_min"]), utc(time["end_min"])
    plain = F.lpad((time["start_min"] / 60).cast("int").cast("string"), 2, "0"), F.lpad((time["start_min"] % 60).cast("string"), 2, "0")
    here, as_written = F.from_utc_timestamp(start, viewer), F.when(start.isNull() & time["start_min"].isNotNull(), text)
    return F.struct(
        zone.alias("zone"), start.alias("start_utc"), end.alias("end_utc"), here.alias("start_viewer"), F.from_utc_timestamp(end, viewer).alias("end_viewer"),
        F.when(start.isNotNull(), F.date_format(here, "HH:mm")).when(time["start_min"].isNotNull(), F.concat_ws(":", *plain)).alias("time24"), as_written.alias("raw"),
        F.coalesce(clock_range(start, end, F.lit(viewer)), as_written).alias("shown"), F.when(start.isNotNull(), zone_short(start, F.lit(viewer))).alias("zone_short"),
        F.when(zone != viewer, clock_range(start, end, zone)).alias("source_shown"),
    )
