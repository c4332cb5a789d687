"""Times: parsing of mixed formats to epoch seconds, windows and ages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch seconds that count as a real date, and from where a number means milliseconds.
FIRST, LAST, MILLIS = 9.4e8, 4e9, 1e11
#: Formats without a zone are read at +08:00.
LOCAL_HOURS = 8
ZONED = ("dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
LOCAL = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy年M月d日 HH:mm", "yyyy年M月d日", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy HH:mm:ss", "d MMM yyyy")


def parse_time(c: Column) -> Column:
    """Epoch seconds of a time in any of the known formats, null if none fits."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike("^[0-9]+$"), text.cast("double"))
    number = F.when(number > MILLIS, number / 1000).otherwise(number)
    number = F.when((number > FIRST) & (number < LAST), F.floor(number))
    # names of weekdays can't be read and say nothing
    plain = F.regexp_replace(text, "^[A-Za-z]{3,9},?\\s+", "")
    plain = F.regexp_replace(plain, "\\b(GMT|UTC)$", "+0000")
    zoned = [F.unix_timestamp(F.try_to_timestamp(plain, F.lit(f))) for f in ZONED]
    local = [F.unix_timestamp(F.try_to_timestamp(plain, F.lit(f))) - LOCAL_HOURS * 3600 for f in LOCAL]
    return F.coalesce(number.cast("bigint"), reduce(lambda a, b: F.coalesce(a, b), [*zoned, *local]))


def clamp_future(published: Column, fetched: Column, tolerance: int = 300) -> Column:
    """A time later than its fetch (beyond the tolerance) is set to the fetch."""
    return F.when(published > fetched + tolerance, fetched).otherwise(published)


def day(ts: Column) -> Column:
    """The day of epoch seconds, as days since the epoch."""
    return F.floor(ts / 86400)


def half_life(age_seconds: Column, hours: float = 18.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_seconds / 3600) / hours)


def shown(ts: Column, now: Column) -> Column:
    """A time for reading, in the desk's zone (UTC+8): with the day and hour, or the date if the year is another; a dash without."""
    at, today = (F.timestamp_seconds(x + 28_800) for x in (ts, now))
    return F.when(F.coalesce(ts, F.lit(0)) == 0, "—").when(F.year(at) != F.year(today), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "MM-dd HH:mm"))


def period_start(day: Column) -> Column:
    """A day as YYYY-MM-DD to the second at which it begins (UTC); null for anything else."""
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.unix_timestamp(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))))
