"""Casts that give NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of true and false.
TRUE = ("1", "true", "yes", "y")
FALSE = ("0", "false", "no", "n")


def to_int(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")


def to_double(text: Column) -> Column:
    number = F.trim(text).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def to_bool(text: Column) -> Column:
    """True or false by spelling, by truth of a number, else NULL."""
    low = F.lower(F.trim(text))
    number = to_double(low)
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(number.isNotNull(), number != 0)


def submitted_wide(text: Column) -> Column:
    """Any spelling of true or a number other than 0; everything else is false."""
    return F.coalesce(to_bool(text), F.lit(False))


def submitted_narrow(text: Column) -> Column:
    """Only ``true``, in any case."""
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def seconds_of_clock(text: Column) -> Column:
    """Seconds of ``MM:SS`` or ``HH:MM:SS``."""
    parts = F.split(F.trim(text), ":")
    digits = F.transform(parts, lambda x: x.try_cast("int"))
    ok = text.rlike(r"^\s*\d+(:\d{1,2}){1,2}\s*$")
    return F.when(ok, F.aggregate(digits, F.lit(0), lambda acc, x: acc * 60 + x))


def wall_time_without_offset(text: Column) -> Column:
    """ISO text as written, its offset dropped and not converted (microseconds since 1970)."""
    bare = F.regexp_replace(F.trim(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.unix_micros(F.try_to_timestamp(F.concat(F.replace(bare, F.lit("T"), F.lit(" ")), F.lit("Z"))))


#: What stands for a creation time that cannot be read: before all others.
NEVER_US = -62_135_596_800_000_000
# Fixed value: the calendar form a creation time has; an offset is read over, not applied.
CREATED = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?\s*$"


def created_wall_us(created: Column) -> Column:
    """Microseconds of the wall time as written, its offset dropped and not
    converted; anything else, and NULL, counts as the least time there is."""
    day, clock, second, fraction = (F.regexp_extract(created, CREATED, i) for i in (1, 2, 3, 4))
    clock = F.when(clock == "", "00:00").otherwise(clock)
    second = F.when(second == "", "00").otherwise(second)
    whole = F.unix_micros(F.try_to_timestamp(F.concat(day, F.lit(" "), clock, F.lit(":"), second, F.lit("Z"))))
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long")
    return F.coalesce(F.when(day != "", whole + micros), F.lit(NEVER_US))


def epoch_wall_us(seconds: Column, zone: str) -> Column:
    """A creation time given as a number: Unix seconds, as wall time of ``zone``."""
    return F.coalesce(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.floor(seconds * 1_000_000 + 0.5)), zone)), F.lit(NEVER_US))


def seconds_of_timecode(text: Column, fps: float) -> Column:
    """Seconds of ``HH:MM:SS:FF`` (or ``;FF``) at ``fps`` frames a second; NULL
    for another form, a minute or second over 59 or a frame beyond the rate."""
    parts = [F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2}):(\d{2})[:;](\d{2})\s*$", i).try_cast("int") for i in (1, 2, 3, 4)]
    hours, minutes, seconds, frames = parts
    fits = (minutes < 60) & (seconds < 60) & (frames < F.lit(float(fps)))
    return F.when(fits, hours * 3600 + minutes * 60 + seconds + frames / F.lit(float(fps)))


def option_list(text: Column) -> Column:
    """``"1, 2,2"`` -> [1, 2]: distinct whole numbers in order; NULL if one is none."""
    numbers = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), F.array_sort(F.array_distinct(numbers)))


def parse_options(text: str, allowed: tuple[int, ...]) -> list[int]:
    """The same on the driver, for a filter's value list; ``ValueError`` for others than ``allowed``."""
    try:
        wanted = sorted({int(x) for x in text.split(",")})
    except ValueError:
        raise ValueError(f"{text!r} is no list of numbers") from None
    if odd := [x for x in wanted if x not in allowed]:
        raise ValueError(f"{odd} are not among {list(allowed)}")
    return wanted
