"""Problem 1: one unambiguous UTC instant for every way a time was written.

The operator never parses rows. It reduces them to a dictionary of distinct
(raw string, zone, day/month order) entries, parses each entry once with
built-in expressions, appends it to a Parquet store and joins the instants back
to the rows. A later call with the same store parses unseen entries only.
"""

from __future__ import annotations

import uuid
from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import shared_dir

# Minutes east of UTC for zone abbreviations. IST is India's.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60,
    "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AP]M)?"
_ZONE = r"\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3,5})?(?:\s*\[[A-Z_/+-]+\])?"
_BLANKS = "\\s\\u00a0\\u2007\\u202f\\ufeff\\u200b"

#: name -> (pattern on trimmed upper-case text, group numbers of
#: year, month, day, hour, minute, second, fraction, AM/PM, zone)
LAYOUTS: dict[str, tuple[str, tuple[int, ...]]] = {
    "year_first": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})[T ]\s*{_CLOCK}{_ZONE}$", (1, 3, 4, 5, 6, 7, 8, 9, 10)),
    "year_last": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})[T ,]\s*{_CLOCK}{_ZONE}$", (4, 0, 0, 5, 6, 7, 8, 9, 10)),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?(){_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "month_name": (rf"^(?:[A-Z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Z]{{3,9}})[ -](\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "month_name_first": (rf"^(?:[A-Z]{{3,9}},?\s+)?([A-Z]{{3,9}})\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
}

#: Part of the store's name: entries of another parser are not read.
PARSER_VERSION = 2

DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("day_order", T.StringType()),
        T.StructField("utc_us", T.LongType()),
    ]
)


def _int(text: Column) -> Column:
    return F.when(text != "", text).cast("int")


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of ``Z``, ``+hh``, ``+hhmm``, ``+hh:mm`` or an abbreviation."""
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = _int(F.substring(digits, 1, 2)), F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    numeric = F.when((hours <= 15) & (minutes < 60), sign * (hours * 60 + minutes))
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.when(zone.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(named, zone))


def parse_entries(entries: DataFrame) -> DataFrame:
    """(raw, zone, day_order) rows with ``utc_us``: microseconds since 1970 UTC
    of the written time, NULL if it denotes none.

    ``zone`` (an IANA name) is used only for text that states no zone, and
    ``day_order`` (dmy, mdy, ymd) only for numeric dates that end in the year.
    A wall time that occurs twice means the first; one that a clock change
    skips, an impossible date and a placeholder denote nothing. Plain numbers
    are Unix seconds, milliseconds, microseconds or nanoseconds by their size.
    """
    blanks = f"^[{_BLANKS}]+|[{_BLANKS}]+$"
    text = F.col("_text")

    def fields(name: str) -> Column:
        pattern, groups = LAYOUTS[name]
        parts = [F.regexp_extract(text, pattern, g) if g else F.lit("") for g in groups]
        if name == "year_last":
            a, b = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3)
            day_first = F.col("day_order") == "dmy"
            parts[2], parts[1] = F.when(day_first, a).otherwise(b), F.when(day_first, b).otherwise(a)
        return F.array(*parts)

    layout = None
    for name, (pattern, _) in LAYOUTS.items():
        layout = (layout.when if layout is not None else F.when)(text.rlike(pattern), fields(name))
    known = sorted(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT"))
    split = (
        entries.withColumn("_text", F.upper(F.regexp_replace("raw", blanks, "")))
        .withColumn("_f", layout)
        .withColumn("_number", F.regexp_extract("_text", r"^(\d{9,19}(?:\.\d{1,9})?)$", 1))
        .withColumn("_site", F.when(F.col("zone").isin(known), F.col("zone")))
    )
    year, month, day, hour, minute, second, fraction, half, stated = (F.col("_f")[i] for i in range(9))
    names = F.array(*[F.lit(m.upper()) for m in MONTHS])
    hours = _int(hour)
    digits = F.length(F.regexp_extract("_number", r"^\d+", 0))
    value = F.when(F.col("_number") != "", F.col("_number")).cast("decimal(29,9)")
    read = split.select(
        *entries.columns,
        "_site",
        stated.alias("_stated"),
        _int(year).alias("_y"),
        F.when(month.rlike("^[A-Z]"), F.nullif(F.array_position(names, F.substring(month, 1, 3)).cast("int"), F.lit(0)))
        .otherwise(_int(F.when(month.rlike("^[0-9]"), month)))
        .alias("_mo"),
        _int(day).alias("_d"),
        F.when(half == "", hours)
        .when(hours.between(1, 12), hours % 12 + F.when(half == "PM", 12).otherwise(0))
        .alias("_h"),
        _int(minute).alias("_mi"),
        F.coalesce(_int(second), F.lit(0)).alias("_s"),
        (
            F.coalesce(F.rpad(F.substring(F.when(fraction != "", fraction), 1, 6), 6, "0").cast("long"), F.lit(0))
            + F.when(F.length(fraction) > 6, (F.substring(fraction, 7, 1) >= "5").cast("long")).otherwise(0)
        ).alias("_us"),
        F.round(
            F.when(digits <= 11, value * 1_000_000)
            .when(digits <= 14, value * 1_000)
            .when(digits <= 17, value)
            .otherwise(value / 1_000)
        )
        .cast("long")
        .alias("_unix"),
    )
    whole = [F.col(c) for c in ("_y", "_mo", "_d", "_h", "_mi")]
    whole.append(F.when(F.col("_s") < 60, F.col("_s")).cast("decimal(8,6)"))
    zone = F.coalesce(F.col("_site"), F.lit("UTC"))
    placed = read.withColumns(
        {
            "_utc": F.unix_micros(F.try_make_timestamp(*whole, F.lit("UTC"))),
            "_local": F.try_make_timestamp(*whole, zone),
            "_minutes": _offset_minutes(F.col("_stated")),
        }
    )
    exists = F.unix_micros(F.from_utc_timestamp("_local", zone)) == F.col("_utc")
    at_site = F.when(F.col("_site").isNotNull() & exists, F.unix_micros("_local"))
    at_stated = F.col("_utc") - F.col("_minutes").cast("long") * 60_000_000
    wall = F.when(F.col("_stated") == "", at_site).otherwise(at_stated) + F.col("_us")
    return placed.select(*entries.columns, F.coalesce(F.col("_unix"), wall).alias("utc_us"))


def to_ms(us: Column) -> Column:
    """Whole milliseconds, halves rounded up."""
    return F.floor((us + 500) / 1000)


def reading_entries(entries: DataFrame) -> DataFrame:
    """(value, system_s, synced_s) rows with ``utc_us`` of a sensor reading
    whose clock is told by its recording's two start times."""
    return entries.withColumn("utc_us", reading_us(F.col("value"), F.col("system_s"), F.col("synced_s")))


class Dictionary:
    """Incremental store of distinct entries, each parsed once.

    ``store`` is a folder that all executors share; ``None`` is one below
    ``spark.checkpoint.dir`` that later runs find again. A batch of fresh
    entries is written aside and renamed, so a reader never sees half of one;
    entries that two runs parsed at once count once.
    """

    KEYS: tuple[str, ...] = ()
    SCHEMA = T.StructType([])
    NAME = ""

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark = spark
        self.store = store or f"{shared_dir(spark)}/strandline/{self.NAME}"

    @staticmethod
    def parse(entries: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> DataFrame:
        path, fs = self._fs()
        batches = [str(f.getPath()) for f in fs.listStatus(path) if f.getPath().getName().startswith("batch-")] if fs.exists(path) else []
        if not batches:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*batches)
        return rows if len(batches) == 1 else rows.dropDuplicates(list(self.KEYS))

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        pairs = [left[k].eqNullSafe(right[f"_{k}"]) for k in self.KEYS]
        return reduce(lambda a, b: a & b, pairs)

    def update(self, rows: DataFrame) -> int:
        """Parse the entries of ``rows`` that the store lacks; their number."""
        distinct = rows.select(*self.KEYS).where(F.col(self.KEYS[0]).isNotNull()).distinct()
        old = self.entries().select(*[F.col(k).alias(f"_{k}") for k in self.KEYS])
        fresh = distinct.join(old, self._same(distinct, old), "left_anti")
        path, fs = self._fs()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        name = uuid.uuid4().hex
        aside = f"{self.store}/part-{name}"
        self.parse(fresh).write.parquet(aside)
        added = self.spark.read.schema(self.SCHEMA).parquet(aside).count()
        if added:
            fs.rename(hadoop.Path(aside), hadoop.Path(f"{self.store}/batch-{name}"))
        else:
            fs.delete(hadoop.Path(aside), True)
        return added

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``utc_us``, NULL where the entry denotes no instant.

        Entries that denote nothing are left out of the join's right side.
        Entries that very many rows repeat are spread by the planner's skew
        handling, which splits the rows and repeats the one entry.
        """
        known = self.entries().where(F.col("utc_us").isNotNull())
        known = known.select(*[F.col(k).alias(f"_{k}") for k in self.KEYS], F.col("utc_us"))
        return rows.join(known, self._same(rows, known), "left").drop(*[f"_{k}" for k in self.KEYS])


class TimestampDictionary(Dictionary):
    """Written times: distinct (raw string, zone, day/month order)."""

    KEYS = ("raw", "zone", "day_order")
    SCHEMA = DICTIONARY_SCHEMA
    NAME = f"times-{PARSER_VERSION}"
    parse = staticmethod(parse_entries)


class ReadingDictionary(Dictionary):
    """Sensor readings: distinct (value, start on the system clock, start on the sensor's clock)."""

    KEYS = ("value", "system_s", "synced_s")
    SCHEMA = T.StructType([*[T.StructField(k, T.DoubleType()) for k in KEYS], T.StructField("utc_us", T.LongType())])
    NAME = f"readings-{PARSER_VERSION}"
    parse = staticmethod(reading_entries)


def normalise(
    rows: DataFrame, raw: str, zone: str, day_order: str, out: str = "utc_us", dictionary: TimestampDictionary | None = None
) -> DataFrame:
    """Add ``out``: UTC microseconds of the text in ``raw``.

    Nulls, blank text, placeholders, unknown zones and impossible dates give
    NULL; no row is lost or multiplied, whatever other columns it has. Raises
    ``ValueError`` if ``out`` is already a column.
    """
    if out in rows.columns:
        raise ValueError(f"column {out} exists already")
    rows_struct = rows.select(F.struct("*").alias("_row"))
    keyed = rows_struct.select(
        "_row",
        F.col(f"_row.`{raw}`").cast("string").alias("raw"),
        F.col(f"_row.`{zone}`").alias("zone"),
        F.col(f"_row.`{day_order}`").alias("day_order"),
    )
    book = dictionary or TimestampDictionary(rows.sparkSession)
    book.update(keyed)
    return book.lookup(keyed).select("_row.*", F.col("utc_us").alias(out))


# ------------------------------------------------------------------ clocks

DAY_S = 86_400.0
#: Distances from the start whose microseconds fit a bigint.
LONGEST_S = 9e12
#: Microseconds a unit for the Unix clocks a sensor may fall back to.
UNIX_CLOCKS = {"unix_s": 1_000_000, "unix_ms": 1_000, "unix_us": 1, "unix_ns": 0.001}


def _clock_cases(value: Column, system_s: Column, synced_s: Column) -> list[tuple[str, Column, Column, Column]]:
    """(clock, whether it fits well, distance from the start in s, microseconds)
    in the order they are tried.

    A reading fits a clock well if it falls within a day from the start. The
    recording's own clock and the seconds since its start can both fit; then
    the nearer to the start holds. Unix clocks differ by their scale. Plain
    comparisons only, so that nothing is built or computed twice.
    """
    near = lambda gap: (gap > -1.0) & (gap < DAY_S)
    # floor(x + 0.5): rounding doubles by decimals costs several times as much
    whole = lambda x: F.floor(x + 0.5)
    start = whole(system_s * 1e6)
    own = value - synced_s
    relative = near(value)
    cases = [
        ("synced_s", near(own) & ~(relative & (F.abs(value) < F.abs(own))), F.abs(own), start + whole(own * 1e6)),
        ("relative_s", relative & synced_s.isNotNull(), F.abs(value), start + whole(value * 1e6)),
    ]
    for name, per in UNIX_CLOCKS.items():
        gap = value * (per / 1e6) - system_s
        cases.append((name, near(gap), F.abs(gap), whole(value * float(per))))
    return cases


def _by_clock(value: Column, system_s: Column, synced_s: Column, result: int | None) -> Column:
    cases = _clock_cases(value, system_s, synced_s)
    pick = lambda case: F.lit(case[0]) if result is None else case[result]
    out = F.when(value.isNull() | system_s.isNull(), None)
    for case in cases:
        out = out.when(case[1], pick(case))

    def nearest(_: Column) -> Column:
        least = F.least(*[case[2] for case in cases])
        far = F.when(F.isnan(value) | (least > LONGEST_S), None)
        for case in cases:
            far = far.when(case[2] == least, pick(case))
        return far

    # beyond a day of every clock: the one that comes nearest to the start. Rare,
    # so it is left to the interpreter and the generated code stays small
    return out.otherwise(F.get(F.transform(F.array(F.lit(0)), nearest), 0))


def clock_of(value: Column, start_system_s: Column, start_synced_s: Column) -> Column:
    """Clock a sensor time was read from: the recording's own clock
    (``synced_s``), seconds since the start (``relative_s``) or a Unix clock.
    A reading further than a day from the start on all of them has the clock
    that brings it nearest; NULL only if no number, without a start, or so far
    off that microseconds do not fit a bigint."""
    return _by_clock(value, start_system_s, start_synced_s, None)


def reading_us(value: Column, start_system_s: Column, start_synced_s: Column) -> Column:
    """UTC microseconds of a sensor reading, whatever clock it was read from."""
    return _by_clock(value, start_system_s, start_synced_s, 3)
