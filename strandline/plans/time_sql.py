"""SQL that states the instants of written times and of sensor readings."""

from __future__ import annotations

from strandline.operators.timestamps import ABBREVIATIONS, MONTHS, UNIX_CLOCKS

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AP]M)?"
_ZONE = r"\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3,5})?(?:\s*\[[A-Z_/+-]+\])?"
_BLANK = r"[\s\x{00a0}\x{2007}\x{202f}\x{feff}\x{200b}]+"

# pattern, and the group numbers of: year, month, day (a and b of numeric day and month), two separators, hour, minute, second, fraction, half, zone
_FORMS = {
    "year_first": (rf"^(\d{{4}})([-/.])(\d{{1,2}})([-/.])(\d{{1,2}})[T ]\s*{_CLOCK}{_ZONE}$", (1, 3, 5, 2, 4, 6, 7, 8, 9, 10, 11)),
    "year_last": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})([-/.])(\d{{4}})[T ,]\s*{_CLOCK}{_ZONE}$", (5, 3, 1, 2, 4, 6, 7, 8, 9, 10, 11)),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", (1, 2, 3, 0, 0, 4, 5, 6, 7, 0, 8)),
    "day_name": (rf"^(?:[A-Z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Z]{{3,9}})[ -](\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 0, 0, 4, 5, 6, 7, 8, 9)),
    "name_day": (rf"^(?:[A-Z]{{3,9}},?\s+)?([A-Z]{{3,9}})\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 1, 2, 0, 0, 4, 5, 6, 7, 8, 9)),
}
_NAMES = ("y", "mo", "d", "s1", "s2", "h", "mi", "s", "f", "half", "z")


def _branch(name: str) -> str:
    pattern, groups = _FORMS[name]
    # group numbers end at 9, named groups do not
    names = ", ".join(f"'g{i}'" for i in range(1, max(groups) + 1))
    parts = {n: f"regexp_extract(x, '{pattern}', [{names}]).g{g}" if g else "''" for n, g in zip(_NAMES, groups, strict=True)}
    if name == "year_last":
        parts["mo"], parts["d"] = (f"CASE WHEN day_order = 'dmy' THEN {a} ELSE {b} END" for a, b in ((parts["mo"], parts["d"]), (parts["d"], parts["mo"])))
    packed = ", ".join(f"{n} := {v}" for n, v in parts.items())
    return f"WHEN regexp_matches(x, '{pattern}') THEN struct_pack({packed}, form := '{name}')"


_MONTH_LIST = "[" + ", ".join(f"'{m.upper()}'" for m in MONTHS) + "]"
_ABBREVIATION = "CASE z " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"
_DIGITS = "regexp_replace(z, '[^0-9]', '', 'g')"

#: CTEs after ``written(field_name, record_id, raw, zone, day_order)``; ``instants`` has utc_us as well.
INSTANTS_SQL = rf"""
t AS (SELECT *, upper(regexp_replace(raw, '^{_BLANK}|{_BLANK}$', '', 'g')) AS x FROM written),
p AS (SELECT *, CASE {" ".join(_branch(n) for n in _FORMS)} END AS m, regexp_extract(x, '^(\d{{9,19}})(?:\.(\d{{1,9}}))?$', ['i', 'r']) AS num FROM t),
v AS (SELECT field_name, record_id, zone, m.z AS z, num, m.form AS form,
  TRY_CAST(m.y AS INTEGER) AS y, CASE WHEN regexp_matches(m.mo, '^[A-Z]') THEN nullif(list_position({_MONTH_LIST}, substr(m.mo, 1, 3)), 0) ELSE TRY_CAST(m.mo AS INTEGER) END AS mo,
  TRY_CAST(m.d AS INTEGER) AS d, CASE WHEN m.half = '' THEN TRY_CAST(m.h AS INTEGER) WHEN TRY_CAST(m.h AS INTEGER) BETWEEN 1 AND 12 THEN TRY_CAST(m.h AS INTEGER) % 12 + CASE WHEN m.half = 'PM' THEN 12 ELSE 0 END END AS h,
  TRY_CAST(m.mi AS INTEGER) AS mi, coalesce(TRY_CAST(nullif(m.s, '') AS INTEGER), 0) AS s,
  CASE WHEN m.f <> '' THEN CAST(rpad(substr(m.f, 1, 6), 6, '0') AS BIGINT) + CASE WHEN substr(m.f, 7, 1) >= '5' THEN 1 ELSE 0 END ELSE 0 END AS us,
  m.s1 IS NOT DISTINCT FROM m.s2 AS same FROM p),
w AS (SELECT *, TRY_CAST(CASE WHEN same AND h < 24 AND s < 60 THEN printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) END AS TIMESTAMP) AS wall,
  CASE WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN CAST(substr({_DIGITS}, 1, 2) AS INTEGER) <= 15 AND coalesce(TRY_CAST(nullif(substr({_DIGITS}, 3, 2), '') AS INTEGER), 0) < 60
    THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr({_DIGITS}, 1, 2) AS INTEGER) * 60 + coalesce(TRY_CAST(nullif(substr({_DIGITS}, 3, 2), '') AS INTEGER), 0)) END
    ELSE {_ABBREVIATION} END AS minutes,
  CASE WHEN num.i <> '' THEN CAST(num.i || rpad(coalesce(num.r, ''), 9, '0') AS HUGEINT) END AS nanos FROM v),
z0 AS (SELECT *, CASE WHEN z = '' AND zone IN (SELECT name FROM pg_timezone_names()) THEN timezone(zone, wall) END AS placed FROM w),
z1 AS (SELECT *, CASE WHEN timezone(zone, placed - INTERVAL 1 HOUR) = wall THEN placed - INTERVAL 1 HOUR WHEN timezone(zone, placed) = wall THEN placed END AS first FROM z0),
instants AS (SELECT field_name, record_id, CAST(CASE
    WHEN length(num.i) BETWEEN 9 AND 11 THEN (nanos + 500) // 1000 WHEN length(num.i) BETWEEN 12 AND 14 THEN (nanos + 500000) // 1000000
    WHEN length(num.i) BETWEEN 15 AND 17 THEN (nanos + 500000000) // 1000000000 WHEN length(num.i) >= 18 THEN (nanos + 500000000000) // 1000000000000
    WHEN z = '' THEN epoch_us(first) + us ELSE epoch_us(wall) - CAST(minutes AS BIGINT) * 60000000 + us END AS BIGINT) AS utc_us FROM z1)
"""

_NEAR = "({0} > -1.0 AND {0} < 86400.0)"
_OWN = "(world_timestamp - start_time_synced_s)"
_START = "floor(start_time_system_s * 1e6 + 0.5)"
_UNIX = " ".join(
    f"WHEN {_NEAR.format(f'(world_timestamp * {float(per) / 1e6!r} - start_time_system_s)')} THEN struct_pack(clock := '{name}', us := floor(world_timestamp * {float(per)!r} + 0.5))"
    for name, per in UNIX_CLOCKS.items()
)
#: CTE of the gaze samples with their clock and microseconds, each id once.
READINGS_SQL = f"""
readings AS (SELECT sample_id, recording_id, CASE
    WHEN {_NEAR.format(_OWN)} AND NOT ({_NEAR.format("world_timestamp")} AND abs(world_timestamp) < abs({_OWN})) THEN struct_pack(clock := 'synced_s', us := {_START} + floor({_OWN} * 1e6 + 0.5))
    WHEN {_NEAR.format("world_timestamp")} AND start_time_synced_s IS NOT NULL THEN struct_pack(clock := 'relative_s', us := {_START} + floor(world_timestamp * 1e6 + 0.5))
    {_UNIX} END AS r
  FROM (SELECT DISTINCT ON (sample_id) * FROM gaze_samples) JOIN (SELECT DISTINCT ON (recording_id) * FROM recordings) USING (recording_id))
"""

_SITES = "(SELECT DISTINCT ON (recording_id) recording_id, site_zone AS zone, site_date_order AS day_order FROM recordings)"
VIDEO_SQL = f"""SELECT 'video_start_time' AS field_name, timing_id AS record_id, video_start_time AS raw, zone, day_order
  FROM (SELECT DISTINCT ON (timing_id) * FROM video_timings) LEFT JOIN {_SITES} USING (recording_id)"""
CREATED_SQL = f"""SELECT 'created', response_id, created, zone, day_order
  FROM (SELECT DISTINCT ON (response_id) * FROM selected_responses) LEFT JOIN {_SITES} USING (recording_id)"""

P1_SQL = f"""WITH written AS ({VIDEO_SQL} UNION ALL {CREATED_SQL}), {INSTANTS_SQL}, {READINGS_SQL}
SELECT field_name, record_id, CAST(floor((utc_us + 500) / 1000) AS BIGINT) AS utc_ms FROM instants WHERE utc_us IS NOT NULL
UNION ALL SELECT 'world_timestamp', sample_id, CAST(floor((r.us + 500) / 1000) AS BIGINT) FROM readings WHERE r.clock <> 'synced_s'"""

P4_SQL = f"""WITH written AS ({VIDEO_SQL}), {INSTANTS_SQL}, {READINGS_SQL},
clips AS (SELECT i.record_id AS timing_id, v.recording_id, CAST(floor((i.utc_us + 500) / 1000) AS BIGINT) + CAST(round(v.current_video_time * 1000) AS BIGINT) AS at_ms
  FROM instants i JOIN (SELECT DISTINCT ON (timing_id) * FROM video_timings) v ON v.timing_id = i.record_id WHERE i.utc_us IS NOT NULL AND abs(v.current_video_time) < 1e9),
g AS (SELECT recording_id, CAST(floor((r.us + 500) / 1000) AS BIGINT) AS ms, min(sample_id) AS sample_id FROM readings WHERE r IS NOT NULL GROUP BY ALL),
b AS (SELECT c.*, g.ms AS bms, g.sample_id AS bid FROM clips c ASOF LEFT JOIN g ON c.recording_id = g.recording_id AND c.at_ms >= g.ms),
a AS (SELECT b.*, g.ms AS ams, g.sample_id AS aid FROM b ASOF LEFT JOIN g ON b.recording_id = g.recording_id AND b.at_ms <= g.ms)
SELECT timing_id, CASE WHEN ams IS NULL OR at_ms - bms <= ams - at_ms THEN bid ELSE aid END AS sample_id FROM a
WHERE least(coalesce(at_ms - bms, 1000), coalesce(ams - at_ms, 1000)) <= 20"""
