"""Date and time functions, and the translation of PostgreSQL patterns to Java's."""

from __future__ import annotations

import re

from .registry import define

#: PostgreSQL template patterns and their java.time letters.
PATTERNS = {
    "YYYY": "yyyy", "YYY": "yyy", "YY": "yy", "MM": "MM", "MON": "MMM", "Mon": "MMM", "MONTH": "MMMM", "Month": "MMMM", "DDD": "DDD", "DD": "dd", "DY": "EEE", "Dy": "EEE", "DAY": "EEEE", "Day": "EEEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "q",
}


def java_pattern(pattern: str) -> str:
    """yyyy-MM-dd for YYYY-MM-DD; lower-case letters count as upper-case; quoted text stays; what is unknown is quoted."""
    out, at = [], 0
    names = sorted(PATTERNS, key=len, reverse=True)
    while at < len(pattern):
        if pattern[at] == '"':
            end = pattern.find('"', at + 1)
            end = len(pattern) if end < 0 else end
            out.append("'" + pattern[at + 1 : end].replace("'", "''") + "'")
            at = end + 1
            continue
        found = next((n for n in names if pattern[at : at + len(n)].upper() == n.upper()), None)
        if found:
            out.append(PATTERNS[found])
            at += len(found)
        else:
            c = pattern[at]
            out.append(f"'{c}'" if re.match("[A-Za-z]", c) else "''" if c == "'" else c)
            at += 1
    return "".join(out).replace("''", "") if "'" not in pattern else "".join(out)


DATE_PARTS = {
    "century": "ceil(year({0}) / 100.0)", "millennium": "ceil(year({0}) / 1000.0)", "decade": "floor(year({0}) / 10)", "dow": "dayofweek({0}) - 1", "isodow": "weekday({0}) + 1", "doy": "dayofyear({0})",
    "epoch": "unix_micros(cast({0} as timestamp)) / 1e6", "year": "year({0})", "isoyear": "extract(yearofweek from {0})", "quarter": "quarter({0})", "month": "month({0})", "week": "weekofyear({0})", "day": "day({0})",
    "hour": "hour({0})", "minute": "minute({0})", "second": "extract(second from {0})", "milliseconds": "extract(second from {0}) * 1000", "microseconds": "extract(second from {0}) * 1000000",
    "timezone": "null", "timezone_hour": "null", "timezone_minute": "null",
}


def date_part(field: str, value: str) -> str:
    """Spark SQL of date_part(field, value): a double, as in the dialect."""
    template = DATE_PARTS.get(field.lower().strip("'"))
    if template is None:
        raise ValueError(f"unknown field of date_part: {field}")
    return f"cast({template.format('(' + value + ')')} as double)"


define("add_days", "cast({0} as timestamp) + make_dt_interval(cast({1} as int))", 2)
define("add_months", "cast({0} as timestamp) + make_ym_interval(0, cast({1} as int))", 2)
define("now", "current_timestamp()", 0)
define("current_time", "date_format(current_timestamp(), 'HH:mm:ss')", 0)
define("to_timestamp", "timestamp_seconds({0})", 1)
_UNIT = "case lower({0}) when 'day' then unix_micros(date_trunc('DAY', timestamp_micros({1}))) when 'hour' then unix_micros(date_trunc('HOUR', timestamp_micros({1}))) when 'month' then unix_micros(date_trunc('MONTH', timestamp_micros({1}))) when 'year' then unix_micros(date_trunc('YEAR', timestamp_micros({1}))) end"
define("utc_usec_to", _UNIT, 2)
define("utc_usec_to", "unix_micros(cast(date_add(date_trunc('DAY', timestamp_micros({1})), {2} - (dayofweek(timestamp_micros({1})) - 1)) as timestamp))", 3)
