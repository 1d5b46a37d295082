"""Header grammars: a log format is an ordered list of header patterns with named groups, compiled to column expressions.

Groups that mean something: host, statement, year, month (number), mon (English abbreviation), day, time (HH:MM:SS), hour, minute, second,
date (year-month-day), date6 (yymmdd), date8 (yyyymmdd), time6 (hhmmss), year2, unixtime, lid. All others are kept in a map.
"""

from __future__ import annotations

import os
import re
import runpy
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_KNOWN = {"host", "statement", "year", "month", "mon", "day", "time", "hour", "minute", "second", "date", "date6", "date8", "time6", "year2", "unixtime", "lid"}


@dataclass
class LogFormat:
    """Patterns are tried in order on a whole line; the first that matches gives all fields. year: for headers without one."""

    name: str
    patterns: list[str]
    year: int | None = None
    extras: list[str] = field(default_factory=list)

    def matched(self, line: Column) -> Column:
        """The number of the first pattern that matches, else null."""
        return F.coalesce(*(F.when(line.rlike(f"^(?:{self._java(p)})$"), F.lit(i)) for i, p in enumerate(self.patterns)))

    @staticmethod
    def _java(pattern: str) -> str:
        return pattern.replace("(?P<", "(?<")

    def group(self, line: Column, name: str) -> Column:
        """The named group of the pattern that matches, null if it has none or the group took no part."""
        which = self.matched(line)
        out = F.lit(None).cast("string")
        for i, p in enumerate(self.patterns):
            groups = re.compile(p).groupindex
            if name in groups:
                value = F.regexp_extract(line, f"^(?:{self._java(p)})$", groups[name])
                out = F.when(which == i, F.when(value != "", value)).otherwise(out)
        return out

    def names(self) -> list[str]:
        return sorted({n for p in self.patterns for n in re.compile(p).groupindex})

    def fields(self, line: Column) -> dict[str, Column]:
        return {n: self.group(line, n) for n in self.names()}

    def timestamp(self, f: dict[str, Column]) -> Column:
        """A timestamp without zone, of second precision, from whatever date and time groups there are; null if impossible."""
        no = F.lit(None).cast("string")
        get = lambda n: f.get(n, no)
        month_number = F.when(get("mon").isNotNull(), F.array_position(F.array(*map(F.lit, MONTHS)), get("mon")).cast("string"))
        month = F.coalesce(get("month"), month_number, F.substring(get("date"), 6, 2), F.substring(get("date8"), 5, 2), F.substring(get("date6"), 3, 2))
        century = lambda x: F.concat(F.when(x.cast("int") < 70, "20").otherwise("19"), x)
        year = F.coalesce(
            get("year"), F.substring(get("date"), 1, 4), F.substring(get("date8"), 1, 4), century(F.substring(get("date6"), 1, 2)), century(get("year2")), F.lit(self.year).cast("string")
        )
        day = F.coalesce(get("day"), F.substring(get("date"), 9, 2), F.substring(get("date8"), 7, 2), F.substring(get("date6"), 5, 2))
        pick = lambda i: F.split(get("time"), ":")[i]
        hour, minute, second = (F.coalesce(get(n), F.when(get("time").isNotNull(), pick(i)), F.substring(get("time6"), 2 * i + 1, 2)) for i, n in enumerate(("hour", "minute", "second")))
        text = F.concat_ws("", F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"), F.lit(":"), F.lpad(second, 2, "0"))
        whole = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & hour.isNotNull(), text).try_cast("timestamp_ntz")
        unix = F.timestamp_seconds(get("unixtime").cast("long")).cast("timestamp_ntz")
        return F.coalesce(whole, unix)


_TIME = r"(?P<time>\d{1,2}:\d{2}:\d{2})"
_SYSLOG = rf"(?P<mon>[A-Z][a-z]{{2}})\s+(?P<day>\d{{1,2}})\s+{_TIME}\s+(?P<host>\S+)\s+"
_BARE = r"(?P<statement>.*)"
_DATE = r"(?P<date>\d{4}-\d{2}-\d{2})"

#: Header grammars of public data sets, from the fields that their headers have.
FORMATS = {
    "syslog": [rf"(?P<year>\d{{4}})-(?P<month>\d{{2}})-(?P<day>\d{{2}})[ T]{_TIME}(?:\.\d+)?\s+(?P<host>\S+)\s+{_BARE}", rf"(?:(?P<year>\d{{4}})\s+)?{_SYSLOG}{_BARE}"],
    "Android": [rf"(?P<month>\d\d)-(?P<day>\d\d)\s+{_TIME}(?:\.\d+)?\s+(?P<pid>\d+)\s+(?P<tid>\d+)\s+(?P<level>[A-Z])\s+(?P<component>[^:]+):\s*{_BARE}"],
    "Apache": [rf"\[(?P<weekday>\w+) (?P<mon>\w{{3}}) (?P<day>\d+) {_TIME} (?P<year>\d{{4}})\] \[(?P<severity>\w+)\] {_BARE}", _BARE],
    "BGL": [
        r"(?P<label>\S+) (?P<unix>\d+) \d{4}\.\d\d\.\d\d (?P<node>\S+) (?P<year>\d{4})-(?P<month>\d\d)-(?P<day>\d\d)-(?P<hour>\d\d)\.(?P<minute>\d\d)\.(?P<second>\d\d)(?:\.\d+)? "
        r"(?P<host>\S+) (?P<type>\S+) (?P<component>\S+) (?P<level>\S+)(?: (?P<statement>.*))?"
    ],
    "HDFS": [rf"(?P<date6>\d{{6}}) (?P<time6>\d{{6}}) (?P<processid>\d+) (?P<level>\w+) (?P<component>[a-zA-Z0-9.$]+):\s*{_BARE}"],
    "HPC": [rf"(?P<logid>\d+)(?: (?P<class>[A-Za-z]+(?= \S+ \S+ \S+ \d)))?(?: (?P<node>[a-zA-Z0-9-]+))? (?P<component>[a-zA-Z._-]+) (?P<state>[a-zA-Z._-]+) (?P<unixtime>\d{{9,10}}) (?P<flag>[0-9-]+) {_BARE}"],
    "Hadoop": [rf"{_DATE} {_TIME},\d+ (?P<level>\w+) \[(?P<process>.+?)\] (?P<component>[a-zA-Z0-9.$]+): {_BARE}", _BARE],
    "Linux": [rf"{_SYSLOG}(?P<component>.+?)(?:\[(?P<processid>\d+)\])?: {_BARE}", _SYSLOG + _BARE],
    "Mac": [rf"{_SYSLOG}(?P<component>.+?)\[(?P<processid>\d+)\](?: \([^)]*\))?: {_BARE}", rf"(?P<mon>[A-Z][a-z]{{2}})\s+(?P<day>\d{{1,2}})\s+{_TIME}[\s:\[\]]+---[\s:\[\]]+{_BARE}", _BARE],
    "OpenSSH": [rf"{_SYSLOG}(?P<component>[a-zA-Z0-9()._-]+)(?:\[(?P<processid>\d+)\])?:?\s+{_BARE}"],
    "OpenStack": [rf"(?P<file>\S+) {_DATE} {_TIME}(?:\.\d+)? (?P<processid>\d+) (?P<level>\w+) (?P<host>\S+) \[(?P<address>[a-zA-Z0-9 -]+)\] {_BARE}", _BARE],
    "Proxifier": [rf"\[(?P<month>\d\d)\.(?P<day>\d\d) {_TIME}\] (?P<program>.+?) - {_BARE}", rf"\[(?P<month>\d\d)\.(?P<day>\d\d) {_TIME}\] {_BARE}"],
    "Spark": [rf"(?P<year2>\d\d)/(?P<month>\d\d)/(?P<day>\d\d) {_TIME} (?P<level>\w+) (?P<component>[a-zA-Z0-9.$]+): {_BARE}", _BARE],
    "Thunderbird": [
        rf"(?P<label>-|[A-Z]+) (?P<unix>\d+) (?P<year>\d{{4}})\.\d\d\.\d\d (?P<host>[a-zA-Z0-9:#-]+) (?P<mon>[A-Z][a-z]{{2}})\s+(?P<day>\d+) {_TIME} (?P<location>[a-zA-Z0-9/@#-]+) (?P<component>.+?)(?:\[(?P<processid>\d+)\])?: {_BARE}",
        rf"(?P<label>-|[A-Z]+) (?P<unix>\d+) (?P<year>\d{{4}})\.\d\d\.\d\d (?P<host>[a-zA-Z0-9:#-]+) (?P<mon>[A-Z][a-z]{{2}})\s+(?P<day>\d+) {_TIME} (?P<location>[a-zA-Z0-9/@#-]+) ?{_BARE}",
    ],
    "Windows": [rf"{_DATE} {_TIME}, (?P<level>\w+)\s+(?P<component>\w+)\s+{_BARE}", _BARE],
    "Zookeeper": [rf"{_DATE} {_TIME},\d+ - (?P<level>\w+)\s+\[(?P<component>.*)\] - {_BARE}"],
}


def log_format(name: str, year: int | None = None) -> LogFormat:
    """A known grammar, or that of a script of the user's; ``year`` completes headers that have none."""
    if name.endswith(".py"):
        return load_format(name, year)
    return LogFormat(name, FORMATS[name], year)


def load_format(path: str, year: int | None = None) -> LogFormat:
    """The grammar of a Python file on the driver, which defines PATTERNS, a list of header patterns."""
    found = runpy.run_path(path)
    if not isinstance(found.get("PATTERNS"), list):
        raise ValueError(f"{path} defines no list PATTERNS")
    return LogFormat(os.path.basename(path).removesuffix(".py"), found["PATTERNS"], year)
