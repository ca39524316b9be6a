"""Mixed timestamp formats and zones, normalised through a dictionary of distinct raw values.

Each distinct (source, raw string, zone, date order) is parsed once. The dictionary is a Parquet table in the shared
folder that outlives the application: a later call parses only the keys it lacks. Rows then get their instants by a join.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.operators.skew import hot_keys, spread_join
from evidloom.session import materialize, shared_dir

PARSER_VERSION = 2
KEY = ["source", "raw", "home_zone", "date_order"]
DICTIONARY_SCHEMA = "source string, raw string, home_zone string, date_order string, utc_second bigint, utc_nanos int, verdict string"
ISO_UTC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"

# Abbreviations in minutes east of UTC; those with several meanings in the world denote an instant only if
# the home zone uses them.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "AEST": 600, "AEDT": 660, "NDT": -150,
    "EDT": -240, "MDT": -360, "PDT": -420,
}
AMBIGUOUS = frozenset("ADT AMT AST BST CDT CST ECT EST GST IST MST NST PST SST WST".split())
# Month names, English and German.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "okt": 10, "dez": 12, "mrz": 3,
}
# Zero-width characters that may surround a value.
_INVISIBLE = dict.fromkeys((0x200B, 0x2060, 0xFEFF))
# Weekdays by their first letters, English and German.
WEEKDAYS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6, "die": 1, "mit": 2, "don": 3, "fre": 4, "sam": 5, "son": 6}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_WEEKDAY = r"(?:(?P<wd>[a-z]{3,10})\.?,?\s+)?"
_TAIL = r"(?P<tail>.*)"
_FORMS = [
    re.compile(p, re.I | re.S)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<mo>\d{{2}})-(?P<d>\d{{2}})(?:T|\s+){_TIME}{_TAIL}",
        rf"(?P<y>\d{{4}})/(?P<mo>\d{{1,2}})/(?P<d>\d{{1,2}})(?:T|,?\s+){_TIME}{_TAIL}",
        rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<f>\d+))?{_TAIL}",
        rf"(?P<y>(?:19|20)\d{{2}})(?P<mo>\d{{2}})(?P<d>\d{{2}})(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?(?P<tail>(?!\d).*)",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})\.(?P<mo>\d{{1,2}})\.(?P<y>\d{{4}}|\d{{2}}),?\s+{_TIME}{_TAIL}",
        rf"(?P<n1>\d{{1,2}})/(?P<n2>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}),?\s+{_TIME}{_TAIL}",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\s+(?P<mon>[a-zä]+)\.?,?\s+(?P<y>\d{{4}}),?\s+(?:at\s+|um\s+)?{_TIME}{_TAIL}",
        rf"{_WEEKDAY}(?P<mon>[a-zä]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{_TIME}{_TAIL}",
        rf"{_WEEKDAY}(?P<mon>[a-z]+)\.?\s+(?P<d>\d{{1,2}})\s+{_TIME}\s+(?:(?P<mid>[A-Z]{{1,5}}|[+-]\d{{2}}:?\d{{2}})\s+)?(?P<y>\d{{4}})(?P<tail>\s*)",
        rf"(?P<d>\d{{1,2}})-(?P<mon>[a-zä]{{3,9}})-(?P<y>\d{{4}}|\d{{2}})(?:,?\s+|T|:){_TIME}{_TAIL}",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})\.\s*(?P<mon>[a-zä]+)\.?\s+(?P<y>\d{{4}}),?\s+(?:um\s+)?{_TIME}{_TAIL}",
    )
]
_DATE_ONLY = re.compile(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{8}|\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})|\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|\d{1,2}\.?\s+[a-zä]+\.?\s+\d{4}|[a-zä]+\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}-[a-zä]{3,9}-\d{4}", re.I)
_REST = re.compile(r"\s*(?P<half>[AP]\.?M\.?(?![A-Za-z]))?\s*(?:Uhr(?![A-Za-z]))?\s*(?:(?:UTC|GMT)(?=[+-]\d))?(?P<off>Z|[+-]\d{2}:?\d{2}|[+-]\d{1,2})?\s*(?:[\[(]?(?P<zone>[A-Za-z]+(?:[/_+-][A-Za-z0-9]+)+|[A-Za-z]{1,5})[\])]?)?\s*", re.I)
_EPOCH = re.compile(r"(?P<sign>-?)(?P<n>\d+)(?:[.,](?P<f>\d+))?")
#: Digits of an epoch and what a second has of its unit; seconds of 9 digits lie between 1973 and 2001.
_EPOCH_UNIT = {9: 1, 10: 1, 12: 10**3, 13: 10**3, 16: 10**6, 19: 10**9}


def _epoch(text: str) -> tuple[int, int] | None:
    """(second, nanoseconds) of a number since 1970; fractions only of seconds, a minus sign for what lies before."""
    m = _EPOCH.fullmatch(text) if text.isascii() else None
    unit = _EPOCH_UNIT.get(len(m["n"])) if m else None
    if unit is None or m["f"] and unit != 1 or len(m["n"]) == 12 and not m["sign"]:
        return None
    nanos = int(m["n"]) * (10**9 // unit) + int((m["f"] or "0")[:9].ljust(9, "0"))
    return divmod(-nanos if m["sign"] else nanos, 10**9)


@lru_cache(512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ValueError, KeyError, OSError):
        return None


def _at_zone(wall: dt.datetime, zone: ZoneInfo) -> tuple[int | None, str]:
    """The one instant of a wall-clock time; a repeated or skipped time has none."""
    found = set()
    for fold in (0, 1):
        utc = wall.replace(tzinfo=zone, fold=fold).astimezone(dt.UTC)
        if utc.astimezone(zone).replace(tzinfo=None) == wall:
            found.add(utc)
    if len(found) == 1:
        return int((found.pop() - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()), "instant"
    return None, "local_time_repeats" if found else "local_time_skipped"


def _date(parts: dict, order: str | None) -> tuple[dt.date | None, str]:
    y = int(parts["y"])
    if len(parts["y"]) == 2:  # as POSIX has it
        y += 2000 if y < 69 else 1900
    if parts.get("n1"):
        a, b = int(parts["n1"]), int(parts["n2"])
        pairs = {"dmy": [(b, a)], "mdy": [(a, b)]}.get(order or "", [(b, a), (a, b)])
    else:
        month = int(parts["mo"]) if parts.get("mo") else MONTHS.get(parts["mon"].lower())
        if month is None:
            return None, "unparsed"
        pairs = [(month, int(parts["d"]))]
    dates = set()
    for month, day in pairs:
        try:
            dates.add(dt.date(y, month, day))
        except ValueError:
            pass
    if len(dates) != 1:
        return None, "date_order_unknown" if dates else "impossible"
    day = dates.pop()
    if parts.get("wd") and WEEKDAYS.get(parts["wd"].lower()[:3], {"mo": 0, "di": 1, "mi": 2, "do": 3, "fr": 4, "sa": 5, "so": 6}.get(parts["wd"].lower())) != day.weekday():
        return None, "impossible"
    return day, ""


def _home_offset(wall: dt.datetime, abbreviation: str, home_zone: str | None) -> dt.timedelta | None:
    """The offset that the home zone has at a wall-clock time under this abbreviation."""
    home = _zone(home_zone) if home_zone else None
    fits = {x.utcoffset() for fold in (0, 1) if home and (x := wall.replace(tzinfo=home, fold=fold)).tzname() == abbreviation}
    return fits.pop() if len(fits) == 1 else None


def parse_instant(raw: str | None, home_zone: str | None, date_order: str | None) -> tuple[int | None, int | None, str]:
    """(UTC second, nanoseconds, verdict) of one typed value.

    verdict is `instant`, or says why there is none: `blank`, `date_only`, `no_zone`, `date_order_unknown`,
    `local_time_repeats`, `local_time_skipped`, `zone_ambiguous`, `impossible`, `unparsed`.

    An abbreviation that the home zone uses at that time means the home zone's offset. Otherwise it must have one meaning
    only. Years of two digits are 1969 to 2068; of a fraction nine digits count.
    """
    text = (raw or "").translate(_INVISIBLE).strip()
    if not text:
        return None, None, "blank"
    if (since := _epoch(text)) is not None:
        return *since, "instant"
    if _DATE_ONLY.fullmatch(text):
        return None, None, "date_only"
    for form in _FORMS:
        if m := form.fullmatch(text):
            break
    else:
        return None, None, "unparsed"
    parts = m.groupdict()
    rest = _REST.fullmatch(parts.get("mid") or parts["tail"])
    if not rest:
        return None, None, "unparsed"
    day, why = _date(parts, date_order)
    if day is None:
        return None, None, why
    hour, minute, second = int(parts["h"]), int(parts["mi"]), int(parts["s"] or 0)
    nanos = int((parts.get("f") or "0")[:9].ljust(9, "0"))
    if half := (rest["half"] or "").replace(".", "").upper():
        if not 1 <= hour <= 12:
            return None, None, "impossible"
        hour = hour % 12 + 12 * (half == "PM")
    try:
        wall = dt.datetime(day.year, day.month, day.day, hour, minute, second)
    except ValueError:
        return None, None, "impossible"
    offset, zone = rest["off"], rest["zone"]
    minutes = None
    if offset:
        if offset in "Zz":
            minutes = 0
        else:
            digits = offset[1:].replace(":", "")
            digits = (digits if len(digits) > 1 else f"0{digits}").ljust(4, "0")
            if int(digits[:2]) > 18 or int(digits[2:]) > 59:
                return None, None, "impossible"
            minutes = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if offset[0] == "-" else 1)
    elif zone and "/" not in zone:
        if (own := _home_offset(wall, zone.upper(), home_zone)) is not None:
            return int((wall - dt.datetime(1970, 1, 1) - own).total_seconds()), nanos, "instant"
        if zone.upper() in AMBIGUOUS:
            return None, None, "zone_ambiguous"
        if zone.upper() in ABBREVIATIONS:
            minutes, zone = ABBREVIATIONS[zone.upper()], None
    if minutes is not None:
        epoch = int((wall - dt.datetime(1970, 1, 1)).total_seconds()) - 60 * minutes
        if zone and zone.upper() not in ABBREVIATIONS and zone.upper() not in AMBIGUOUS:
            named = _zone(zone)
            if named is None:
                return None, None, "unparsed"
            if dt.datetime.fromtimestamp(epoch, named).replace(tzinfo=None) != wall:
                return None, None, "impossible"
        return epoch, nanos, "instant"
    if zone:
        named = _zone(zone) if "/" in zone else None
        if named is None:
            return None, None, "unparsed"
    else:
        named = _zone(home_zone) if home_zone else None
        if named is None:
            return None, None, "no_zone"
    epoch, verdict = _at_zone(wall, named)
    return epoch, nanos if epoch is not None else None, verdict


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [parse_instant(*k) for k in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:4], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())],
            names=[*KEY, "utc_second", "utc_nanos", "verdict"],
        )


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@lru_cache(1)
def zone_rules() -> str:
    """The version of the time zone rules in use, or `unknown`."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            if (file := Path(folder, name)).is_file():
                with file.open() as f:
                    return re.sub(r"\W", "", f.readline().rpartition(" ")[2]) or "unknown"
    try:
        import tzdata

        return tzdata.__version__
    except ImportError:
        return "unknown"


def dictionary_path(spark) -> str:
    """Where the dictionary of this parser and these zone rules is, for all applications that share the folder."""
    return f"{shared_dir(spark)}/evidloom-instants/parser{PARSER_VERSION}-zones{zone_rules()}"


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """Add the keys (KEY) that the dictionary at `path` lacks; returns its rows for these keys, each once.

    Repeated keys are parsed once. Appending is safe to repeat: parsing is a pure function of the key, and equal keys of
    two applications that appended at the same time are collapsed here.
    """
    spark = keys.sparkSession
    needed = materialize(keys.select(*KEY).distinct(), "instant-keys")
    same = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in KEY]

    def known() -> DataFrame:
        whole = spark.read.schema(DICTIONARY_SCHEMA).parquet(path)
        return whole.select(*same, "utc_second", "utc_nanos", "verdict")

    new = needed.select(*same)
    if _exists(spark, path):
        new = new.join(known().select(*KEY), KEY, "left_anti")
    new.mapInArrow(_parse_batches, DICTIONARY_SCHEMA).write.mode("append").parquet(path)
    mine = known().join(needed.select(*same), KEY, "left_semi")
    return mine.groupBy(*KEY).agg(F.first("utc_second").alias("utc_second"), F.first("utc_nanos").alias("utc_nanos"), F.first("verdict").alias("verdict"))


def normalize_timestamps(rows: DataFrame, raw: str, zone: str, order: str, dictionary: str | None = None, source: str | None = None) -> DataFrame:
    """All rows with `utc_second`, `utc_nanos` and `verdict` added (a column of the input with such a name is replaced).

    raw, zone, order, source: names of the columns with the typed string, the IANA zone for values without one, `dmy` or
    `mdy`, and, if any, where the value comes from. dictionary: by default dictionary_path(). Null and blank strings get
    verdict `blank` without entering the dictionary, so that a table full of them does not make one hot join key; the
    rows of other frequent values are dealt to several tasks. Rows are kept as they are, repeated ones included; an empty
    table gives an empty one.
    """
    path = dictionary or dictionary_path(rows.sparkSession)
    kept = rows.drop("utc_second", "utc_nanos", "verdict")
    filled = F.length(F.trim(F.coalesce(F.col(raw), F.lit("")))) > 0
    own = [F.lit("") if c is None else F.coalesce(F.col(c), F.lit("")) for c in (source, raw, zone, order)]
    named = [f"_k_{c}" for c in KEY]
    keyed = kept.where(filled).select("*", *(o.alias(n) for o, n in zip(own, named, strict=True)))
    keys = keyed.select(*(F.col(n).alias(c) for n, c in zip(named, KEY, strict=True)))
    # hot keys are marked by a hash, so that what is broadcast of them does not depend on how long the values are
    mark = F.xxhash64(*named).alias("_mark")
    found = extend_dictionary(keys, path).select(*(F.col(c).alias(n) for n, c in zip(named, KEY, strict=True)), "utc_second", "utc_nanos", "verdict").select("*", mark)
    marked = keyed.select("*", mark)
    hot = hot_keys(marked.select("_mark"), ["_mark"])
    salt = [c for c in kept.columns if c not in (source, raw, zone, order)] or [raw]
    on = ["_mark", *named]
    joined = spread_join(marked, found, on, salt, hot, "left")
    blank = kept.where(~filled).select("*", F.lit(None).cast("long").alias("utc_second"), F.lit(None).cast("int").alias("utc_nanos"), F.lit("blank").alias("verdict"))
    return joined.select(*kept.columns, "utc_second", "utc_nanos", "verdict").unionByName(blank)


def is_canonical(raw: Column) -> Column:
    """Whether a value is already written as YYYY-MM-DDThh:mm:ssZ."""
    return raw.rlike(ISO_UTC)
