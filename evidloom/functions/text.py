"""Column functions on text. All are built from JVM expressions; null in gives null out unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as a Unicode-aware split sees it, the four information separators included.
SPACE = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"[A-Za-z0-9ÄÖÜäöüß_+-]+"


def collapse(s: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, SPACE, " "))


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose expression is evaluated once per row, however often it is used afterwards.

    A plain projection would be inlined into every later filter, and into every branch that uses it; an attribute made
    by a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_end(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+$", "")


def casefold(s: Column) -> Column:
    """Lower case with ß written out; other characters that only case folding changes stay."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def for_match(s: Column, joint: str = " ") -> Column:
    """Case-folded, hyphens and underscores as blanks, white space collapsed and joined by `joint`."""
    folded = collapse(F.translate(casefold(s), "-_", "  "))
    return folded if joint == " " else F.replace(folded, F.lit(" "), F.lit(joint))


def tokens(s: Column, pattern: str = TOKEN) -> Column:
    """Case-folded tokens in order; an empty array for a null or a text without any."""
    found = F.transform(F.regexp_extract_all(s, F.lit(f"({pattern})"), 1), casefold)
    return F.coalesce(found, F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)


def normalize_text(df: DataFrame, column: str) -> DataFrame:
    """The column composed (NFC), line ends as LF, NULs removed, three and more blanks as one, trimmed.

    Only rows with a character outside ASCII pass through Python.
    """
    wide = F.col(column).rlike(r"[^\x00-\x7F]")
    composed = F.when(wide, _compose(F.when(wide, F.col(column)))).otherwise(F.col(column))
    lines = F.regexp_replace(composed, r"\r\n?", "\n")
    clean = F.regexp_replace(F.replace(lines, F.lit("\x00"), F.lit("")), " {3,}", " ")
    return df.withColumn(column, strip(clean))


def slug_id(s: Column, fallback: str = "UNMAPPED") -> Column:
    """Upper case, runs of other signs than letters, digits and _.,() as one hyphen, none at the ends."""
    made = F.regexp_replace(F.upper(s), r"[^A-Z0-9_.,()-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(made, r"^-+|-+$", ""), F.lit("")), F.lit(fallback))


def truncate(s: Column, most: int) -> Column:
    """Cut to `most` characters, the last three of them dots where something was cut."""
    return F.when(F.char_length(s) > most, F.concat(strip_end(F.left(s, F.lit(most - 3))), F.lit("..."))).otherwise(s)


def head_and_tail(s: Column, most: int = 280, joint: str = " ... ") -> Column:
    """Cut to `most` characters by leaving out the middle."""
    head = most // 2
    tail = most - head - len(joint)
    cut = F.concat(strip_end(F.left(s, F.lit(head))), F.lit(joint), F.regexp_replace(F.right(s, F.lit(tail)), r"(?U)^[\s\x1c-\x1f]+", ""))
    return F.when(F.char_length(s) > most, cut).otherwise(s)


def around(text: Column, pos: Column, radius: int) -> Column:
    """Up to `radius` characters before and after pos (0-based), blank runs as one, line ends and tabs as blanks."""
    start = F.greatest(pos - radius, F.lit(0))
    return single_line(F.substring(text, start + 1, pos + radius - start))


def single_line(piece: Column) -> Column:
    """Blank runs as one, line ends and tabs as blanks, none at the ends."""
    return strip(F.translate(F.regexp_replace(piece, " {2,}", " "), "\n\t", "  "))


def stable_id(prefix: str, parts: list[Column], length: int) -> Column:
    """Prefix and the first `length` hex digits of the SHA-256 of the parts, one to a line; nulls count as empty."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), F.lit(length)))


def string_list(s: Column) -> Column:
    """A JSON array of strings, or a plain string, as trimmed entries that are not empty."""
    parsed = F.coalesce(F.from_json(F.when(s.rlike(r"^\s*\["), s), "array<string>"), F.array(s))
    return F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != "")


def guard_formula(s: Column) -> Column:
    """A leading apostrophe where a spreadsheet would take the cell for a formula."""
    return F.when(s.rlike(r"(?U)^\s*[=+@-]"), F.concat(F.lit("'"), s)).otherwise(s)


def iso_time(s: Column) -> Column:
    """(value, error) of an ISO date or a date-time with T; blank is an empty value, anything else an error."""
    v = collapse(F.coalesce(s, F.lit("")))
    date = (F.char_length(v) == 10) & F.try_to_date(v, "yyyy-MM-dd").isNotNull()
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
    moment = v.rlike(shape) & F.expr("try_cast(1 as int)").isNotNull() & F.try_to_timestamp(v).isNotNull()
    kept = F.regexp_replace(v, "Z$", "+00:00")
    return F.struct(F.when((v == "") | date, v).when(moment, kept).alias("value"), (~((v == "") | date | moment)).alias("error"))


def is_stale(until: Column, as_of: str) -> Column:
    """Whether a validity date lies before as_of; blank is not stale, an unreadable date is."""
    return F.when(F.coalesce(F.trim(until), F.lit("")) == "", False).otherwise(F.coalesce(F.try_to_date(F.left(until, F.lit(10)), "yyyy-MM-dd") < F.lit(as_of).cast("date"), F.lit(True)))


def bucket(x: Column, steps: list[tuple[float, str]], below: str, unknown: str) -> Column:
    """The name of the first step, from high to low, that a value reaches; `unknown` for null and negative values."""
    out = F.when(x.isNull() | (x < 0), unknown)
    for least, name in steps:
        out = out.when(x >= F.lit(float(least)), name)
    return out.otherwise(below)
