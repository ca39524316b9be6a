"""Detectors of sensitive values and the masks for them."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidloom.functions.text import SPACE, collapse

# The patterns of the eight detectors. (?U) lets classes and borders see all of Unicode.
EMAIL = r"(?iU)\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b"
PHONE = r"(?U)((?<![\w])(?:\+?\d[\d\s()./-]{6,}\d)(?![\w]))"
IBAN = r"(?iU)(\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){11,30}\b)"
IPV4 = r"(?U)(\b(?:\d{1,3}\.){3}\d{1,3}\b)"
HOST = r"(?iU)(\b[a-z0-9][a-z0-9-]{0,62}(?:\.[a-z0-9][a-z0-9-]{0,62})*\.(?:corp|internal|intranet|lan|local)\b)"
TOKEN_KEYS = ("api[_-]?key", "authorization", "cookie", "refresh[_-]?token", "token", "access[_-]?token")
SECRET_KEYS = ("password", "passwd", "secret")
_ASSIGNED = r"""(['"]?[^\s'"`]+['"]?)"""
SECRET = rf"(?iU)(\b({'|'.join((*TOKEN_KEYS, *SECRET_KEYS))})\b\s*[:=]\s*{_ASSIGNED})"
TOKEN_VALUE = r"(?iU)(\b(?:ghp|github_pat|glpat|sk|xox[baprs])[-_][A-Za-z0-9_=-]{12,}\b)"
KEYWORD = r"(?iU)(\b(?:api[_-]?key|authorization|cookie|password|secret|token)\b)"

MAX_LINE = 4000  # characters of a line that the JVM's patterns see; longer lines are read in stretches of that size
SEVERITIES = {"secret": "high", "token": "high", "email": "medium", "phone": "medium", "iban": "medium", "private_network": "low", "keyword": "medium"}


def plausible_phone(match: Column) -> Column:
    """Seven to fifteen digits."""
    return F.length(F.regexp_replace(match, r"(?U)\D", "")).between(7, 15)


#: Private and reserved IPv4 blocks, as first address and prefix length.
_PRIVATE_BLOCKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
)
#: Public addresses in these blocks.
_PUBLIC_INSIDE = ("192.0.0.9", "192.0.0.10")


def private_ip(match: Column) -> Column:
    """Whether a dotted quad is a valid address in a private or reserved block; leading zeros are not valid."""
    parts = F.split(match, r"\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * F.lit(256 ** (3 - k)) for k in range(4)), F.lit(0))
    valid = match.rlike(r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(?:\.(?!$)|$)){4}$")
    inside = F.lit(False)
    for first, bits in _PRIVATE_BLOCKS:
        low = sum(int(o) << (24 - 8 * k) for k, o in enumerate(first.split(".")))
        inside = inside | number.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(valid & inside & ~match.isin(*_PUBLIC_INSIDE), F.lit(False))


def secret_kind(key: Column) -> Column:
    low = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return F.when(low.contains("token") | low.contains("api") | low.isin("authorization", "cookie"), "token").otherwise("secret")


def _all(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), 1)


def _short_findings(short: Column) -> Column:
    keys = F.regexp_extract_all(short, F.lit(SECRET), 2)
    values = F.regexp_extract_all(short, F.lit(SECRET), 3)

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("type"), F.lit(SEVERITIES[kind]).alias("severity"), m.alias("match")))

    secrets = F.zip_with(keys, values, lambda k, v: F.struct(secret_kind(k).alias("type"), F.lit("high").alias("severity"), v.alias("match")))
    return F.concat(
        secrets,
        of("token", _all(short, TOKEN_VALUE)),
        of("email", _all(short, EMAIL)),
        of("phone", F.filter(_all(short, PHONE), plausible_phone)),
        of("iban", _all(short, IBAN)),
        of("private_network", F.filter(_all(short, IPV4), private_ip)),
        of("private_network", _all(short, HOST)),
        of("keyword", _all(F.regexp_replace(short, SECRET, "\u0001"), KEYWORD)),
    )


def has_sensitive(text: Column) -> Column:
    """Whether any detector finds something in the whole text; false for null and blank text."""
    simple = F.lit(False)
    for pattern in (TOKEN_VALUE, EMAIL, IBAN, HOST, KEYWORD, SECRET):
        simple = simple | text.rlike(pattern)
    return F.coalesce(simple | F.exists(_all(text, PHONE), plausible_phone) | F.exists(_all(text, IPV4), private_ip), F.lit(False))


def _conditional(text: Column, pattern: str, test, mark: str) -> Column:
    """Replace those matches that pass a test: the text is rebuilt from the matches and the gaps between them."""
    found = _all(text, pattern)
    gaps = F.split(text, pattern, -1)
    kept = F.transform(found, lambda m: F.when(test(m), F.lit(mark)).otherwise(m))
    return F.when(F.size(found) <= 0, text).otherwise(F.array_join(F.zip_with(gaps, kept, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), ""))


def mask(text: Column) -> Column:
    """Every sensitive value as [type:redacted]. The order matters: secrets, phones, private addresses, tokens, mail,
    accounts, hosts; a lone keyword is no value and stays."""
    out = text
    for keys, mark in ((TOKEN_KEYS, "token"), (SECRET_KEYS, "secret")):
        out = F.regexp_replace(out, rf"(?iU)\b({'|'.join(keys)})\b\s*[:=]\s*{_ASSIGNED}", f"$1=[{mark}:redacted]")
    out = _conditional(out, PHONE, plausible_phone, "[phone:redacted]")
    out = _conditional(out, IPV4, private_ip, "[private_network:redacted]")
    for pattern, mark in ((TOKEN_VALUE, "token"), (EMAIL, "email"), (IBAN, "iban"), (HOST, "private_network")):
        out = F.regexp_replace(out, pattern, f"[{mark}:redacted]")
    return out


def safe_text(text: Column, most: int, keep_date: bool = False) -> Column:
    """Collapsed, masked where sensitive and cut to `most` characters in that order, so that no value is torn and missed; keep_date spares a leading ISO date, which looks
    like a telephone number."""
    whole = collapse(text)
    if not keep_date:
        return F.left(mask(whole), F.lit(most))
    date = whole.rlike(r"^\d{4}-\d{2}-\d{2}")
    rest = F.substring(whole, F.lit(11), F.char_length(whole))
    return F.left(F.when(date, F.concat(F.left(whole, F.lit(10)), mask(rest))).otherwise(mask(whole)), F.lit(most))


def snippet(line: Column, start: Column, end: Column, kind: Column, radius: int = 36, most: int = 160) -> Column:
    """The masked surroundings of a finding, itself replaced by its type; both sides are masked on their own, so that the
    replacement is not taken for a value."""
    before = F.substring(line, F.greatest(start - radius, F.lit(0)) + 1, F.least(start, F.lit(radius)))
    single = [F.regexp_replace(x, SPACE, " ") for x in (before, F.substring(line, end + 1, F.lit(radius)))]
    masked = F.trim(F.concat(mask(single[0]), F.lit("["), kind, F.lit(":redacted]"), mask(single[1])))
    return F.when(F.char_length(masked) > most, F.concat(F.left(masked, F.lit(most - 3)), F.lit("..."))).otherwise(masked)


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether [start, end) meets any of an array of (start, end)."""
    return F.exists(spans, lambda s: (start < s["end"]) & (s["start"] < end))


def _python(pattern: str) -> re.Pattern[str]:
    flags = re.match(r"\(\?(i?)U\)", pattern)
    return re.compile(pattern[flags.end() :], re.I if flags[1] else 0)


_LONG = [(kind, _python(p)) for kind, p in (("token", TOKEN_VALUE), ("email", EMAIL), ("phone", PHONE), ("iban", IBAN), ("private_network", IPV4), ("private_network", HOST))]
_LONG_SECRET, _LONG_KEYWORD = _python(SECRET), _python(KEYWORD)
_REACH = 600  # characters before and after a stretch that its matches may see


def never_kept(value: str) -> bool:
    """Whether a value holds an account number, a token or the assignment of a secret."""
    return any(p.search(value) for p in (_python(IBAN), _python(TOKEN_VALUE), _LONG_SECRET))


def _is_private(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).is_private
    except ValueError:
        return False


def long_line(line: str, step: int = MAX_LINE) -> list[tuple[str, str, str]]:
    """(type, severity, match) of a line of any length, as line_findings() has it for a short one. It is read in
    stretches that see what surrounds them, so that time grows with the length; a match belongs to the stretch in which
    it begins and is listed up to _REACH characters beyond that."""
    found: list[tuple[int, int, str, str]] = []
    for at in range(0, len(line), step):
        left = max(0, at - _REACH)
        piece = line[left : at + step + _REACH]
        secrets = list(_LONG_SECRET.finditer(piece))
        hits = [(0, m.start(), "token" if "token" in (k := m[2].lower()) or "api" in k or k in ("authorization", "cookie") else "secret", m[3]) for m in secrets]
        for rank, (kind, pattern) in enumerate(_LONG, 1):
            for m in pattern.finditer(piece):
                if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15 or pattern is _LONG[4][1] and not _is_private(m[0]):
                    continue
                hits.append((rank, m.start(), kind, m[0]))
        hits += [(9, m.start(), "keyword", m[0]) for m in _LONG_KEYWORD.finditer(piece) if not any(s.start() < m.end() and m.start() < s.end() for s in secrets)]
        found += [(rank, left + start, kind, match) for rank, start, kind, match in hits if at <= left + start < at + step]
    return [(kind, SEVERITIES[kind], match) for _, _, kind, match in sorted(found)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "severity", "match")])))
def _long_findings(lines: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else [dict(zip(("type", "severity", "match"), f, strict=True)) for f in long_line(s)] for s in lines], dtype=object)


def line_findings(line: Column) -> Column:
    """array<struct<type, severity, match>> of one whole line, in the order of the detectors. A keyword counts only outside
    of the assignments of secrets: the lines' keywords are sought in what is left without those.

    Lines of up to MAX_LINE characters stay in the JVM; only longer ones pass through Python, see long_line()."""
    long = F.char_length(line) > MAX_LINE
    return F.when(long, _long_findings(F.when(long, line))).otherwise(_short_findings(F.when(~long, line)))


def scan_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, type, severity, match) of every finding of every line, whole lines; null and empty texts have none."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("_i", "_line"))
    return lines.select(key, (F.col("_i") + 1).alias("line"), F.explode(line_findings(F.col("_line"))).alias("_f")).select(key, "line", "_f.type", "_f.severity", "_f.match")


def listed(findings: DataFrame, key: str, most: int = 25) -> DataFrame:
    """The first `most` findings of each document by line, severity and type, for display only; verdicts() counts all."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    order = Window.partitionBy(key).orderBy(rank, "line", "type", "match")
    return findings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def verdicts(findings: DataFrame, documents: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, high, medium, low, status) of every document, over all of its findings.

    status is `block` with a high finding (with `strict`, also with a medium one), `warn` with another, else `pass`.
    """
    counts = findings.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")))
    all_ = documents.select(key).distinct().join(counts, key, "left").select(key, *(F.coalesce(s, F.lit(0)).alias(s) for s in ("high", "medium", "low")))
    stop = (F.col("high") > 0) | (F.lit(strict) & (F.col("medium") > 0))
    return all_.withColumn("status", F.when(stop, "block").when(F.col("medium") + F.col("low") > 0, "warn").otherwise("pass"))
