"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

from evidloom.functions import patterns as P

SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKEN = "[A-Za-z0-9ÄÖÜäöüß_+-]+"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def for_match(x: str) -> str:
    return collapse(f"translate({casefold(x)}, '-_', '  ')")


def hits(x: str, terms) -> str:
    return "(" + " + ".join(f"contains({x}, {quote(t)})::int" for t in terms) + ")"


def any_hit(x: str, terms) -> str:
    return "(" + " or ".join(f"contains({x}, {quote(t)})" for t in terms) + ")"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{TOKEN}'), lambda t: {casefold('t')})"


def values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) as v({names}))"


def around(text: str, pos: str, radius: int) -> str:
    start = f"greatest({pos} - {radius}, 0)"
    return strip(f"translate(regexp_replace(substr({text}, {start} + 1, {pos} + {radius} - {start}), ' {{2,}}', ' ', 'g'), chr(10) || chr(9), '  ')")


def keyword_hits(categories: dict[str, tuple[str, ...]], table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Whole-word matches by splitting at each keyword; for lexicons of which no keyword holds another."""
    words = values([(w, c) for c, ws in categories.items() for w in ws], "word, category")
    return f"""
      select {key}, {text} as text, word, category, pos, substr({text}, pos + 1, length(word)) as keyword from (
        select d.*, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(word)))::int as pos
        from (select {key}, {text}, word, category, string_split(lower({text}), word) as parts from {table}, {words} k where contains(lower({text}), word)) d
      ) where not regexp_matches(substr(text, pos, 1), '^[\\pL\\pN_]$') and not regexp_matches(substr(text, pos + length(word) + 1, 1), '^[\\pL\\pN_]$')
    """


# The detectors and masks of functions.patterns in DuckDB's dialect, which has no look-around: what stands before and after
# a telephone number is part of the match there, and a private sign behind each mark keeps neighbours apart.
_APART = "regexp_replace(%s, '([^\\pL\\pN_\\s()./+-])', '\\1\ue000', 'g')"
_PHONE = "(^|[^\\pL\\pN_])(\\+?\\pN[\\pN\\s()./-]{6,}\\pN)($|[^\\pL\\pN_])"


def _java(pattern: str) -> str:
    """A pattern of functions.patterns, quoted."""
    flags, _, body = pattern.partition(")")
    return quote(("(?i)" if "i" in flags else "") + body)


def private(ip: str) -> str:
    octets = f"string_split({ip}, '.')"
    number = " + ".join(f"{octets}[{k + 1}]::bigint * {256 ** (3 - k)}" for k in range(4))
    blocks = " or ".join(f"{number} between {(lo := sum(int(o) << (24 - 8 * k) for k, o in enumerate(a.split('.'))))} and {lo + (1 << (32 - n)) - 1}" for a, n in P._PRIVATE_BLOCKS)
    return f"case when len(list_filter({octets}, lambda v: regexp_matches(v, '^(0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])$'))) = 4 then ({blocks}) and {ip} not in ('192.0.0.9', '192.0.0.10') else false end"


def plausible(m: str) -> str:
    return f"length(regexp_replace({m}, '[^\\pN]', '', 'g')) between 7 and 15"


def findings(table: str, key: str, text: str) -> str:
    """CTEs `ln` and `fi` (key, type, severity, match) of every finding of every line."""
    each = lambda kind, found: f"select {key}, {quote(kind)} as type, {quote(P.SEVERITIES[kind])} as severity, unnest({found}) as match from ln"
    token = "regexp_matches(lower(k), 'token|api|^authorization$|^cookie$')"
    secrets = f"select {key}, case when {token} then 'token' else 'secret' end as type, 'high' as severity, v as match from (select {key}, unnest(regexp_extract_all(l, {_java(P.SECRET)}, 2)) as k, unnest(regexp_extract_all(l, {_java(P.SECRET)}, 3)) as v from ln)"
    parts = [
        secrets, each("token", f"regexp_extract_all(l, {_java(P.TOKEN_VALUE)}, 1)"), each("email", f"regexp_extract_all(l, {_java(P.EMAIL)}, 1)"), each("iban", f"regexp_extract_all(l, {_java(P.IBAN)}, 1)"),
        each("phone", f"list_filter(regexp_extract_all({_APART % 'l'}, {quote(_PHONE)}, 2), lambda m: {plausible('m')})"), each("private_network", f"list_filter(regexp_extract_all(l, {_java(P.IPV4)}, 1), lambda m: {private('m')})"),
        each("private_network", f"regexp_extract_all(l, {_java(P.HOST)}, 1)"), each("keyword", f"regexp_extract_all(regexp_replace(l, {_java(P.SECRET)}, chr(1), 'g'), {_java(P.KEYWORD)}, 0)"),
    ]
    return f"ln as (select {key}, unnest(string_split_regex({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) as l from {table} where {text} is not null), fi as ({' union all '.join(parts)})"


def masked(source: str, key: str, text: str) -> str:
    """CTEs that end in `mk` (key, note): the texts of a table or CTE masked as patterns.mask() does."""
    x = text
    for keys, mark in ((P.TOKEN_KEYS, "token"), (P.SECRET_KEYS, "secret")):
        x = f"regexp_replace({x}, {quote('(?i)' + chr(92) + 'b(' + '|'.join(keys) + ')' + chr(92) + 'b' + chr(92) + 's*[:=]' + chr(92) + 's*' + P._ASSIGNED)}, '\\1=[{mark}:redacted]', 'g')"
    phone = quote(_PHONE)
    rebuilt = "array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(a[i], '') || coalesce(case when {test} then '[{mark}:redacted]' else m[i] end, '') || coalesce(z[i], '')), '')"
    out = f"replace({rebuilt.format(test=plausible('m[i]'), mark='phone')}, '\ue000', '')"
    last = "t"
    for pattern, mark in ((P.TOKEN_VALUE, "token"), (P.EMAIL, "email"), (P.IBAN, "iban"), (P.HOST, "private_network")):
        last = f"regexp_replace({last}, {_java(pattern)}, '[{mark}:redacted]', 'g')"
    ip = _java(P.IPV4)
    return (
        f"m1 as (select {key}, {_APART % x} as t from {source}), m2 as (select {key}, string_split_regex(t, {phone}) as g, regexp_extract_all(t, {phone}, 1) as a, regexp_extract_all(t, {phone}, 2) as m, regexp_extract_all(t, {phone}, 3) as z from m1),"
        f" m3 as (select {key}, {out} as t from m2), m4 as (select {key}, string_split_regex(t, {ip}) as g, regexp_extract_all(t, {ip}, 1) as m, []::varchar[] as a, []::varchar[] as z from m3),"
        f" m5 as (select {key}, {rebuilt.format(test=private('m[i]'), mark='private_network')} as t from m4), mk as (select {key}, {last} as note from m5)"
    )
