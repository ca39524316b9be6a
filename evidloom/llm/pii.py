"""Personal data in free text: detection, and typed placeholders with format-preserving pseudonyms.

Numbers are permuted within their format, digits among digits of their script, letters among letters and dates among
dates, by a keyed Feistel network, so that equal values stay linked across documents and nobody without the key can turn
them back; numbers whose check digits are right get right ones again. Of a telephone number only what is behind the
country code or the leading zero is permuted, so that its spellings stay linked. E-mail addresses, street addresses and
names, which have no fixed format, get a keyed tag of 128 bits instead. Names are found by a trained model (names.py).
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.names import COMMON, GIVEN, NameModel, pairs, trained

TYPES = ("email", "phone", "id_number", "address", "name")
MASK = "\ue000"  # stands for a character that is taken already

# --- Feistel ---------------------------------------------------------------------------------------------------------


def _round(key: bytes, tweak: str, i: int, value: int) -> int:
    return int.from_bytes(blake2b(f"{tweak}|{i}|{value}".encode(), key=key, digest_size=16).digest(), "big")


def permute_symbols(values: list[int], radix: int, key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of the strings of this length over 0..radix-1, or its inverse."""
    n = len(values)
    if n < 2:
        shift = _round(key, tweak, 0, n) % radix
        return [(v + (-shift if back else shift)) % radix for v in values]
    u = n // 2
    sizes = (radix**u, radix ** (n - u))
    a = b = 0
    for v in values[:u]:
        a = a * radix + v
    for v in values[u:]:
        b = b * radix + v
    for i in range(9, -1, -1) if back else range(10):
        if i % 2 == 0:
            a = (a + (-1 if back else 1) * _round(key, tweak, i, b)) % sizes[0]
        else:
            b = (b + (-1 if back else 1) * _round(key, tweak, i, a)) % sizes[1]
    out = []
    for x, k in ((b, n - u), (a, u)):
        for _ in range(k):
            x, r = divmod(x, radix)
            out.append(r)
    return out[::-1]


def permute_number(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over the next larger power of two, walked until inside."""
    bits = max(2, (size - 1).bit_length())
    while True:
        value = int("".join(map(str, permute_symbols([int(c) for c in f"{value:0{bits}b}"], 2, key, tweak, back))), 2)
        if value < size:
            return value


_EPOCH = dt.date(2000, 1, 1)
_DAYS = (dt.date(2100, 1, 1) - _EPOCH).days  # a century, of which every day has its own two-digit year, month and day


def permute_date(day: dt.date, key: bytes, back: bool = False) -> dt.date:
    """A keyed permutation of the days of a century; a day of another one is moved within its own."""
    moved = dt.date(2000 + day.year % 100, day.month, day.day)
    new = _EPOCH + dt.timedelta(days=permute_number((moved - _EPOCH).days, _DAYS, key, "date", back))
    century = day.year // 100 * 100
    try:
        return new.replace(year=century + new.year % 100)
    except ValueError:  # 29 February of a year that is no leap year in that century
        return permute_date(new.replace(year=century + new.year % 100, day=28), key, back)


def permute_digits(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """The decimal digits of a value, of whatever script, permuted among themselves; all else stays."""
    own = [(i, unicodedata.decimal(c)) for i, c in enumerate(text) if c.isdecimal()]
    out = list(text)
    for (i, old), new in zip(own, permute_symbols([d for _, d in own], 10, key, f"{tweak}10{len(own)}", back) if own else [], strict=True):
        out[i] = chr(ord(text[i]) - old + new)
    return "".join(out)


def permute_text(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Digits and letters of a value permuted among themselves; case, script, blanks and signs stay where they are."""
    out = list(permute_digits(text, key, tweak, back))
    own = [i for i, c in enumerate(text) if c.isascii() and c.isalpha()]
    new = permute_symbols([ord(text[i].upper()) - 65 for i in own], 26, key, f"{tweak}26{len(own)}", back) if own else []
    for i, v in zip(own, new, strict=True):
        out[i] = chr(65 + v).lower() if text[i].islower() else chr(65 + v)
    return "".join(out)


# --- detection -------------------------------------------------------------------------------------------------------

_AT = r"(?:@| ?\(at\) ?| ?\[at\] ?| ?\{at\} ?| @ )"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?)"
_EMAIL = re.compile(rf"(?:mailto:)?(?<![\w.+\-])[\w][\w.+\-]*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[a-z]{{2,}}(?![\w])", re.I)

_NOT_PHONE = re.compile(
    r"(?<!\d)\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?(?!\d)|(?<![\d.])\d{1,2}\.\d{1,2}\.(?:19|20)\d{2}(?!\d|\.\d)|(?<![\d/])\d{1,2}/(?:19|20)\d{2}(?!\d)"
    r"|(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)|(?<!\d)\d{1,2}:\d{2}(?::\d{2})?(?!\d)|(?<![A-Z])[A-Z]{2,12}-?\d+(?:-\d+)*"
)
_DIGIT_RUN = re.compile(r"(?<![\w.,/\-+#])(?:\+|\(\+?)?\d[\d \t()./\-–]{0,38}\d(?!\d)(?: ?(?:x|ext\.?|extn\.?|Durchwahl) ?\d{1,5}(?!\w))?", re.I)
_GROUP = re.compile(r"[(+]*\d+")
_NEXT_RUN = re.compile(rf"[ \t]?[/\-–.,]?[ \t]?(?P<run>{_DIGIT_RUN.pattern.partition(')')[2]})", re.I)
_EXTENSION = re.compile(r" ?(?:x|ext\.?|extn\.?|Durchwahl) ?\d{1,5}$", re.I)
_NORTH_AMERICA = re.compile(r"(?:\+?1[-. ])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])\d{3}[-. ]\d{4}")


def _phone_length(run: str) -> int:
    """How much of a run of digits and separators is a telephone number; 0 if none."""
    if run[0] != "+" and run[:2] != "(+" and run.lstrip("(")[0] != "0" and not _NORTH_AMERICA.match(run):
        return 0
    body, tail = _EXTENSION.sub("", run), _EXTENSION.search(run)
    while True:
        digits = re.sub(r"\D", "", body.replace("(0)", ""))
        balanced = body.count("(") == body.count(")")
        good = False
        if balanced and 7 <= len(digits) <= 15:
            if body.startswith(("+", "(+")):
                good = len(digits) >= 9 and digits[0] != "0"
            elif digits.startswith("00"):
                good = len(digits) >= 11 and digits[2] != "0"
            elif digits.startswith("0"):
                good = 9 <= len(digits) <= 12
            else:
                good = bool(_NORTH_AMERICA.fullmatch(body.strip()))
        if good:
            whole = tail and body == _EXTENSION.sub("", run)
            return len(run) if whole else len(body)
        shorter = re.sub(r"[ \t()./\-–]+\d+\)?$", "", body)
        if shorter == body or not shorter:
            return 0
        body = shorter


def _phones(text: str) -> Iterator[tuple[int, int]]:
    """Telephone numbers from left to right. After one the search goes on where it ends, whatever separates the next;
    after a run of digits that begins with none, at the run's next group of digits."""
    at = 0
    while m := _DIGIT_RUN.search(text, at):
        n = _phone_length(m[0])
        at = m.start() + n if n else _GROUP.match(text, m.start()).end()
        while n:
            yield at - n, at
            m = _NEXT_RUN.match(text, at)
            n = _phone_length(m["run"]) if m else 0
            at = m.start("run") + n if n else at


_LABEL = (
    r"(?:tax[ -]?(?:id|number|no)|TIN|steuer-?(?:id(?:entifikationsnummer)?|nummer|nr)|idnr|sozialversicherungs(?:nummer|-?nr)|rentenversicherungsnummer|sv-?(?:nummer|nr)"
    r"|passport|reisepass|pass-?nr|personalausweis|ausweis|identity card|id card|driv(?:ing|er'?s?) licen[cs]e|führerschein|fuehrerschein"
    r"|SSN|social security|national insurance|NINO|IBAN|bank account|konto(?:nummer|nr)?)"
    r"(?:[ -]?(?:no|nr|number|nummer|num|id)\b\.?)?\s?[:#]?\s?"
)
_VALUES = (
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"\d{2} ?\d{6} ?[A-Z] ?\d{3}(?!\w)",
    r"\d{2} \d{3} \d{3} \d{3}(?!\w)",
    r"\d{3}-\d{2}-\d{4}(?!\w)",
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)",
    r"(?=[A-Z0-9/\-]*\d)[A-Z0-9][A-Z0-9/\-]{5,17}[A-Z0-9](?![A-Za-z0-9])",
)
_ID = re.compile(rf"(?i:(?<!\w){_LABEL})(?P<a>{'|'.join(_VALUES)})|(?i:(?<!\w){_LABEL})(?P<l>(?i:(?=[a-z0-9]*\d[a-z0-9]*\d)[a-z0-9]{{7,18}})(?!\w))")
_BARE_ID = re.compile(
    r"(?<![\w\-])(?:[A-Z]{2}\d{2}(?: ?\d{4}){4,6}(?: ?\d{1,3})?|[A-Z]{2}\d{2} ?[A-Z]{4}(?: ?\d{4}){3} ?\d{2}|\d{3}-\d{2}-\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2} \d{6} [A-Z] \d{3}|[A-Z9]{5}\d{6}[A-Z9]{2}[A-Z0-9]{0,3}|[A-Z]\d{2}[A-Z]{3}\d{3})(?![\w\-])"
)

# Endings of street names, German joined and English separate.
_STREET_DE = r"(?:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|ring|kai|stieg|ufer|damm|markt|steig|pfad|chaussee|promenade|wall|graben|speicher|winkel|anger|brücke)"
_STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Crescent|Row|Walk|Gardens|Mews|Parkway|Pkwy|Quay|Highway|Hwy|Alley)"
_ADDRESS_DE = re.compile(
    rf"(?<![\w\-])(?:(?:Alte[rnms]?|Neue[rnms]?|Am|An der|An den|Im|In der|Zum|Zur|Große|Kleine|Obere|Untere|Hintere|Vordere|Auf der|Auf dem)[ ])?[A-ZÄÖÜ][\wäöüß\-]*{_STREET_DE} \d{{1,4}}(?: ?[a-h](?![\w]))?(?![\w\d])"
    rf"(?:(?:, | in | - |,? ?)\d{{5}} [A-ZÄÖÜ][\wäöüß\-]+)?",
    re.I,
)
_ADDRESS_EN = re.compile(
    rf"(?<![\w.,/:+\-#])\d{{1,5}}[a-z]? (?:(?:[A-Z][\w']+ ){{1,3}}(?i:{_STREET_EN})|(?:[a-z]+ ){{1,2}}(?:street|avenue|lane|boulevard|blvd))\b\.?"
    rf"(?:, (?i:Apt|Apartment|Flat|Unit|Suite) ?\d+\w?)?(?:, [A-Z]\w+(?: [A-Z]{{2}} \d{{4,5}})?)?"
)
_ROMANCE = r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Cc]hemin|[Aa]llée|[Qq]uai|[Pp]lace|[Rr]ua|[Aa]venida|[Tt]ravessa|[Pp]raça|[Cc]alle|[Pp]laza|[Pp]aseo|[Cc]arrer|Via|[Vv]iale|[Pp]iazza|[Cc]orso|Largo)"
_ROMANCE_NAME = r"(?:(?:de la|de l'|de|du|des|d'|da|do|dos|das|del|della|dei|di|la|le|les) ?)?[A-ZÀ-ÖØ-Þ][\w'’\-]+(?:(?: (?:de|du|des|da|do|dos|del|della|di|la|le))? [A-ZÀ-ÖØ-Þ][\w'’\-]+){0,3}"
_ADDRESS_ROMANCE = re.compile(rf"(?<![\w.,/:+\-#])\d{{1,4}}(?: ?(?:bis|ter|[a-d]))?,? {_ROMANCE} {_ROMANCE_NAME}(?:, \d{{4,5}} [A-ZÀ-ÖØ-Þ][\w\-]+)?|(?<!\w){_ROMANCE} {_ROMANCE_NAME},? (?:n[.º°]? ?)?\d{{1,4}}(?![\w\d])(?:, \d{{4,5}}(?:-\d{{3}})? [A-ZÀ-ÖØ-Þ][\w\-]+)?")
_BIRTH = re.compile(r"(?i:\b(?:born(?: on)?|date of birth|DOB|birth ?date|geb(?:oren)?\.?(?: am)?|geburtsdatum)\b\.?:? ?)(?P<d>\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})(?!\d)")
_NO_STREET = re.compile(r"^(?:\d+\w? )?(?:Backup|Main Backup) Street", re.I)

_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Herrn|Frau|Sir|Madam)\.?"
_UP = r"[A-ZÀ-ÖØ-Þ]"
_LOW = r"[a-zß-öø-ÿ]"
_FAMILY = rf"(?:{_UP}{_LOW}{{2,}}(?:-{_UP}{_LOW}{{2,}})?)"
_TITLED = re.compile(rf"(?<!\w){_TITLE}[ ](?:{_UP}\.[ ])?(?P<given>{_FAMILY}[ ])?(?P<family>{_FAMILY})(?!\w)")
_INITIAL = re.compile(rf"(?<![\w.\-])(?:{_UP}\.[ ]?){{1,2}}{_FAMILY}(?!\w)")
@dataclass(frozen=True)
class Item:
    start: int
    end: int
    kind: str


def _names(text: str, model: NameModel) -> Iterator[tuple[int, int]]:
    """Names by a title, initials or a common given name, and those that the model finds."""
    for m in _TITLED.finditer(text):
        yield m.start(), m.end() if not m["given"] or m["given"].strip().lower() in GIVEN else m.start("family") - 1
    for m in _INITIAL.finditer(text):
        if m[0].rpartition(" ")[2].rpartition(".")[2].lower() not in COMMON:
            yield m.span()
    yield from pairs(text)
    yield from model.names(text)


def _ranked_names(text: str, model: NameModel) -> list[tuple[int, int]]:
    """Names without overlaps: of two that overlap, the one that the more certain rule found."""
    kept: list[tuple[int, int]] = []
    for a, z in _names(text, model):
        k = bisect_left(kept, (a, z))
        if a < z and (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or z <= kept[k][0]):
            kept.insert(k, (a, z))
    return kept


def detect(text: str | None, model: NameModel | None = None, birth_dates: bool = False) -> list[Item]:
    """The items in order, none overlapping another. Null and blank texts have none. model: of names, by default the one
    that names.trained() makes."""
    if not text or not text.strip():
        return []
    found: list[Item] = []
    work = text

    def take(spans: Iterator[tuple[int, int]], kind: str | None) -> None:
        """Note the spans that no earlier one has taken, and hide them from later detectors."""
        nonlocal work
        parts, at = [], 0
        for a, z in sorted(spans):
            if a < z and a >= at and MASK not in work[a:z]:
                if kind:
                    found.append(Item(a, z, kind))
                parts += [work[at:a], MASK * (z - a)]
                at = z
        work = "".join([*parts, work[at:]])

    take((m.span() for m in _EMAIL.finditer(text)), "email")
    if birth_dates:
        take((m.span("d") for m in _BIRTH.finditer(work)), "birth_date")
    take((m.span("a") if m["a"] else m.span("l") for m in _ID.finditer(work)), "id_number")
    take((m.span() for m in _BARE_ID.finditer(work)), "id_number")
    take((m.span() for m in _ADDRESS_DE.finditer(work) if not _NO_STREET.match(m[0])), "address")
    take((m.span() for m in _ADDRESS_ROMANCE.finditer(work)), "address")
    take((m.span() for m in _ADDRESS_EN.finditer(work) if not _NO_STREET.match(m[0]) and not _runs_on(work, m.start())), "address")
    kept = work
    take((m.span() for m in _NOT_PHONE.finditer(work)), None)
    take(_phones(work), "phone")
    work = kept
    take(((i.start, i.end) for i in list(found) if i.kind == "phone"), None)
    take(_ranked_names(work, model or trained()), "name")
    return sorted(found, key=lambda i: i.start)


def _runs_on(text: str, at: int) -> bool:
    """Whether the number at `at` goes on a number to its left."""
    return bool(re.search(r"\d[ ]?[-/.()]?[ ]?$", text[max(0, at - 4) : at]))


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00".upper())
    return f"{98 - int(number) % 97:02d}"


def _tax_check(ten: str) -> str:
    """The last digit of a German tax number of eleven, by ISO 7064 modulo 11, 10."""
    product = 10
    for c in ten:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return str((11 - product) % 10)


def _insurance_check(number: str) -> str:
    """The last digit of a German social insurance number of twelve signs, without it."""
    digits = f"{number[:8]}{ord(number[8]) - 64:02d}{number[9:11]}"
    total = 0
    for c, weight in zip(digits, (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1), strict=True):
        product = int(c) * weight
        total += product // 10 + product % 10
    return str(total % 10)


# Country calling codes of one and two digits; all others have three.
_ONE_DIGIT = "1 7".split()
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _significant(number: str) -> int:
    """Where the part of a telephone number begins that is the same in all its spellings: behind the country code, and
    behind the zero or one that is dialled before it within the country."""
    plain = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in number)
    digits = [i for i, c in enumerate(plain) if c.isdigit()]
    shown = "".join(plain[i] for i in digits)
    skip = 2 if shown.startswith("00") else 0
    if skip or plain.lstrip("(").startswith("+"):
        code = shown[skip:]
        skip += 1 if code[:1] in _ONE_DIGIT else 2 if code[:2] in _TWO_DIGITS else 3
        while shown[skip : skip + 1] == "0":
            skip += 1
    elif shown[:1] == "0" or len(shown) == 11 and shown[0] == "1":
        skip = 1
    return digits[min(skip, len(digits) - 1)]


def phone_pseudonym(value: str, key: bytes) -> str:
    tail = _EXTENSION.search(value)
    number = value[: tail.start()] if tail else value
    at = _significant(number)
    return number[:at] + permute_digits(number[at:], key, "phone") + (permute_digits(tail[0], key, "extension") if tail else "")


def _ascii_digits(value: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)


def _put(value: str, signs: str) -> str:
    """The letters and digits of a value replaced one by one, other signs left; letters keep their case."""
    new = iter(signs)
    return "".join((n.lower() if c.islower() else n) if c.isalnum() and (n := next(new)) else c for c in value)


def id_pseudonym(value: str, key: bytes) -> str:
    bare = re.sub(r"[\W_]", "", _ascii_digits(value)).upper()
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", bare):
        rest = permute_text(bare[4:], key, "iban")
        valid = _iban_check(bare[:2], bare[4:]) == bare[2:4]
        return _put(value, bare[:2] + (_iban_check(bare[:2], rest) if valid else bare[2:4]) + rest)
    if re.fullmatch(r"[0-9]{11}", bare):
        valid = _tax_check(bare[:10]) == bare[10]
        new = permute_digits(bare[:10] if valid else bare, key, "tax")
        return _put(value, new + (_tax_check(new) if valid else ""))
    if m := re.fullmatch(r"([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([A-Z])([0-9]{2})([0-9])", bare):
        try:
            day = permute_date(dt.date(2000 + int(m[4]), int(m[3]), int(m[2])), key).strftime("%d%m%y")
        except ValueError:
            return permute_text(value, key, "id")
        new = permute_digits(m[1], key, "area") + day + permute_text(m[5], key, "initial") + permute_digits(m[6], key, "serial")
        return _put(value, new + (_insurance_check(new) if _insurance_check(bare[:11]) == m[7] else permute_digits(m[7], key, "check")))
    return permute_text(value, key, "id")


def date_pseudonym(value: str, key: bytes) -> str:
    """A date in figures as another one in the same form; one that does not exist digit by digit."""
    parts = re.findall(r"\d+", value)
    year = 0 if len(parts[0]) == 4 else 2
    order = (1, 2) if year == 0 else (1, 0)
    y = int(parts[year])
    try:
        day = permute_date(dt.date(y if y > 99 else 2000 + y, int(parts[order[0]]), int(parts[order[1]])), key)
    except ValueError:
        return permute_digits(value, key, "date")
    new = {year: f"{day:%Y}" if y > 99 else f"{day:%y}", order[0]: f"{day:%m}", order[1]: f"{day:%d}"}
    each = iter(range(3))
    return re.sub(r"\d+", lambda m: new[next(each)], value)


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """What stands for a value: of its own format where it has a fixed one, else a keyed tag."""
    if kind == "phone":
        return phone_pseudonym(value, key)
    if kind == "id_number":
        return id_pseudonym(value, key)
    if kind == "birth_date":
        return date_pseudonym(value, key)
    folded = re.sub(r"[\W_]+", "", re.sub(r"(?i)mailto:|\((?:at|dot)\)|\[(?:at|dot)\]", "", value)).casefold()
    return blake2b(f"{kind}|{folded}".encode(), key=key, digest_size=16).hexdigest()


def redact(text: str | None, key: bytes, model: NameModel | None = None, birth_dates: bool = False) -> tuple[str | None, list[Item]]:
    """The text with a typed placeholder, [type:pseudonym], for each item, and the items; the rest is unchanged."""
    items = detect(text, model, birth_dates)
    if not items:
        return text, items
    out, at = [], 0
    for i in items:
        out += [text[at : i.start], f"[{i.kind}:{pseudonym(text[i.start : i.end], i.kind, key)}]"]
        at = i.end
    return "".join([*out, text[at:]]), items


def redact_fields(rows: DataFrame, fields: list[str], keep: list[str], key: bytes, birth_dates: bool = False) -> DataFrame:
    """(keep..., field_name, redacted, pii_types, n_items): one row for each field of each row that is not null.

    key: secret of the pseudonyms, up to 64 bytes. birth_dates: also replace dates of birth. pii_types are the distinct types found, in the order of TYPES; blank
    texts have none. Fields are read whole, whatever their length; columns not named are ignored.
    """
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("_text")) for f in fields)))
    flat = rows.select(*keep, named.alias("_f")).select(*keep, "_f.field_name", "_f._text").where("_text is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields[:-1])
    names = [*keep, "field_name", "redacted", "pii_types", "n_items"]
    model = trained()  # some thousand weights, sent with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [redact(t, key, model, birth_dates) for t in b.column(b.num_columns - 1).to_pylist()]
            kinds = [[k for k in (*TYPES, "birth_date") if any(i.kind == k for i in items)] for _, items in done]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([t for t, _ in done], pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array([len(i) for _, i in done], pa.int32())], names=names
            )

    return flat.mapInArrow(run, f"{schema}, redacted string, pii_types array<string>, n_items int")
