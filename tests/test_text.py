import ipaddress
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidloom.functions import patterns as P
from evidloom.functions import terms as TM
from evidloom.functions import text as TX

  # fmt: skip


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def private(x):
    try:
        return ipaddress.ip_address(x).is_private
    except ValueError:
        return False


# written by hand, one for each kind of value and for what must stay
MASKED = [
    ("mail a.b@x.example now", "mail [email:redacted] now"),
    ("A.B+c@MAIL.Example.org!", "[email:redacted]!"),
    ("user@ is no mail, a@b neither", "user@ is no mail, a@b neither"),
    ("call +49 (0)30 1234567 today", "call [phone:redacted] today"),
    ("on 2024-05-06 at noon", "on [phone:redacted] at noon"),
    ("build 123456 passed", "build 123456 passed"),
    ("x12345678 and 12345678x stay", "x12345678 and 12345678x stay"),
    ("12345678901234567890 is too long", "12345678901234567890 is too long"),
    ("IBAN DE89370400440532013000.", "IBAN [iban:redacted]."),
    ("host 10.0.0.7 up", "host [private_network:redacted] up"),
    ("host 8.8.4.4 up", "host 8.8.4.4 up"),
    ("see db1.prod.internal:", "see [private_network:redacted]:"),
    ("see db1.prod.example", "see db1.prod.example"),
    ("password = hunter2 end", "password=[secret:redacted] end"),
    ("Passwd: 'a b", "Passwd=[secret:redacted] b"),
    ("API-Key: abc; rest", "API-Key=[token:redacted] rest"),
    ("token=abc, secret = def", "token=[token:redacted] secret=[secret:redacted]"),
    ("the token is lost", "the token is lost"),
    ("tokens: abc", "tokens: abc"),
    ("use ghp_abcdefghijklmnop here", "use [token:redacted] here"),
    ("use sk-abcdefghijklmnop", "use [token:redacted]"),
    ("sk-short stays", "sk-short stays"),
    ("", ""),
    ("é ü plain", "é ü plain"),
]


def test_masks(spark):
    assert list(zip((t for t, _ in MASKED), column(spark, [t for t, _ in MASKED], P.mask), strict=True)) == MASKED


def test_sensitive_is_false_for_nothing(spark):
    assert column(spark, [None, "", "  ", "plain", "the token", "a@b.example", "10.0.0.1", "8.8.8.8"], P.has_sensitive) == [False, False, False, False, True, True, True, False]


def test_private_addresses(spark):
    rnd = random.Random(2)
    values = [".".join(str(rnd.choice([0, 1, 10, 127, 169, 172, 16, 31, 192, 168, 198, 18, 203, 240, 255, 256, rnd.randrange(256)])) for _ in range(4)) for _ in range(300)] + ["01.2.3.4", "1.2.3", "192.0.2.1", "169.254.1.1", "198.51.100.9"]
    values += ["192.0.0.9", "192.0.0.10", "192.0.0.11"]
    assert list(zip(values, column(spark, values, P.private_ip), strict=True)) == [(v, private(v)) for v in values]


def test_lines_and_snippets(spark):
    df = spark.createDataFrame([(1, "ok\nmail a@b.example\r\nsecret=abc token"), (2, None), (3, "")], "k int, t string")
    got = sorted((r.k, r.line, r.type, r.match) for r in P.scan_lines(df, "k", "t").collect())
    assert got == [(1, 2, "email", "a@b.example"), (1, 3, "keyword", "token"), (1, 3, "secret", "abc")]
    status = {r.k: r.status for r in P.verdicts(P.scan_lines(df, "k", "t"), df, "k").collect()}
    assert status == {1: "block", 2: "pass", 3: "pass"}
    one = column(spark, ["before a@b.example after 10.0.0.1"], lambda t: P.snippet(t, F.lit(7), F.lit(18), F.lit("email")))
    assert one == ["before [email:redacted] after [private_network:redacted]"]


def test_a_verdict_is_over_all_findings(spark):
    mails = " ".join(f"a{i}@b.example" for i in range(30))
    df = spark.createDataFrame([(1, f"{mails} password=hunter2"), (2, "\n".join(["a@b.example"] * 40 + ["10.0.0.1", "secret=abc"])), (3, mails)], "k int, t string")
    got = {r.k: (r.high, r.medium, r.low, r.status) for r in P.verdicts(P.scan_lines(df, "k", "t"), df, "k").collect()}
    assert got == {1: (1, 30, 0, "block"), 2: (1, 40, 1, "block"), 3: (0, 30, 0, "warn")}


def test_overlaps(spark):
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end")))
    assert column(spark, ["x"], lambda t: F.array(*(P.overlaps(F.lit(a), F.lit(b), spans) for a, b in ((0, 5), (8, 10), (9, 12))))) == [[False, True, False]]


def test_occurrences_equal_re(spark):
    words = ("risk", "risk owner", "mfa", "überprüfung")
    values = ["Risk Owner and RISK, risks mfa.mfa", "überprüfung der Überprüfung", "", "xmfa mfa_ mfa", "😀 risk 😀 risk", "no"]
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w))) + r")\b", re.I)
    got = column(spark, values, lambda t: TM.occurrences(t, TM.alternation(words)))
    assert [[(h.pos, h.match) for h in g] for g in got] == [[(m.start(), m[0]) for m in pattern.finditer(v)] for v in values]


def test_normalize(spark):
    values = ["a\u0308 x", "  a\r\nb\rc\x00d    e  ", "", None, "plain   text"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = [r.t for r in TX.normalize_text(df, "t").orderBy("i").collect()]

    def model(t):
        t = unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
        return re.sub(" {3,}", " ", t).strip()

    assert got == [None if v is None else model(v) for v in values]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (TX.collapse, " a\u00a0\t b\x1dc ", "a b c"),
        (TX.for_match, "Multi-Factor_Straße  X", "multi factor strasse x"),
        (lambda c: TX.for_match(c, "_"), "A b-C", "a_b_c"),
        (TX.slug_id, "--Risk Mgmt/2024!", "RISK-MGMT-2024"),
        (TX.slug_id, "???", "UNMAPPED"),
        (lambda c: TX.truncate(c, 8), "abcd  efghij", "abcd..."),
        (lambda c: TX.head_and_tail(c, 20), "abcdefghij klmnopqrstuvw", "abcdefghij ... stuvw"),
        (TX.guard_formula, "  =1", "'  =1"),
        (TX.guard_formula, "ok", "ok"),
        (lambda c: TX.iso_time(c)["value"], "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00"),
        (lambda c: TX.iso_time(c)["error"], "2024-02-30", True),
        (lambda c: TX.iso_time(c)["error"], "", False),
        (lambda c: TX.iso_time(c)["error"], "yesterday", True),
        (lambda c: TX.is_stale(c, "2024-06-01"), "2024-05-31", True),
        (lambda c: TX.is_stale(c, "2024-06-01"), " ", False),
        (lambda c: TX.is_stale(c, "2024-06-01"), "soon", True),
        (TX.string_list, '["a", " b0 ", ""]', ["a", "b0"]),
        (TX.string_list, " one1 ", ["one1"]),
        (lambda c: P.safe_text(c, 100, keep_date=True), "2024-01-02 call +49 30 1234567", "2024-01-02 call [phone:redacted]"),
        (TX.tokens, "Größe_1 über-x!", ["grösse_1", "über-x"]),
    ],
)
def test_functions(spark, function, value, want):
    assert column(spark, [value], function) == [want]


def test_nulls_and_empty_lists(spark):
    assert column(spark, [None], TX.tokens) == [[]]
    assert column(spark, [None], lambda c: TX.bucket(F.lit(None).cast("double"), [(0.5, "high")], "low", "unknown")) == ["unknown"]
    assert column(spark, ["a"], lambda c: TM.hits(c, [])) == [[]]
    with pytest.raises(ValueError):
        TM.alternation([])
