import datetime as dt
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidloom.llm import names as N
from evidloom.llm import pii as P

KEY = b"test key"


def kinds(text):
    return [(i.kind, text[i.start : i.end]) for i in P.detect(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Contact a.b+c@mail.firm.example / 020 7946 0757", [("email", "a.b+c@mail.firm.example"), ("phone", "020 7946 0757")]),
        ("cc jo-doe (at) firm.example now", [("email", "jo-doe (at) firm.example")]),
        ("to x [at] firm [dot] co [dot] example", [("email", "x [at] firm [dot] co [dot] example")]),
        ("callback: +49(0)30-23125-499", [("phone", "+49(0)30-23125-499")]),
        ("Call (391) 555-0101 before", [("phone", "(391) 555-0101")]),
        ("Tel. 664 555 0114 x40", [("phone", "664 555 0114 x40")]),
        ("reached on 01.99.00.25.92", [("phone", "01.99.00.25.92")]),
        ("Tel. 0171/3920046 26317 accounts", [("phone", "0171/3920046")]),
        ("IBAN DE00 8296 4452 1768 6022 22, please", [("id_number", "DE00 8296 4452 1768 6022 22")]),
        ("Copy shows Steuer-ID 02 362 408 529.", [("id_number", "02 362 408 529")]),
        ("shows Sozialversicherungsnummer 52 271253 P 518", [("id_number", "52 271253 P 518")]),
        ("passport N68PMT749 was", [("id_number", "N68PMT749")]),
        ("Personalausweis-Nr. H0RT4Y67", [("id_number", "H0RT4Y67")]),
        ("SSN 985-80-2913", [("id_number", "985-80-2913")]),
        ("national insurance no. QQ 26 92 43 B.", [("id_number", "QQ 26 92 43 B")]),
        ("Wohnhaft Alte Färberstraße 138c in 65852 Eastford", [("address", "Alte Färberstraße 138c in 65852 Eastford")]),
        ("went to 86 Orchard Court, Apt 27, Tannbruck XZ 58674", [("address", "86 Orchard Court, Apt 27, Tannbruck XZ 58674")]),
        ("Spoke with TARSTRÖM Stefan about", [("name", "TARSTRÖM Stefan")]),
        ("bitte Isenström, Yara fragen", [("name", "Isenström, Yara")]),
        ("Scan of jonas dornenbruk shows", [("name", "jonas dornenbruk")]),
        ("per call w/ Dr. Kaldewski Red Team", [("name", "Dr. Kaldewski")]),
        ("according to Unknownia Familius, nothing changed", [("name", "Unknownia Familius")]),
        ("H. Brennari will send the form", [("name", "H. Brennari")]),
    ],
)
def test_found(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "text",
    [
        None, "", " \n ", "user@ is missing the domain", "mail gateway @ Aldermere was tested", "Ticket 20250311-00145; nothing else.", "order 450010354 refers to Gormested",
        "Change CHG0038944 closed 2022-11-25 14:20.", "ISBN-like tag 0-00-81567-0", "Gateway 10.215.212.156 was out of scope.", "Build 5.0.382.91459 not covered", "score 67.4 Backup Street is a code word",
        "Room 118, building 4: badge reader fixed", "Red Team and Blue Team disagree", "Project Amber Field ended 08.06.2023. 9447 accounts", "ratio 16471/31341 after patch", "cell +18649 in the sheet",
        "Steering Committee said no", "der Bereich Yeligtor 5425 Inventarlisten",
    ],
)
def test_not_found(text):
    assert kinds(text or "") == [] and P.redact(text, KEY) == (text, [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("030 23125 409 / 040 66969 542", ["030 23125 409", "040 66969 542"]),
        ("030/23125-760 0171/3920075", ["030/23125-760", "0171/3920075"]),
        ("030 23125 409/040 66969 542, +49 30 23125 410", ["030 23125 409", "040 66969 542", "+49 30 23125 410"]),
        ("room 26 030 23125 760", ["030 23125 760"]),
        ("17 020 7946 0135", ["020 7946 0135"]),
        ("1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 (391) 555-0101 x4 (391) 555-0102", ["(391) 555-0101 x4", "(391) 555-0102"]),
        ("12 34\t0171 3920075\t+44 20 7946 0135", ["0171 3920075", "+44 20 7946 0135"]),
        ("9 +49 (0)30 23125-409 and 030 23125 40912345678901", ["+49 (0)30 23125-409"]),
    ],
)
def test_every_number_of_a_run_is_found(text, want):
    assert kinds(text) == [("phone", w) for w in want]
    assert not any(w in P.redact(text, KEY)[0] for w in want)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Contact Wei Zhang", "Wei Zhang"), ("Rajesh Kumar will present", "Rajesh Kumar"), ("ask Siobhan O'Connor", "Siobhan O'Connor"), ("met Nguyen Van Minh", "Nguyen Van Minh"),
        ("reviewed by Giulia Rossi", "Giulia Rossi"), ("approved by Heinrich Müller-Lüdenscheidt", "Heinrich Müller-Lüdenscheidt"),
    ],
)
def test_names_that_no_list_has(text, want):
    assert kinds(text) == [("name", want)]


def test_names_and_wordings_held_out():
    got = N.measure(N.trained())
    assert got["recall"] >= 0.9 and got["precision"] >= 0.95, got
    assert not {g.lower() for g in N.HELD_GIVEN} & ({g.lower() for g in N.MORE_GIVEN}) and not set(N.HELD_FAMILY) & set(N.MORE_FAMILY) and not set(N.HELD_WORDINGS) & set(N.WORDINGS) and not set(N.HELD_PHRASES) & set(N.PHRASES)


@pytest.mark.parametrize("text", ["Rua Augusta 123", "10 rue de Rivoli", "Avenida da Liberdade 110, 1250 Lisboa", "12 bis, rue du Faubourg Saint-Honoré", "Calle de Alcalá, 42", "Via Roma 12", "Piazza della Signoria 3"])
def test_addresses_of_other_languages(text):
    assert kinds(f"lives at {text} since then")[0] == ("address", text)


def test_digits_of_any_script_are_permuted():
    for text in ("+٤٩ ٣٠ ١٢٣٤٥٦٧", "SSN ٩٨٥-٨٠-٢٩١٣"):
        out, items = P.redact(text, KEY)
        assert len(items) == 1
        value = text[items[0].start :]
        new = P.pseudonym(value, items[0].kind, KEY)
        assert new != value and len(new) == len(value) and out.endswith(f"{new}]") and value[-7:] not in out
    assert P.permute_digits(P.permute_digits("١٢٣٤ 56", KEY, "t"), KEY, "t", back=True) == "١٢٣٤ 56"


def test_spellings_of_one_telephone_number_stay_linked():
    same = ["+49 30 1234567", "0049 30 1234567", "030 1234567", "+49 (0)30 1234567", "(030) 123-4567", "030/1234567 ext 12", "+٤٩ ٣٠ ١٢٣٤٥٦٧"]
    ends = {"".join(str(int(c)) for c in P.pseudonym(v.partition(" ext")[0], "phone", KEY) if c.isdecimal())[-9:] for v in same}
    assert len(ends) == 1
    assert P.pseudonym("+1 391 555 0101", "phone", KEY)[-12:].replace(" ", "") == P.pseudonym("(391) 555-0101", "phone", KEY).translate({ord(c): None for c in "()- "})
    assert P.pseudonym("030/1234567 ext 12", "phone", KEY).count(" ext ") == 1 and P.pseudonym("+49 30 1234567", "phone", KEY).startswith("+49 ")
    assert P.pseudonym("030 1234567", "phone", KEY) != P.pseudonym("030 1234568", "phone", KEY)


def test_dates_are_permuted_within_a_century():
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(36525)]
    assert len({P.permute_date(d, KEY).strftime("%d%m%y") for d in days}) == len(days)
    numbers = {P.pseudonym(f"52{d:%d%m%y}P518", "id_number", KEY) for d in days}
    assert len(numbers) == len(days)
    for d in (dt.date(1971, 2, 28), dt.date(1899, 12, 31), dt.date(2004, 2, 29)):
        assert P.permute_date(d, KEY).year // 100 == d.year // 100


def test_right_check_digits_stay_right():
    for value, check in (("86095742719", lambda v: P._tax_check(v[:10]) == v[10]), ("65170839J003", lambda v: P._insurance_check(v[:11]) == v[11])):
        assert check(value) and check(P.pseudonym(value, "id_number", KEY)) and P.pseudonym(value, "id_number", KEY) != value
    assert P.pseudonym("86095742718", "id_number", KEY) != P.pseudonym("86095742719", "id_number", KEY)


def test_dates_of_birth_on_request():
    text = "Anna Kaldsen, born 28.02.1971, seen 01.03.2024"
    assert [i.kind for i in P.detect(text, birth_dates=True)] == ["name", "birth_date"] and [i.kind for i in P.detect(text)] == ["name"]
    out = P.redact(text, KEY, birth_dates=True)[0]
    new = out.partition("birth_date:")[2].partition("]")[0]
    assert dt.datetime.strptime(new, "%d.%m.%Y").year // 100 == 19 and "01.03.2024" in out


def test_a_name_in_an_address_of_mail_is_none():
    assert [k for k, _ in kinds("from anna.kaldsen@x.example")] == ["email"]


def test_rest_is_unchanged_and_equal_values_are_linked():
    text = "Tel. 030/23125-409 or MAIL a.b@x.example; again 030/23125-409.\n\tEnd"
    out, items = P.redact(text, KEY)
    parts = [x for x in out.replace("]", "[").split("[") if x.split(":")[0] in P.TYPES]
    assert parts[0] == parts[2] and parts[0] != "phone:030/23125-409" and len(parts[0]) == len("phone:030/23125-409")
    rebuilt = out
    for i in items:
        rebuilt = rebuilt.replace(f"[{i.kind}:{P.pseudonym(text[i.start : i.end], i.kind, KEY)}]", text[i.start : i.end])
    assert rebuilt == text
    assert P.pseudonym("A.B@x.example", "email", KEY) == P.pseudonym("a.b (at) x.example", "email", KEY)
    assert P.pseudonym("030/23125-409", "phone", b"another") != P.pseudonym("030/23125-409", "phone", KEY)


def test_tags_of_many_values_differ():
    for kind in ("email", "address", "name"):
        tags = {P.pseudonym(f"value {i}", kind, KEY) for i in range(200_000)}
        assert len(tags) == 200_000 and {len(t) for t in tags} == {32}


@given(st.lists(st.integers(0, 9), min_size=1, max_size=24))
@settings(max_examples=200, deadline=None)
def test_feistel_turns_back(digits):
    out = P.permute_symbols(digits, 10, KEY, "t")
    assert len(out) == len(digits) and P.permute_symbols(out, 10, KEY, "t", back=True) == digits


def test_feistel_is_a_permutation():
    assert len({tuple(P.permute_symbols([a, b, c], 10, KEY, "t")) for a in range(10) for b in range(10) for c in range(10)}) == 1000
    assert sorted(P.permute_number(v, 777, KEY, "n") for v in range(777)) == list(range(777))
    day = dt.date(1971, 2, 28)
    assert P.permute_date(P.permute_date(day, KEY), KEY, back=True) == day


def test_formats_stay():
    assert P.permute_text(P.permute_text("TFCPF900490MM", KEY, "id"), KEY, "id", back=True) == "TFCPF900490MM"
    valid = "DE89370400440532013000"
    new = P.pseudonym(valid, "id_number", KEY)
    assert new != valid and P._iban_check(new[:2], new[4:]) == new[2:4]
    sv = P.pseudonym("52 271253 P 518", "id_number", KEY)
    dt.datetime.strptime(sv.split()[1], "%d%m%y")


def test_operator(spark):
    rows = [(1, "Tel. 030/23125-409", None, "x"), (2, "", "to a@b.example from H. Brennari", "y"), (3, None, None, "z"), (1, "Tel. 030/23125-409", None, "x"), (4, "ok " * 100000 + "SSN 985-80-2913", " ", "w")]
    df = spark.createDataFrame(rows, "load_seq long, note string, answer string, redacted string")
    got = {(r.load_seq, r.field_name): (list(r.pii_types), r.n_items) for r in P.redact_fields(df, ["note", "answer"], ["load_seq"], KEY).collect()}
    assert got == {(1, "note"): (["phone"], 1), (2, "note"): ([], 0), (2, "answer"): (["email", "name"], 2), (4, "note"): (["id_number"], 1), (4, "answer"): ([], 0)}
    assert P.redact_fields(df.limit(0), ["note"], ["load_seq"], KEY).count() == 0


def test_long_texts_take_time_in_proportion():
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["Anna Kaldsen", "12", "0171/3920046", "a.b@x.example", "Mr", "(", "+49", "x", "Street", "9 8 7 6 5 4 3 2 1"]) for _ in range(40000)) + "1 " * 50000 + "A" * 100000
    began = time.perf_counter()
    assert len(P.detect(text)) > 10000
    assert time.perf_counter() - began < 20
