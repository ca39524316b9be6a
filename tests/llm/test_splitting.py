import hashlib
import random

import pytest

from evidloom.llm import splitting as P
from tests.oracle import same


def rejoin(text, parts):
    out = ""
    for a, z, _ in parts:
        assert a <= len(out)
        out = out[:a] + text[a:z]
    return out


def prose(seed, n):
    rnd = random.Random(seed)
    text = ""
    while len(text) < n:
        text += "".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) + rnd.choice([" "] * 8 + [". ", "\n", "\n\n"])
    return text[:n]


@pytest.mark.parametrize("text", ["", "short", "x" * 2400, "x" * 2401, "x" * 9000, " " * 5000, "\n" * 5000, prose(1, 30000), "查" * 6001, "ab " * 900, prose(2, 2401)])
def test_round_trip(text):
    parts = P.pieces(text)
    assert rejoin(text, parts) == text
    assert all(z - a <= 2400 for a, z, _ in parts)
    for (a, z, _), (b, _, _) in zip(parts, parts[1:], strict=False):
        assert 200 <= z - b <= 240 and z - a >= 1200
    assert len(parts) == (0 if not text else 1) or len(text) > 2400


def test_cuts_at_the_best_boundary():
    text = prose(3, 40000)
    cuts = [(z, kind) for _, z, kind in P.pieces(text)[:-1]]
    assert {k for _, k in cuts} <= {"paragraph", "line", "sentence"}
    assert all(text[:z].rstrip(" ").endswith("\n") for z, k in cuts if k in ("paragraph", "line"))
    words_only = text.replace("\n", " ").replace(".", "")
    assert all(words_only[z - 1] == " " for _, z, _ in P.pieces(words_only)[:-1])


def test_an_edit_alters_neighbours_only():
    text = prose(4, 60000)
    edited = text[:20000] + "INSERTED WORDS " + text[20000:]
    before = {text[a:z] for a, z, _ in P.pieces(text)}
    after = {edited[a:z] for a, z, _ in P.pieces(edited)}
    assert len(before - after) <= 6 and len(before) > 30


def test_operator(spark):
    long = prose(5, 7000)
    rows = [(1, "p", long, 9), (2, None, long, 9), (3, "q", None, 9), (4, "q", "", 9), (5, "q", "x" * 2400, 9), (6, "r", "x" * 300000, 9), (1, "p", long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, source_path string, text string, start int")
    got = P.split_texts(df).collect()
    assert {r.doc_id for r in got} == {1, 2, 6}
    assert all(r.snippet_hash == hashlib.sha256(r.piece.encode()).hexdigest() for r in got)
    own = [r.chunk_id for r in got if r.doc_id == 6]
    assert len(set(own)) == len(own)
    assert {r.source_path for r in got if r.doc_id == 2} == {None}
    assert P.split_texts(df.limit(0)).count() == 0


def test_found_against_sql(spark, sf):
    from evidloom.llm import queries as Q

    assert same(spark, sf, Q.p3_found, Q.SQL["p3_found"]) > 0


def test_a_joined_sign_stays_whole():
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    text = family * 900
    got = P.pieces(text)
    assert all(len(text[a:z]) <= 2400 for a, z, _ in got) and all(z % len(family) == 0 and a % len(family) == 0 for a, z, _ in got)
    accents = "e\u0301" * 3000
    assert all(a % 2 == 0 and z % 2 == 0 for a, z, _ in P.pieces(accents))
