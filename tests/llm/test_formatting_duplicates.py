import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidloom.llm import codepoints as cp
from evidloom.llm import formatting_duplicates as D


def solid(s):
    return "".join(c for c in s.casefold() if c.isalnum())


def brute(texts):
    """Groups by the two rules, joined by union and find."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    rows = {}
    for k, t in texts:
        if not t or not solid(t):
            continue
        rows[k] = find(("text", solid(t)))
        parts = [p for p in re.split(r"[|;\n\r]", t) if solid(p)]
        if len(parts) > 1 and all(":" in p and solid(p.split(":", 1)[0]) for p in parts):
            fields = tuple(sorted((solid(p.split(":", 1)[0]), solid(p.split(":", 1)[1])) for p in parts))
            up[find(("text", solid(t)))] = find(("fields", fields))
    groups = defaultdict(list)
    for k in rows:
        groups[find(("text", solid(dict(texts)[k])))].append(k)
    return {(k, min(g), len(g)) for g in groups.values() for k in g}


def run(spark, texts, **more):
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts], "load_seq long, original_question string, first string")
    return {(r.load_seq, r.first, r.copies) for r in D.duplicates(df, **more).collect()}


def test_rules(spark):
    texts = [
        (1, "Is it  open?"), (2, "IS IT OPEN"), (3, "„is_it – open“"), (4, "Is it opened?"), (5, None), (6, ""), (7, " ?! "), (8, "A: x | B: y"), (9, "b:Y;  a : \"X\" "), (10, "a: y | b: x"),
        (11, "B: y\nA: x"), (12, "ab xy"), (13, "axby"), (14, "Straße 1"), (15, "STRASSE 1"), (16, "strasse 2"), (17, "x" * 100000), (18, "X " * 100000), (19, "Is it open?"), (20, "A: x | A: x | B: y"),
    ]
    got = run(spark, texts)
    assert got == brute(texts)
    first = {k: f for k, f, _ in got}
    assert first[2] == first[3] == first[19] == 1 and first[4] == 4 and first[9] == first[11] == first[13] == 8 and first[10] == 10 and first[15] == 14 and first[18] == 17
    assert not {5, 6, 7} & set(first)


def test_a_text_divided_in_two_ways_joins_both(spark):
    texts = [(1, "A: BC | D: E"), (2, "AB: C | D: E"), (3, "D: E | A: BC"), (4, "D:E;AB:C"), (5, "abcde"), (6, "AB: CD | X: E"), (7, "other")]
    assert run(spark, texts) == brute(texts)


def test_random_texts(spark):
    rnd = random.Random(1)
    pool = ["A: x1", "b : Y", "c: z", "ab", "?", "Ä-ö", "Is it so"]
    texts = [(k, rnd.choice([" ", "|", "; ", "\n", ""]).join(rnd.choices(pool, k=rnd.randint(0, 4)))) for k in range(800)]
    assert run(spark, texts) == brute(texts)


def test_a_long_chain_of_divisions_is_one_group(spark):
    # each text of letters is divided in two ways, each way being that of the next text, too
    word = "abcdefghijklmnopqrstuvwxyz"
    texts = [(k, f"{word[: k % 24 + 1]}: {word[k % 24 + 1 :]} | z: {k // 24 * 2}") for k in range(20)] + [(100 + k, f"z: {0} | {word[: k + 1]}: {word[k + 1 :]}") for k in range(20)]
    assert run(spark, texts) == brute(texts)


def test_components_of_a_path(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in zip(order, order[1:])], "u binary, v binary")
    assert {bytes(r.least) for r in D._components(edges).collect()} == {b"\0\0"} and D._components(edges).count() >= n - 1


def test_one_question_in_a_third_of_all_rows(spark):
    rnd = random.Random(5)
    texts = [(k, "".join(rnd.choice([c.upper(), c, c + " ", c + "-"]) for c in "is it the same question") if k % 3 == 0 else f"question {k // 2}") for k in range(3000)]
    want = brute(texts)
    assert run(spark, texts, least=100) == run(spark, texts) == want


def test_rows_of_one_hash_that_differ(spark, monkeypatch):
    whole = D.keyed
    monkeypatch.setattr(D, "keyed", lambda *a: whole(*a).withColumn("sequence", F.lit(b"0")))
    assert run(spark, [(1, "a"), (2, "A!"), (3, "b"), (4, "c"), (5, "B")]) == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (5, 3, 2), (4, 4, 1)}


def test_signs_and_folds_are_those_of_the_tables():
    one, two, three = cp.folds()
    for c in range(0x110000):
        ch = chr(c)
        assert bool(D._SOLID.match(ch)) == bool(one[c]), hex(c)
        if one[c]:
            assert D._fold(ch) == "".join(chr(x) for x in (one[c], two[c], three[c]) if x)


@pytest.mark.parametrize(("a", "b", "want"), [("", "", True), ("a", "", False), ("a-b", "AB", True), ("ab c", "a bc!", True), ("ab c", "a bd", False), ("abc", "ab", False), ("straße", "STRAS SE", True), ("x" * 9999, "X " * 9999, True)])
def test_two_pointers(a, b, want):
    assert D.same_sequence(a, b) is want is D.same_sequence(b, a)


def test_comparison_finds_differences():
    assert D.same_text(["a b!", "a: 1 | b: 2", "x", ""], ["A-B", "B: 2; A: 1", "y", "?"]).tolist() == [True, True, False, True]


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_collapse(spark):
    df = spark.createDataFrame([(3, "Q?"), (1, "q"), (2, "other")], "load_seq long, original_question string")
    assert sorted(map(tuple, D.collapse(df).collect())) == [(1, "q", 2), (2, "other", 1)]
