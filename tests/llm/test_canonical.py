import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidloom.llm import canonical as C

ENTRIES = [("open", ["Open", "Offen"]), ("reviewed", ["Reviewed", "Geprüft"]), ("not_applicable", ["Not applicable", "Nicht anwendbar", None]), ("approve", ["Approve"]), ("approve_with_changes", ["Mit Änderungen freigeben"])]
TRIE = C.build_trie(ENTRIES)


def distance(a, b):
    """Optimal string alignment, the plain way."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def paths():
    out = set()
    for value, labels in ENTRIES:
        for label in (value, *labels):
            if label:
                out |= {(value, C.fold(label)), (value, C.fold(label).translate(C._TRANSLITERATED))}
    return out


@given(st.one_of(st.text("aenopffrviwdlcbg ü", max_size=16), st.sampled_from(sorted(p for _, p in paths())).flatmap(lambda p: st.permutations(list(p)).map("".join))))
@settings(max_examples=300, deadline=None)
def test_automaton_equals_brute_force(text):
    want = {(d, e, p) for e, p in paths() if (d := distance(text, p)) <= C.allowed(len(p))}
    assert set(TRIE.search(text)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("open", "open"), ("OPEN!", "open"), ("Opn", "open"), ("-> Offen", "open"), ('"oFFEN"', "open"), ("Geprueft", "reviewed"), ("status: gEPRÜFT", "reviewed"), ("Reviewed, see note", "reviewed"),
        ("open (2nd look)", "open"), ("Open / ok", "open"), ("Not applicab.", "not_applicable"), ("NO TAPPILCABLE", "not_applicable"), ("[not-applicable]", "not_applicable"), ("approve", "approve"),
        ("Approvei th changes", "approve_with_changes"), ("  mit änderungen  freigeben\xa0", "approve_with_changes"), ("ja", "unmatched"), ("???", "unmatched"), ("42", "unmatched"), ("who owns this", "unmatched"),
        ("lunch", "unmatched"), ("x" * 50000, "unmatched"),
    ],
)
def test_match(raw, want):
    assert C.match(TRIE, raw)[0] == want


def test_full_tie_is_unmatched():
    assert C.match(C.build_trie([("cast", []), ("cart", [])]), "caxt") == ("unmatched", None)


def test_operator(spark):
    rows = [(1, "Open", "c"), (2, None, "c"), (3, " \t\xa0", "c"), (4, "open", "c"), (1, "Open", "c"), (5, "zzz", "c")]
    df = spark.createDataFrame(rows, "load_seq long, v string, canon_value string")
    ref = spark.createDataFrame([(v, (labels + [None, None])[0], (labels + [None, None])[1]) for v, labels in ENTRIES], "canon_value string, a string, b string")
    got = sorted((r.load_seq, r.canon_value, r.distance) for r in C.map_values(df, "v", ref, ["load_seq"]).collect())
    assert got == [(1, "open", 0), (1, "open", 0), (4, "open", 0), (5, "unmatched", None)]
    assert {r.canon_value for r in C.map_values(df, "v", ref.limit(0), ["load_seq"]).collect()} == {"unmatched"}
    assert C.map_values(df.limit(0), "v", ref, ["load_seq"]).count() == 0


def test_all_entries_within_distance_come_out(spark):
    ref = spark.createDataFrame([("cast",), ("cart",), ("carton",)], "canon_value string")
    df = spark.createDataFrame([(1, "caxt"), (2, "cart"), (3, "zzzz")], "load_seq long, v string")
    got = {r.load_seq: (r.canon_value, [(c.distance, c.entry) for c in r.candidates]) for r in C.map_values(df, "v", ref, ["load_seq"]).collect()}
    assert got == {1: ("unmatched", [(1, "cart"), (1, "cast")]), 2: ("cart", [(0, "cart"), (1, "cast"), (2, "carton")]), 3: ("unmatched", [])}


def test_aliases_are_paths_too(spark):
    ref = spark.createDataFrame([("open", "Offen"), ("done", "Fertig")], "canon_value string, label string")
    aliases = spark.createDataFrame([("done", "signed off"), ("open", "to be looked at"), (None, "x")], "canon_value string, alias string")
    df = spark.createDataFrame([(1, "Signed of"), (2, "TO BE LOOKED-AT"), (3, "offen"), (4, "fertig")], "load_seq long, v string")
    for size in (50_000, 2):
        assert {r.load_seq: r.canon_value for r in C.map_values(df, "v", ref, ["load_seq"], aliases, size).collect()} == {1: "done", 2: "open", 3: "open", 4: "done"}


def test_a_list_longer_than_a_block(spark):
    names = spark.range(60_000).selectExpr("concat('E', left(sha2(string(id), 256), 14)) as canon_value")
    some = [r[0] for r in names.limit(30).collect()]
    rows = [(k, v.upper() if k % 3 == 0 else v[:9] + v[10:] if k % 3 == 1 else "nothing like " + v[6:8]) for k, v in enumerate(some)] + [(1000 + k, some[0]) for k in range(100)]
    df = spark.createDataFrame(rows, "load_seq long, v string")
    got = {r.load_seq: r.canon_value for r in C.map_values(df, "v", names, ["load_seq"]).collect()}
    assert got == {k: some[k] if k < 1000 and k % 3 < 2 else some[0] if k >= 1000 else "unmatched" for k, _ in rows}


def test_blocks_give_what_one_trie_gives(spark):
    ref = spark.createDataFrame([(v, (labels + [None, None])[0], (labels + [None, None])[1]) for v, labels in ENTRIES], "canon_value string, a string, b string")
    typed = ["Open", "Opn", "geprueft", "status: gEPRÜFT", "approve", "Approvei th changes", "???", "lunch", "Not applicab.", "open, reviewed"]
    df = spark.createDataFrame(list(enumerate(typed)), "load_seq long, v string")
    one, many = ({tuple(r) for r in C.map_values(df, "v", ref, ["load_seq"], block_paths=n).select("load_seq", "canon_value", "distance", F.to_json("candidates")).collect()} for n in (50_000, 3))
    assert one == many
