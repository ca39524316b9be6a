import datetime as dt
from collections import Counter

from evidloom.operators import orphans as O
from evidloom.plans import data_quality as Q
from tests.oracle import same

T = [dt.datetime(2024, 1, d, tzinfo=dt.UTC) for d in range(1, 29)]


def broken(spark, refs, targets, least=50_000):
    r = spark.createDataFrame(refs, "load_seq long, recorded_at timestamp, k string, first_at string")
    t = spark.createDataFrame(targets, "id string, recorded_at timestamp, deleted_at timestamp")
    got = O.orphans(O.scalar_refs(r, "r", "k"), O.lifetimes(t, "id"), least)
    return sorted((x.load_seq, x.ref_value) for x in got.collect())


def test_missing_late_and_deleted(spark):
    refs = [(1, T[5], "a", ""), (2, T[5], " a ", ""), (3, T[1], "a", ""), (4, T[20], "a", ""), (5, T[5], "zz", ""), (6, T[5], None, ""), (7, T[5], " \t", ""), (8, T[2], "a", ""), (9, T[5], None, "")]
    targets = [("a", T[3], T[20]), ("a", T[2], T[20]), (None, T[1], None)]
    assert broken(spark, refs, targets) == [(3, "a"), (4, "a"), (5, "zz")]


def test_hot_keys_take_the_other_path(spark):
    refs = [(i, T[i % 28], "hot" if i % 3 else f"k{i}", "") for i in range(900)]
    targets = [("hot", T[3], T[9]), *((f"k{i}", T[0], None) for i in range(0, 900, 2))]
    want = broken(spark, refs, targets)
    assert broken(spark, refs, targets, least=100) == want
    assert sum(1 for _, k in want if k == "hot") == sum(1 for i in range(900) if i % 3 and not 3 <= i % 28 < 9)


def test_counts_come_from_groups(spark):
    refs = [(i, T[i % 28], "hot" if i % 3 else f"k{i % 50}", "") for i in range(900)] + [(1000, None, "hot", ""), (1001, None, "none", "")]
    targets = [("hot", T[3], T[9]), *((f"k{i}", T[0], None) for i in range(0, 50, 2))]
    r = spark.createDataFrame(refs, "load_seq long, recorded_at timestamp, k string, first_at string")
    life = O.lifetimes(spark.createDataFrame(targets, "id string, recorded_at timestamp, deleted_at timestamp"), "id")
    rows = broken(spark, refs, targets)
    for least in (50_000, 100):
        got = {x.period: (x.broken, x.missing_keys) for x in O.orphan_counts(O.scalar_refs(r, "r", "k"), life, least).collect()}
        assert got == {"2024-01": (len(rows) - 1, len({k for n, k in rows if n < 1000})), None: (1, 1)}


def test_array_references(spark):
    df = spark.createDataFrame([(1, T[5], ["a", " a", "", None, "b"]), (2, T[5], []), (3, T[5], None)], "load_seq long, recorded_at timestamp, refs array<string>")
    assert sorted(r.ref_value for r in O.array_refs(df, "t", "refs").collect()) == ["a", "b"]


def test_empty_tables(spark):
    assert broken(spark, [], []) == []
    assert broken(spark, [(1, T[0], "a", "")], []) == [(1, "a")]


def test_queries_against_sql(spark, sf):
    assert same(spark, sf, Q.p5_found, Q.SQL["p5_found"]) > 0
    assert same(spark, sf, Q.p5_orphan_counts, Q.SQL["p5_orphan_counts"]) > 0


def test_counts_add_up(spark, sf):
    rows = Q.p5_found(spark, sf).collect()
    counts = {(r.ref_table, r.period): r.broken for r in Q.p5_orphan_counts(spark, sf).collect()}
    assert counts == Counter((r.ref_table, r.period) for r in rows)
