import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from evidloom.llm import codepoints as cp
from evidloom.llm import gear
from evidloom.llm import shared_spans as S


def brute(texts, least):
    """All pairs with a common span of `least`, through all spans of that length."""
    owners = {}
    for k, t in texts.items():
        for i in range(len(t) - least + 1):
            owners.setdefault(t[i : i + least], set()).add(k)
    return {p for who in owners.values() for p in itertools.combinations(sorted(who), 2)}


def pairs(spark, texts, least, **more):
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, digest int")
    return {(r[0], r[1]) for r in S.shared_pairs(df, least=least, **more).collect()}


def corpus(seed, n=60, least=80):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeäß查", k=rnd.randint(1, 7))) for _ in range(200)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    passages = [prose(60)[: least + d] for d in (-1, 0, 1, 5, 40)] + ["=" * (least + 20), "ab" * least]
    texts = {}
    for k in range(n):
        t = prose(rnd.randint(0, 60))
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            at = rnd.randint(0, len(t))
            t = t[:at] + p + t[at:]
        texts[k] = t
    texts[n] = texts[n + 1] = passages[4]
    return texts


def test_equals_brute_force(spark):
    texts = corpus(1)
    want = brute(texts, 80)
    assert len(want) > 50
    assert pairs(spark, texts, 80) == want


def test_hot_digests_equal_brute_force(spark):
    texts = corpus(2, 90)
    assert pairs(spark, texts, 80, many=2) == pairs(spark, texts, 80, many=2, hot=20) == pairs(spark, texts, 80) == brute(texts, 80)


def test_a_third_of_all_documents_shares_a_passage(spark):
    rnd = random.Random(7)
    fresh = lambda n: "".join(rnd.choices("abcdefghij .", k=n))
    boiler, copy, short = fresh(900), fresh(700), fresh(250)
    texts = {k: fresh(120) + (boiler if k % 3 == 0 else short if k % 3 == 1 else "") + fresh(120) for k in range(210)}
    texts |= {k: copy for k in range(300, 380)}
    want = set(itertools.combinations(range(0, 210, 3), 2)) | set(itertools.combinations(range(300, 380), 2))
    assert pairs(spark, texts, 300) == want


def test_production_length(spark):
    rnd = random.Random(3)
    fresh = lambda n: "".join(rnd.choices("abcdefgh .\n", k=n))
    shared = [fresh(300), fresh(299)]
    texts = {1: shared[0], 2: fresh(500) + shared[0] + fresh(50), 3: shared[1] + "x" * 400, 4: shared[1] + "y" * 400, 5: shared[0][1:] + "q" * 10, 6: None, 7: "", 8: "k" * 100000}
    assert pairs(spark, texts, 300) == {(1, 2)}


def test_null_empty_and_short(spark):
    assert pairs(spark, {1: None, 2: "", 3: "abc", 4: "abc"}, 80) == set()
    assert pairs(spark, {}, 80) == set()


def test_passages_and_shared_part(spark):
    rnd = random.Random(4)
    fresh = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    a, b = fresh(120), fresh(150)
    texts = {1: "1" * 30 + a + "2" * 30 + b, 2: "3" * 10 + a, 3: b + "4" * 90, 4: fresh(200), 5: None, 6: a[:99]}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, start int")
    got = {(r.doc_id, r.start, r.end) for r in S.shared_passages(df, least=100).collect()}
    assert got == {(1, 30, 150), (1, 180, 330), (2, 10, 130), (3, 0, 150)}
    part = {r.doc_id: (r.n_chars, r.shared_chars) for r in S.shared_part(df, least=100).collect()}
    assert part == {1: (330, 270), 2: (130, 120), 3: (240, 150), 4: (200, 0), 5: (0, 0), 6: (99, 0)}


def test_passages_equal_brute_force(spark):
    texts, least = corpus(6), 80
    owners = {}
    for k, t in texts.items():
        for i in range(len(t) - least + 1):
            owners.setdefault(t[i : i + least], set()).add(k)
    want = set()
    for k, t in texts.items():
        hit = [i for i in range(len(t) - least + 1) if len(owners[t[i : i + least]]) > 1]
        for _, run in itertools.groupby(enumerate(hit), lambda x: x[1] - x[0]):
            run = [i for _, i in run]
            want.add((k, run[0], run[-1] + least))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for hot in (S.HOT_ROWS, 10):
        assert {tuple(r) for r in S.shared_passages(df, least=least, hot=hot).collect()} == want


def test_spans_of_one_hash_that_differ(spark, monkeypatch):
    texts, least = corpus(6, 12), 80
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {tuple(r) for r in S.shared_passages(df, least=least).collect()}
    whole = S._span_hashes
    monkeypatch.setattr(S, "_span_hashes", lambda *a: whole(*a).withColumn("h1", F.col("h1") % 5).withColumn("h2", F.lit(0).cast("long")))
    assert {tuple(r) for r in S.shared_passages(df, least=least).collect()} == want != set()


def test_links_between_classes(spark):
    texts = corpus(8, 40) | {900: None, 901: None, 902: "", 903: ""}
    least = 80
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    head = {}
    for k, t in sorted(texts.items()):
        head.setdefault((t, k if t is None else 0), k)
    of = {k: head[t, k if t is None else 0] for k, t in texts.items()}
    linked = brute({k: t for k, t in texts.items() if t is not None and of[k] == k}, least)
    want = {(k, c, sum(o == c for o in of.values()), sum(c in p for p in linked)) for k, c in of.items()}
    assert {tuple(r) for r in S.shared_links(df, least=least).collect()} == want


def test_a_passage_in_half_of_many_documents(spark):
    rnd = random.Random(9)
    boiler = "".join(rnd.choices("abcdefghij .", k=400))
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.when(F.col("id") % 2 == 0, F.lit(boiler)).otherwise(F.sha2(F.concat(F.lit("x"), "id"), 512)), F.sha2(F.concat(F.lit("y"), "id"), 512)).alias("text"))
    got = S.shared_part(df).groupBy("shared_chars").count().collect()
    assert sum(r["count"] for r in got if r.shared_chars >= 400) == n // 2 and sum(r["count"] for r in got if r.shared_chars == 0) == n // 2
    some = df.where("doc_id < 3000")
    assert S.shared_pairs(some, hot=500).count() == 1500 * 1499 // 2


def test_landmarks_are_local_and_dense():
    rnd = np.random.default_rng(5)
    a = rnd.integers(97, 105, 3000).astype(np.uint32)
    b = np.concatenate([rnd.integers(97, 105, 777).astype(np.uint32), a])
    window = 56
    cuts = gear.landmarks(a, np.array([0, len(a)]), window)
    assert np.diff(cuts).max() <= window
    moved = gear.landmarks(b, np.array([0, len(b)]), window) - 777
    context = gear.WINDOW + window
    inner = lambda c: c[(c >= context) & (c < len(a) - context)]
    assert inner(cuts).tolist() == inner(moved).tolist()
    both = gear.landmarks(np.concatenate([a, b]), np.array([0, len(a), len(a), len(a) + len(b)]), window)
    assert both.tolist() == [*cuts.tolist(), *(moved + 777 + len(a)).tolist()]


def test_span_hashes_do_not_depend_on_place():
    points, starts = cp.decode(["xxhello", "hello", "hellp"])
    sums = cp.prefix_hash(points)
    h = cp.span_hash(sums, np.array([2, 7, 12]), np.array([7, 12, 17]))
    assert h[0] == h[1] != h[2]
