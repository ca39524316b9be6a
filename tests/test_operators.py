import datetime as dt
import hashlib
import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidloom import lexicon as L
from evidloom.operators import bayes, components as M, constraints as C, extract as X, gate, joins as J, ledger as G, review as V, rollup as R, scoring as S, search, similarity as H, vault as A

TOKEN = re.compile(r"[A-Za-z0-9ÄÖÜäöüß_+-]+")


def toks(t):
    return [m.replace("ß", "ss").lower() for m in TOKEN.findall(t)]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["backup", "audit", "risk", "owner", "review", "mfa", "Straße", "x1", "the", "and", "patch", "log"]
    return [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(n)] + ["", None, "!!!"]


def model_windows(n, size, lap):
    out, s, step = [], 0, size - lap
    while n - s > size + step:
        out.append((s, s + size, s + size - lap, False))
        s += step
    return [*out, (s, n, n, True)] if n else []


@pytest.mark.parametrize("lap", [2, 5])
def test_windows(spark, lap):
    texts = ["x" * n for n in range(80)]
    got = {}
    for r in X.windows(docs(spark, texts), "doc_id", "text", 12, overlap=lap).orderBy("doc_id", "window_index").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.core_end, r.is_tail))
    assert got == {n: model_windows(n, 12, lap) for n in range(1, 80)}


def test_hits_belong_to_one_window(spark):
    texts = ["risk " * n for n in (1, 10, 500)]
    d = docs(spark, texts)
    hits = X.keyword_hits(d, "doc_id", "text", ["risk"])
    assert X.owned(hits, X.windows(d, "doc_id", "text", 64, overlap=20), "doc_id").count() == hits.count() == 511


def test_chunks(spark):
    texts = ["", " ", "a", "ab " * 700, "x" * 900, "x" * 901, None]
    got = {}
    for r in X.chunks(docs(spark, texts), "doc_id", "text").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.chunk_text))
        assert r.snippet_hash == hashlib.sha256(r.chunk_text.encode()).hexdigest()
    want = {}
    for i, t in enumerate(texts):
        flat, s = " ".join((t or "").split()), 0
        while s < len(flat):
            e = min(s + 900, len(flat))
            want.setdefault(i, []).append((s, e, flat[s:e].strip()))
            if e >= len(flat):
                break
            s = e - 120
    assert got == want


def test_evidence_rows(spark):
    texts = ["MFA and risk owner. mfa", "none", None, "the risk register"]
    rows = X.evidence_rows(docs(spark, texts), "doc_id", "text", L.CATEGORY_KEYWORDS, 10).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.keyword, r.category, r.evidence_no) for r in rows] == [
        (0, 0, "MFA", "access_control", 1), (0, 8, "risk owner", "risk_management", 2), (0, 20, "mfa", "access_control", 3), (3, 4, "risk register", "risk_management", 1)
    ]
    same = X.dedupe_evidence(X.evidence_rows(docs(spark, ["mfa"]), "doc_id", "text", L.CATEGORY_KEYWORDS).unionAll(X.evidence_rows(docs(spark, ["mfa"]), "doc_id", "text", L.CATEGORY_KEYWORDS)), "doc_id")
    assert same.count() == 1
    ok = spark.createDataFrame([("abcdef", 1, 3, "bc")], "t string, s int, e int, q string")
    assert ok.select(X.locator_ok(ok.t, ok.s, ok.e, ok.q, F.sha2("q", 256)).alias("x")).first().x


def test_scores(spark):
    d = docs(spark, ["owner policy tested review approved", "owner gap missing", "", "MFA MFA MFA dokumentiert risiko"])
    got = S.passage_scores(d, "text").orderBy("doc_id").collect()
    assert [(r.boost_hits, r.penalty_hits, r.critical_hits, round(r.score, 4), r.positive) for r in got] == [(5, 0, 0, 0.7, True), (1, 2, 2, 0.35, False), (0, 0, 0, 0.5, False), (1, 0, 0, 0.55, False)]
    conf = d.select(F.round(S.keyword_confidence(F.col("text"), F.lit("MFA")), 4).alias("c"), "doc_id").orderBy("doc_id").collect()
    assert [r.c for r in conf] == [0.55, 0.55, 0.0, 0.6]


def test_quality(spark):
    rows = [(1, "incident_reporting", "owner reviewed the process log within 24 hours", True, 0.7), (2, "incident_reporting", "owner", True, 0.7), (3, "risk_management", "template", True, 0.7), (4, "risk_management", "review in 2021 by the team", True, 0.7), (5, "x", "owner review", False, 0.7), (6, "x", "owner review", True, 0.66)]
    df = spark.createDataFrame(rows, "k int, category string, citation string, positive boolean, score double")
    got = {r.k: (r.quality, r.signals) for r in S.quality(df).collect()}
    assert got[1] == ("strong", []) and got[2] == ("warning", ["missing_review_date", "missing_timeline"]) and got[3][0] == "warning" and "outdated" in got[4][1]
    assert got[5][0] == "warning" and got[6][0] == "medium"


def test_topics(spark):
    df = spark.createDataFrame([(1, "Multi-Factor login, MFA documented and tested by the owner"), (2, "backup missing, tbd"), (3, "nothing here"), (4, "backup, expired"), (5, None)], "k int, chunk_text string")
    got = {r.k: (r.topics, r.n_terms, r.confidence, r.status) for r in S.chunk_scores(df, least=0.0).collect()}
    assert got == {1: (["mfa"], 3, 0.78, "covered"), 2: (["backup"], 1, 0.26, "needs_review"), 4: (["backup"], 1, 0.4, "stale_evidence")}


def test_bm25_equals_model(spark):
    texts = corpus(1)
    query = "Backup audit audit STRASSE missing"
    terms = list(dict.fromkeys(toks(query)))
    tk = [toks(t or "") for t in texts]
    n, avg = len(texts), sum(map(len, tk)) / len(texts)
    want = []
    for i, t in enumerate(tk):
        c, s = Counter(t), 0.0
        for q in terms:
            if c[q]:
                df = sum(q in x for x in tk)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * (c[q] * 2.5) / (c[q] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            want.append((i, round(s, 6)))
    want = sorted(want, key=lambda x: (-x[1], x[0]))[:7]
    assert [(r.doc_id, r.score) for r in search.bm25(docs(spark, texts), "doc_id", "text", query, 7).collect()] == want
    assert search.bm25(docs(spark, texts), "doc_id", "text", "??").count() == 0
    assert search.bm25(docs(spark, []), "doc_id", "text", "backup").count() == 0


def model_simhash(t):
    sums = [0] * 64
    counts = Counter(toks(t or ""))
    for w, c in counts.items():
        h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
        for i in range(64):
            sums[i] += c if h >> i & 1 else -c
    fp = sum(1 << i for i in range(64) if sums[i] >= 0) if counts else 0
    return fp - (1 << 64) if fp >> 63 else fp


def test_simhash_and_pairs(spark):
    rnd = random.Random(3)
    texts = corpus(2, 40)
    texts += [t + " extra" if t else t for t in rnd.sample(texts, 20)] + texts[:5]
    want = {i: model_simhash(t) for i, t in enumerate(texts)}
    d = docs(spark, texts)
    prints = H.fingerprints(d, "doc_id", "text")
    assert {r.doc_id: r.fp for r in prints.collect()} == want
    ham = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert [len(H._scheme(n, 6)[1]) for n in (10_000, 200_000, 10**7, 10**9)] == [7, 28, 84, 210]
    for most in (3, 6, 10):
        pairs = {(a, b, ham(a, b)) for a, b in itertools.combinations(sorted(set(want.values())), 2) if ham(a, b) <= most}
        assert {tuple(r) for r in H.near_pairs(prints, "doc_id", most).collect()} == pairs
    scheme = H._scheme
    H._scheme = lambda n, most: scheme(10**8, most)
    try:
        pairs = {(a, b, ham(a, b)) for a, b in itertools.combinations(sorted(set(want.values())), 2) if ham(a, b) <= 6}
        assert {tuple(r) for r in H.near_pairs(prints, "doc_id", 6).collect()} == pairs
    finally:
        H._scheme = scheme
    classes = {r.doc_id: (r.class_id, r.copies) for r in H.classes(prints, "doc_id").collect()}
    assert classes == {i: (min(k for k in want if want[k] == v), sum(x == v for x in want.values())) for i, v in want.items()}


def test_bayes_equals_model(spark):
    texts = [t for t in corpus(4, 50) if t]
    labels = ["a" if "mfa" in t else "b" if "risk" in t else "c" for t in texts]
    df = spark.createDataFrame([(i, t, lab) for i, (t, lab) in enumerate(zip(texts, labels, strict=True))] + [(900, "", "a"), (901, "x", None)], "doc_id long, text string, label string")
    terms, rows = bayes.train(df, "label", "text")
    counts = {lab: Counter(w for t, x in zip(texts, labels, strict=True) if x == lab for w in toks(t)) for lab in set(labels)}
    vocabulary = len({w for c in counts.values() for w in c})
    asked = [*texts, "", "unseen words", "mfa"]
    got = {r.doc_id: (r.label, r.confidence) for r in bayes.predict(docs(spark, asked), "doc_id", "text", terms, rows).collect()}
    for i, t in enumerate(asked):
        score = {lab: math.log(max(labels.count(lab) / len(labels), 1 / len(counts))) + sum(math.log((c[w] + 1) / (sum(c.values()) + vocabulary)) for w in toks(t)) for lab, c in counts.items()}
        best = min(sorted(counts), key=lambda lab: -round(score[lab], 9)) if toks(t) else min(counts)
        share = 1 / sum(math.exp(s - score[best]) for s in score.values()) if toks(t) else 0.0
        assert got[i][0] == best and abs(got[i][1] - share) < 2e-4


def test_reviews(spark):
    f = spark.createDataFrame([("F-1", "x"), ("F-2", "x"), ("F-3", "x")], "finding_id string, category string")
    r = spark.createDataFrame([("F-1", " Accepted\u00a0", "=1", 1), ("F-1", "rejected", "a@b.example /home/me/x", 2), ("F-2", "nonsense", None, 3), ("F-9", "open", "", 4), (None, "open", "", 5)], "finding_id string, review_status string, review_note string, load_seq long")
    got = {x.finding_id: (x.review_state, x.review_note) for x in V.apply_reviews(f, r).collect()}
    assert got == {"F-1": ("rejected", "[email:redacted] [path:redacted]"), "F-2": ("open", ""), "F-3": ("open", "")}
    assert [x.finding_id for x in V.unknown_reviews(r, f).collect()] == ["F-9"]
    assert {(x.finding_id, x.problem) for x in V.total_match(r.where("finding_id is not null"), f, "finding_id").collect()} == {("F-1", "decided_twice"), ("F-3", "undecided"), ("F-9", "unknown_finding")}
    state = r.select(V.review_state(F.col("review_status"))["unknown"].alias("u"), "load_seq").orderBy("load_seq").collect()
    assert [x.u for x in state] == [False, False, True, False, False]
    note = r.select(V.clean_note(F.lit("=cmd"))["note"].alias("n"), V.clean_note(F.lit("=cmd"))["changed"].alias("c")).first()
    assert (note.n, note.c) == ("'=cmd", True)


def test_joins(spark):
    a = spark.createDataFrame([(1, ["x", "y", "x"]), (2, []), (3, None), (4, ["z"])], "a int, xs array<string>")
    b = spark.createDataFrame([(10, ["x", "y"]), (11, ["q"]), (12, ["z", None])], "b int, ys array<string>")
    assert {tuple(r) for r in J.overlap_join(a, "a", "xs", b, "b", "ys").collect()} == {(1, 10, 2), (4, 12, 1)}
    q = spark.createDataFrame([(1, "How are backup-copies and access rights kept?"), (2, "?"), (3, None)], "k int, t string")
    got = [(r.k, r.control, r.score, r.rank) for r in J.match_controls(q, "k", "t", {"B": {"keywords": ["backup copies"], "title": ["Backup plan"]}, "A": {"keywords": ["access rights"], "evidence": ["access_rights"]}}, 2).orderBy("rank").collect()]
    assert got == [(1, "A", 5, 1), (1, "B", 4, 2)]
    t = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.UTC)
    answers = spark.createDataFrame([("c", "a3", "reviewed", 0.5, t(3)), ("c", "a2", "reviewed", 0.9, t(1)), ("c", "a1", "reviewed", 0.9, t(2)), ("c", "a0", "draft", 1.0, t(9)), ("d", "b", "reviewed", None, t(1))], "cluster string, answer_id string, review_status string, confidence double, updated_at timestamp")
    assert {r.cluster: r.answer_id for r in J.best_answer(answers, ["cluster"]).collect()} == {"c": "a1", "d": "b"}
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "v")], "k int, v string")
    assert {tuple(r) for r in J.left_with_default(left, right, "k", {"v": F.lit("none")}).collect()} == {(1, "v"), (2, "none")}


def test_rollups(spark):
    e = spark.createDataFrame([(1, "a", "strong"), (1, "a", "weak"), (2, "b", "weak"), (1, "b", "strong")], "doc int, category string, quality string")
    got = {(r.doc, r.category): r.n for r in R.category_counts(e, "doc", ["a", "b", "c"]).collect()}
    assert got == {(1, "a"): 2, (2, "b"): 1, (1, "b"): 1, (None, "a"): 2, (None, "b"): 2, (None, "c"): 0}
    bridge = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "b"), ("k3", "c")], "control string, category string")
    assert {tuple(r) for r in R.coverage(e, bridge, "doc").collect()} == {("k1", 4, 1, "strong"), ("k2", 2, 1, "strong"), ("k3", 0, 0, "missing")}
    empty = R.category_counts(e.limit(0), "doc", ["a"]).collect()
    assert [(r.doc, r.category, r.n) for r in empty] == [(None, "a", 0)]
    m = R.set_metrics(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int"), ["k"]).first()
    assert tuple(m) == (1, 1, 1, 0.5, 0.5)
    none = R.set_metrics(spark.createDataFrame([], "k int"), spark.createDataFrame([], "k int"), ["k"]).first()
    assert tuple(none) == (0, 0, 0, None, None)


def test_constraints(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("y", 2, None), ("y", 2, "p")], "id string, n int, v string")
    assert [tuple(r) for r in C.duplicate_keys(a, "id").collect()] == [("y", 2)]
    b = spark.createDataFrame([("x", 1, "p"), ("z", 3, None)], "id string, n int, v string")
    assert {tuple(r) for r in C.bijection(a.limit(2), b, ["id"], ["n", "v"]).collect()} == {("y", "only_left"), ("z", "only_right")}
    assert C.outside(a, "v", ["p"]).count() == 1 and C.not_matching(a, "id", "[x]").count() == 2
    assert {(r.id, tuple(r.violations)) for r in C.failing(a, small=F.col("n") < 2, set=F.col("v").isNotNull()).collect()} == {("y", ("small", "set")), ("y", ("small",))}
    C.require(a.limit(0), "fine")
    with pytest.raises(C.ConstraintError):
        C.require(a, "broken")
    assert C.field_set(["a", "c"], ["a", "b"]) == ["missing b", "unexpected c"]
    paths = spark.createDataFrame([(p,) for p in ("a/b.txt", "/a", "../a", "a/.env", "C:\\x", "a/my_secret.txt", "", "db.sqlite")], "p string")
    assert [r.x for r in paths.select(C.safe_relative_path(F.col("p")).alias("x")).collect()] == [True] + [False] * 7


def test_gate(spark):
    rows = [("DPO_email", "x@y.example"), ("dpo_email", "nope"), ("iban", "x"), ("website", "https://a.example"), ("company_name", ""), (None, "x"), ("dpo_phone", "+49 30 1234567"), ("vat_id", "DE 123-4")]
    df = spark.createDataFrame(rows, "n string, v string")
    assert [r.field_class for r in gate.classify_fields(df, "n", "v").collect()] == [1, 2, 2, 1, 2, 2, 1, 1]
    t = spark.createDataFrame([("keep a@b.example, hide c@d.example",)], "t string").select(gate.guard_text(F.col("t"), ["a@b.example"]).alias("g")).first().g
    assert (t.text, t.masked_types) == ("keep a@b.example, hide [email:redacted]", ["email"])


def test_components(spark):
    inventory = {"bomFormat": "CycloneDX", "specVersion": "1.5", "components": [
        {"bom-ref": "1", "name": " lib ", "version": "1", "purl": "pkg:x", "licenses": [{"expression": "MIT"}, {"license": {"id": "Apache-2.0"}}, {"license": {"name": "MIT"}}], "hashes": [{"alg": "SHA-1", "content": "ff"}]},
        {"bom-ref": "2", "name": "LIB", "version": "1", "purl": "PKG:x"},
        {"name": "other"},
    ]}
    df = spark.createDataFrame([(1, json.dumps(inventory)), (2, "{"), (3, '{"bomFormat": "SPDX"}'), (4, None), (5, '{"bomFormat": "CycloneDX", "specVersion": "1.2"}')], "k int, j string")
    c = M.components(df, "k", "j").withColumn("id", F.col("no"))
    assert [(r.name, r.licenses, len(r.hashes)) for r in c.orderBy("no").collect()] == [("lib", ["Apache-2.0", "MIT"], 1), ("LIB", [], 0), ("other", [], 0)]
    assert {(r.id, r.gap) for r in M.gaps(c, "id").collect()} == {(1, "duplicate_component"), (2, "duplicate_component"), (2, "missing_license"), (2, "missing_checksum"), (3, "missing_version"), (3, "missing_license"), (3, "missing_checksum"), (3, "unknown_package_id")}
    assert {(r.k, r.problem) for r in M.inventory_problems(df, "k", "j").collect()} == {(2, "unreadable"), (3, "format"), (4, "unreadable"), (5, "version")}


def test_vault(spark):
    now = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 2, 20), ("b", 3, 15), ("c", 9, 5)], "k string, v int, at int")
    assert {tuple(r) for r in A.upsert(now, new, ["k"], ["at"]).collect()} == {("a", 1, 10), ("b", 2, 20), ("c", 9, 5)}
    kept = A.upsert(now.withColumn("made", F.col("at")), new.withColumn("made", F.col("at")), ["k"], ["at"], "made")
    assert {(r.k, r.v, r.made) for r in kept.collect()} == {("a", 1, 10), ("b", 2, 10), ("c", 9, 5)}
    assert [tuple(r) for r in A.replaced(now, new, ["k"]).collect()] == [("b", 1, 10)]
    v = A.versions(now.unionAll(new), "k", ["at"])
    assert {(r.k, r.v, r.version_no, r.is_current) for r in v.collect()} == {("a", 1, 1, True), ("b", 1, 1, False), ("b", 3, 2, False), ("b", 2, 3, True), ("c", 9, 1, True)}
    assert {(r.k, r.at) for r in A.touch(now.drop("v"), new.drop("v"), ["k"], "at").collect()} >= {("a", 10), ("b", 20)}


def test_ledger(spark):
    rows = [(c, i, f"e{i}", "start" if i == 0 else "go") for c in ("p", "q") for i in range(50)]
    events = spark.createDataFrame(rows, "chain string, at int, body string, kind string")
    chain = G.append_chain(events, ["chain"], ["body", "kind"], ["at"])
    last = "0" * 64
    for r in sorted((x for x in chain.collect() if x.chain == "p"), key=lambda x: x.sequence):
        assert r.previous_hash == last
        last = hashlib.sha256(f"{last}\n{r.body}\n{r.kind}".encode()).hexdigest()
        assert r.event_hash == last
    assert G.chain_problems(chain, ["chain"], ["body", "kind"]).count() == 0
    bad = chain.where("not (chain = 'q' and sequence = 7)").withColumn("body", F.when((F.col("chain") == "p") & (F.col("sequence") == 3), "zz").otherwise(F.col("body")))
    got = {(r.chain, r.sequence): r.problem for r in G.chain_problems(bad, ["chain"], ["body", "kind"]).collect()}
    assert got["p", 3] == "event_hash" and got["q", 8] == "sequence" and len([k for k in got if k[0] == "p"]) == 1
    heads = chain.groupBy("chain").agg(F.max("sequence").alias("sequence"), F.max_by("event_hash", "sequence").alias("event_hash"))
    more = G.append_chain(spark.createDataFrame([("p", 99, "late", "go")], "chain string, at int, body string, kind string"), ["chain"], ["body", "kind"], ["at"], heads)
    assert G.chain_problems(chain.unionByName(more), ["chain"], ["body", "kind"]).count() == 0
    e = spark.createDataFrame([("p", 1, "go"), ("p", 2, "start"), ("p", 3, "go"), ("p", 4, "end"), ("p", 5, "go")], "chain string, n int, kind string")
    t = {(r.n, r.problem) for r in G.transition_problems(e, ["chain"], "kind", "n", {"go": ["start"], "end": ["start"]}, {"go": ["end"]}, "start").collect()}
    assert t == {(1, "needs_start"), (2, "not_first"), (5, "after_end")}
    assert G.completion_problems(e, ["chain"], "kind", "end").count() == 0 and G.completion_problems(e, ["chain"], "kind", "x").count() == 1
    roles = spark.createDataFrame([("analysis_a", "operator"), ("analysis_b", "auditor"), ("review_x", "admin")], "kind string, role string")
    assert [r.kind for r in G.role_problems(roles, "kind", "role", {"analysis_": "operator", "review_": "reviewer"}).collect()] == ["analysis_b"]


def test_ladders_skip_unknown_conditions(spark):
    df = spark.createDataFrame([(None,), (5,), (1,)], "n int")
    assert [r.x for r in df.select(S.ladder((F.col("n") > 3, "high"), (F.col("n") > 0, "low"), otherwise="none").alias("x")).collect()] == ["none", "high", "low"]


def test_url_check(spark):
    rows = [("https://a.example/x", 200, None, None), ("http://a.example", 200, None, None), ("https://b.test", 200, None, None), ("https://a.example", 301, "/y", None), ("https://a.example", 301, "ftp://z", None), ("https://a.example", 403, None, None), ("https://a.example", 500, None, None), ("https://a.example", None, None, "timeout")]
    df = spark.createDataFrame(rows, "u string, s int, l string, e string")
    got = [tuple(r.x) for r in df.select(C.url_check(df.u, df.s, df.l, df.e, r"\.example$").alias("x")).collect()]
    assert [g[0] for g in got] == ["PASS", "FAIL", "FAIL", "PASS", "WARN", "WARN", "FAIL", "WARN"]


def test_a_set_of_queries_is_searched_as_each_alone(spark, sf):
    import __spark_entry__ as entry
    from evidloom.operators import search

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()
    got = {}
    for r in entry.queries()["bm25_set_top10"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    queries = docs.where("doc_id % 50 = 0").collect()
    assert len(queries) > 1 and got.keys() == {q.doc_id for q in queries if q.text and q.text.strip()}
    for q in queries[:2]:
        want = [(r.doc_id, r.score) for r in search.bm25(docs, "doc_id", "text", q.text, 10).collect()]
        assert [d for d, _ in got[q.doc_id]] == [d for d, _ in want] and [s for _, s in got[q.doc_id]] == pytest.approx([s for _, s in want], abs=2e-6)
    few = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None), (4, "zz a")], "k long, t string")
    asked = spark.createDataFrame([("x", "B a a"), ("y", "none"), ("z", None), ("w", "zz")], "q string, t string")
    assert [(r.query_id, r.k) for r in search.bm25_set(asked, "q", "t", few, "k", "t", 2).orderBy("query_id", "rank").collect()] == [("w", 4), ("x", 1), ("x", 2)]
    assert search.bm25_set(asked, "q", "t", few.limit(0), "k", "t").count() == 0


def test_near_pairs_broadcast_no_side(spark):
    prints = spark.range(3000).select("id", F.xxhash64("id").alias("fp"))
    plan = H.near_pairs(prints, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_votes_do_not_depend_on_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(H, "_AT_ONCE", 3)
    texts = ["a b c", "a", "b b c d e f g h", "x", "y z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([toks(t) for t in texts])], names=["k", "t"])
    (got,) = H._votes(iter([batch.slice(1)]))
    sums = [list(r.values())[1:] for r in got.to_pylist()]
    assert [sum(1 << i for i in range(64) if s[i] >= 0) for s in sums] == [model_simhash(t) & (1 << 64) - 1 for t in texts[1:]]
    twice = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a"), (2, "!")], "doc_id long, text string")
    got = {(r.doc_id, r.fp) for r in H.fingerprints(twice, "doc_id", "text").collect()}
    assert got == {(1, model_simhash("a b c")), (None, 0), (2, 0)}


def test_best_of_a_task_equals_brute_force(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(5)
    words = ["the", "of", "and", "to", *(f"w{i}" for i in range(40))]
    weights = [30, 30, 20, 20, *(40 / (i + 1) for i in range(40))]
    texts = [rnd.choices(words, weights, k=rnd.randint(1, 30)) for _ in range(400)]
    texts += texts[:60]  # ties, which go by key
    asked = {f"q{i}": sorted(set(rnd.choices(words, weights, k=rnd.randint(1, 20)))) for i in range(25)}
    df, n, average = Counter(w for t in texts for w in set(t)), len(texts), sum(map(len, texts)) / len(texts)
    items = [(q, t, float(df[t])) for q, ts in asked.items() for t in ts if df[t]]
    sent = search._asked(pa.table([pa.array(c) for c in zip(*items, strict=True)], names=["_q", "term", "_df"]), float(n))
    keys = [f"k{i:03}" for i in rnd.sample(range(n), n)]
    parts = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 70]), pa.array(texts[a : a + 70])], names=["k", "t"]) for a in range(0, n, 70)]
    want = []
    for q, ts in asked.items():
        scores = []
        for k, t in zip(keys, texts, strict=True):
            c = Counter(t)
            s = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in ts), 6)
            scores += [(q, k, s)] if s > 0 else []
        want += sorted(scores, key=lambda x: (-x[2], x[1]))[:7]
    for share, cells in ((0.02, 4_000_000), (0.3, 500), (2.0, 25)):  # most terms common, few, none; blocks of 1000, 20 and 1
        monkeypatch.setattr(search, "_COMMON", share)
        monkeypatch.setattr(search, "_CELLS", cells)
        sent = search._asked(pa.table([pa.array(c) for c in zip(*items, strict=True)], names=["_q", "term", "_df"]), float(n))
        got = [(sent["keys"][int(q)].as_py(), k.as_py(), s.as_py()) for qs, ks, ss in search._best(iter(parts), sent, 7, 1.5, 0.75, average) for q, k, s in zip(np.array(qs), ks, ss, strict=True)]
        assert sorted(x[:2] for x in got) == sorted(x[:2] for x in want)  # no more than the best of the whole task
        assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(want)], abs=2e-6)
    few = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None), (4, "zz a")], "k long, t string")
    twice, once = (spark.createDataFrame(rows, "q string, t string") for rows in ([("x", "a"), ("x", "a b"), ("w", "zz")], [("x", "a b"), ("w", "zz")]))
    monkeypatch.setattr(search, "_ASKED", 1)
    both = [search.bm25_set(q, "q", "t", few, "k", "t", 2).orderBy("query_id", "rank").collect() for q in (twice, once)]
    assert both[0] == both[1] and [(r.query_id, r.k) for r in both[0]] == [("w", 4), ("x", 1), ("x", 2)]


def test_links_find_pairs_once_without_broadcast(spark):
    prints = spark.range(3000).select("id", F.xxhash64("id").alias("fp"))
    plan = H.links(prints, "id")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[combination", plan) == ["SortMergeJoin"]
