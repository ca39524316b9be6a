"""Nothing is decided by a prefix, a cap or the size of the input."""

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from evidloom.functions import patterns as P
from evidloom.functions import terms as TM
from evidloom.operators import bayes, constraints, evaluate, extract, gate, joins, ledger, review
from evidloom.plans import pipeline
from evidloom.session import spread
from evidloom.sources import artefacts, files


def test_a_secret_behind_five_thousand_characters(spark):
    text = "plain words " * 450 + "password = hunter2 and more"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert [(r.type, r.match) for r in P.scan_lines(df, "k", "t").collect()] == [("secret", "hunter2")]
    row = df.select(P.has_sensitive(F.col("t")).alias("s"), gate.guard_text(F.col("t"), ["a@b.example"])["text"].alias("g"), review.clean_note(F.col("t"), None)["note"].alias("n"), review.clean_note(F.col("t"))["cut"].alias("c"), P.safe_text(F.col("t"), 10_000).alias("x")).first()
    assert row.s and row.c and all("hunter2" not in v and "[secret:redacted]" in v for v in (row.g, row.n, row.x))


def test_a_high_finding_behind_many_others(spark):
    text = " ".join(f"user{i}@mail.example" for i in range(40)) + " password = x9"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    found = P.scan_lines(df, "k", "t")
    assert P.verdicts(found, df, "k").first().status == "block"
    listed = P.listed(found, "k", 5).collect()
    assert len(listed) == 5 and any(r.severity == "high" for r in listed)


def test_declared_numbers_in_any_spacing_but_no_accounts(spark):
    df = spark.createDataFrame([("call +49 30 1234567 or +49(30)123-4567, not +49 30 7654321; DE89370400440532013000, ghp_abcdefghijklmnop",)], "t string")
    out = df.select(gate.guard_text(F.col("t"), ["+49 30 1234567", "DE89370400440532013000", "ghp_abcdefghijklmnop"]).alias("g")).first().g
    assert out.text == "call +49 30 1234567 or +49(30)123-4567, not [phone:redacted]; [iban:redacted], [token:redacted]"
    long = "A" * 70 + "!"
    kinds = gate.classify_fields(spark.createDataFrame([("vat_id", long), ("vat_id", "A" * 70)], "n string, v string"), "n", "v")
    assert sorted(r.class_reason for r in kinds.collect()) == ["declared_company_metadata", "declared_field_failed_validation"]


def test_twenty_thousand_labels(spark):
    n = 20_000
    docs = spark.range(n).selectExpr("id", "concat('l', lpad(id, 6, '0')) as lab", "concat('word', id, ' common') as text")
    terms, labels = bayes.train(docs, "lab", "text")
    some = docs.where("id % 2000 = 7").select("id", "text").unionByName(spark.createDataFrame([(-1, ""), (-2, None)], "id long, text string"))
    for block in (bayes.LABEL_BLOCK, 3000):
        got = {r.id: (r.label, r.confidence) for r in bayes.predict(some, "id", "text", terms, labels, block).collect()}
        assert {k: v[0] for k, v in got.items() if k >= 0} == {i: f"l{i:06d}" for i in range(7, n, 2000)}
        assert got[-1] == got[-2] == ("l000000", 0.0)
    salted = bayes.predict(some, "id", "text", terms, labels, model_rows=10)
    assert {r.id: (r.label, r.confidence) for r in salted.collect()} == got


def test_files_without_limits(spark, tmp_path):
    rows = "\n".join(",".join(f"cell{i}x{j}" + "y" * 300 for j in range(25)) for i in range(320))
    (tmp_path / "a.csv").write_text(rows)
    (tmp_path / "b.json").write_text(json.dumps(list(range(700))))
    (tmp_path / "c.txt").write_text("z" * 1_200_000)
    got = files.scan(spark, str(tmp_path))
    cut = {r.source_type: (r.n_chars, r.truncated) for r in files.read_documents(got).collect()}
    whole = {r.source_type: (r.n_chars, r.truncated) for r in files.read_documents(got, files.WHOLE).collect()}
    assert all(t for _, t in cut.values()) and cut["text"][0] == 1_000_000
    assert whole["text"] == (1_200_000, False) and not any(t for _, t in whole.values()) and whole["csv"][0] > 320 * 25 * 300


def test_places_of_many_hits(spark):
    text = "é risk " * 10_000 + "risks risk"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "risk")], "k int, t string")
    got = df.select("k", TM.occurrences(F.col("t"), TM.alternation(["risk"])).alias("o")).collect()
    assert [o.pos for o in got[0].o] == [2 + 7 * i for i in range(10_000)] + [70_006] and not got[1].o and [o.pos for o in got[3].o] == [0]


def test_ten_thousand_hits_collapse_and_windows_agree(spark):
    """Two published figures of the kind of work: positions by windows equal those of the whole text, and the hits of a dense
    document collapse into three citations."""
    dense = "".join(("The access control is tested. " + " " * 700, "An audit of access control. " + " " * 700, "No access control here. " + " " * 700)[i % 3] for i in range(9_540))
    df = spark.createDataFrame([(1, dense)], "doc_id long, text string")
    hits = extract.keyword_hits(df, "doc_id", "text", ["access control"])
    windows = extract.windows(df, "doc_id", "text")
    owned = extract.owned(hits, windows, "doc_id")
    assert hits.count() == owned.count() == owned.select("pos").distinct().count() == 9_540
    rows = extract.evidence_rows(df, "doc_id", "text", {"access": ("access control",)}, 300)
    assert extract.dedupe_evidence(rows, "doc_id").count() == 3


def test_overlap_of_a_frequent_element(spark):
    a = spark.range(300).selectExpr("id as l", "if(id % 2 = 0, array('hot', string(id)), array(string(id))) as xs")
    b = spark.range(6000).selectExpr("id as r", "if(id % 3 = 0, array('hot', string(id)), array(string(id))) as ys")
    got = {(r.l, r.r): r.shared for r in joins.overlap_join(a, "l", "xs", b, "r", "ys").collect()}
    want = {(x, y): (x % 2 == 0 and y % 3 == 0) + (x == y) for x in range(300) for y in range(6000) if (x % 2 == 0 and y % 3 == 0) or x == y}
    assert got == want


def test_ledger_neighbours_and_validated_append(spark):
    events = spark.createDataFrame([("t", i, f"e{i}") for i in range(50)], "tenant string, at int, what string")
    chain = ledger.append_chain(events.where("at < 30"), ["tenant"], ["at", "what"], ["at"])
    more = ledger.append_validated(chain, events.where("at >= 30"), ["tenant"], ["at", "what"], ["at"])
    whole = ledger.append_chain(events, ["tenant"], ["at", "what"], ["at"])
    key = lambda df: {(r.at, r.sequence, r.event_hash) for r in df.collect()}
    assert key(chain) | key(more) == key(whole) and ledger.chain_problems(whole, ["tenant"], ["at", "what"]).count() == 0
    gap = whole.where("sequence <> 7")
    assert {(r.sequence, r.problem) for r in ledger.chain_problems(gap, ["tenant"], ["at", "what"]).collect()} == {(8, "sequence")}
    twice = whole.unionByName(whole.where("sequence = 9"))
    assert {r.problem for r in ledger.chain_problems(twice, ["tenant"], ["at", "what"]).collect()} == {"sequence"}
    forged = whole.withColumn("previous_hash", F.when(F.col("sequence") == 5, "0" * 64).otherwise(F.col("previous_hash")))
    assert (5, "previous_hash") in {(r.sequence, r.problem) for r in ledger.chain_problems(forged, ["tenant"], ["at", "what"]).collect()}
    with pytest.raises(ledger.LedgerError):
        ledger.append_validated(gap, events, ["tenant"], ["at", "what"], ["at"])


def test_strict_reviews(spark):
    findings = spark.createDataFrame([("F-1",), ("F-2",)], "finding_id string")
    good = spark.createDataFrame([("F-1", "Accepted", "ok", 1)], "finding_id string, review_status string, review_note string, load_seq long")
    assert {(r.finding_id, r.review_state) for r in review.apply_strict(findings, good).collect()} == {("F-1", "accepted"), ("F-2", "open")}
    for row in (("F-1", "odd", "", 1), ("F-9", "open", "", 1), ("", "open", "", 1), (None, "open", "", 1)):
        with pytest.raises(constraints.ConstraintError):
            review.apply_strict(findings, spark.createDataFrame([row], good.schema))
    with pytest.raises(constraints.ConstraintError):
        review.apply_strict(findings, good.unionByName(good))
    with pytest.raises(constraints.ConstraintError):
        review.review_problems(good.drop("review_status"), findings)
    assert constraints.exit_code(constraints.ConstraintError("x")) == 7 and constraints.error_code(ValueError("too_large")) == "too_large" and constraints.exit_code(ledger.LedgerError()) == 8 and constraints.exit_code(KeyError()) == 70


def test_readers_check_what_they_load(spark, tmp_path):
    (tmp_path / "t.csv").write_text("item_id,text,label\n1,a,x\n2,,y\n")
    assert artefacts.training_items(spark, str(tmp_path / "t.csv")).count() == 2
    with pytest.raises(constraints.ConstraintError):
        artefacts.training_items(spark, str(tmp_path / "t.csv"), strict=True)
    with pytest.raises(FileNotFoundError):
        files.require_path(spark, str(tmp_path / "none"))
    with sqlite3.connect(tmp_path / "v.db") as c:
        artefacts.create_vault(c)
        c.executemany("insert into suppliers values (?, ?, ?)", [(str(i), "n", None) for i in range(120_001)])
    assert artefacts.sqlite_table(str(tmp_path / "v.db"), "suppliers", spark).count() == 120_001
    assert artefacts.sqlite_table(str(tmp_path / "v.db"), "answers", spark).count() == 0
    big = spark.createDataFrame([(150_000_000,), (60_000_000,)], "length long")
    assert evaluate.too_large_in_all(big).count() == 1 and evaluate.too_large_in_all(big.limit(1)).count() == 0


def test_only_small_scans_are_dealt_out(spark, monkeypatch):
    import evidloom.session as session

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Repartition" in spread(df)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(session, "MOST_SPREAD", 10)
    assert "Repartition" not in spread(df)._jdf.queryExecution().logical().toString()


def test_purge_stays_inside(spark, tmp_path):
    for name in ("../x", "/etc", ""):
        with pytest.raises(ValueError):
            pipeline.purge(spark, str(tmp_path), [name], really=True)


def test_questionnaires_of_any_length(spark, tmp_path):
    body = "id,question\n" + "\n".join(f"{'' if i == 5 else i},Is it {i}?" for i in range(400))
    (tmp_path / "q.csv").write_text(body)
    cut = artefacts.questionnaire(spark, str(tmp_path / "q.csv"))
    whole = artefacts.questionnaire(spark, str(tmp_path / "q.csv"), most=None)
    assert cut.where("problem = 'too_many'").count() == 100 and whole.where("problem is null").count() == 400
    assert whole.where("question_id = 'question_006'").first().question == "Is it 5?"
    assert dt.date.today()
