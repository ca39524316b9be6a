"""Queries over records: search, similarity, reviews, answers, ledgers, components, checks of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.functions import text as TX
from evidloom.operators import bayes, constraints as C, components as M, gate, joins as J, ledger as G, review as V, rollup as R, scoring as S, search, similarity as H, vault as A
from evidloom.plans import duck as K
from evidloom.session import spread, table

AS_OF = "2026-01-01"
KEPT = ("030/23125-409", "audit@kesselmail.invalid")
QUERY = "Backup copies, audit exercises and vendor audits after the restore"
CLUSTERS = ["access_control", "backup", "mfa", "restore_test", "supplier", "sbom"]
CONTROLS = {
    "SC-01": {"keywords": ["supplier contracts", "vendor audits", "lieferantenverträge"], "evidence": ["contract_list"], "title": ["Supplier security"]},
    "SC-02": {"keywords": ["incident reports", "störungsmeldungen"], "evidence": ["incident_reports"], "title": ["Incident handling and reports"]},
    "SC-03": {"keywords": ["patch windows", "change requests", "wartungsfenster", "änderungsanträge"], "evidence": ["test_data"], "title": ["Change and patch windows"]},
    "SC-04": {"keywords": ["backup copies", "restore exercises", "sicherungskopien"], "evidence": ["continuity_plans"], "title": ["Backup copies", "Continuity"]},
    "SC-05": {"keywords": ["access rights", "admin accounts", "remote logins", "zugriffsrechte", "multi-factor"], "evidence": ["key_rotation"], "title": ["Access rights"]},
}
REQUIRED = [("SC-01", ["contract", "audit report"]), ("SC-02", ["timeline"]), ("SC-03", ["ticket", "audit report"]), ("SC-04", ["drill protocol"]), ("SC-05", ["export file", "ticket"])]


def bm25_top10(spark, sf):
    return search.bm25(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", QUERY, 10)


def bm25_set_top10(spark, sf):
    """Every document whose id is divisible by 50 as a query, against all documents."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return search.bm25_set(docs.where("doc_id % 50 = 0"), "doc_id", "text", docs, "doc_id", "text", 10)


def simhash_fingerprints(spark, sf):
    fp = H.fingerprints(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")
    return fp.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))


def near_duplicate_pairs(spark, sf):
    """Pairs of different fingerprints within 6 bits; documents of one fingerprint are in near_duplicate_links."""
    pairs = H.near_pairs(H.fingerprints(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text"), "doc_id")
    return pairs.select(F.lower(F.lpad(F.hex("fp_a"), 16, "0")).alias("fp_a"), F.lower(F.lpad(F.hex("fp_b"), 16, "0")).alias("fp_b"), "distance")


def near_duplicate_links(spark, sf):
    return H.links(H.fingerprints(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text"), "doc_id")


def language_model(spark, sf):
    return bayes.train(spread(table(spark, sf, "documents").select("doc_id", "text", F.lower("lang").alias("lang"))), "lang", "text")[1]


def language_predictions(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", F.lower("lang").alias("lang")))
    terms, labels = bayes.train(docs, "lang", "text")
    return bayes.predict(docs, "doc_id", "text", terms, labels).select("doc_id", "label", F.round("confidence", 2).alias("confidence"))


def findings(spark, sf) -> DataFrame:
    return table(spark, sf, "evidence_record").select("load_seq", "evidence_id", F.trim("source_finding_id").alias("finding_id")).where("finding_id <> ''")


def applied_reviews(spark, sf):
    done = V.apply_reviews(findings(spark, sf), table(spark, sf, "review_items"))
    return done.select(F.col("load_seq"), "finding_id", "review_state")


def cleaned_review_notes(spark, sf):
    done = V.apply_reviews(findings(spark, sf), table(spark, sf, "review_items"), most=None)
    return done.select("load_seq", "review_note")


def unknown_reviews(spark, sf):
    return V.unknown_reviews(table(spark, sf, "review_items"), findings(spark, sf))


def decision_problems(spark, sf):
    return V.total_match(table(spark, sf, "review_items").where("review_status is not null").select("finding_id"), findings(spark, sf), "finding_id")


def accepted_evidence(spark, sf):
    done = V.apply_reviews(findings(spark, sf).drop("evidence_id").withColumn("category", F.lit("x")), table(spark, sf, "review_items"))
    return V.accepted(done).select("load_seq", "finding_id", "review_state", "evidence_id")


def shared_references(spark, sf):
    a = table(spark, sf, "questionnaire_draft").select(F.col("load_seq").alias("draft_seq"), "evidence_refs")
    b = table(spark, sf, "case_review_queue").select(F.col("load_seq").alias("queue_seq"), "evidence_refs")
    return J.overlap_join(a, "draft_seq", "evidence_refs", b, "queue_seq", "evidence_refs")


def best_chunks(spark, sf):
    c = table(spark, sf, "document_chunks")
    return J.best_evidence(c.select("document_id", "load_seq"), c, "document_id", "load_seq")


def question_controls(spark, sf):
    return J.match_controls(table(spark, sf, "questionnaire_draft"), "load_seq", "original_question", CONTROLS)


def question_evidence(spark, sf):
    required = spark.createDataFrame(REQUIRED, "control string, required array<string>")
    return J.required_evidence(required, question_controls(spark, sf), "load_seq").select("load_seq", F.array_join("required", "|").alias("required"))


def answers(spark, sf) -> DataFrame:
    d = table(spark, sf, "questionnaire_draft").where("matched_cluster is not null")
    until = F.date_format(F.date_add("recorded_at", 180), "yyyy-MM-dd")
    return d.select("client_id", F.col("matched_cluster").alias("cluster"), F.concat(F.lit("A-"), F.lpad(F.col("load_seq").cast("string"), 9, "0")).alias("answer_id"), "review_status", "confidence", F.col("recorded_at").alias("updated_at"), until.alias("valid_until"), F.col("evidence_refs").alias("refs"))


def best_answers(spark, sf):
    return J.best_answer(answers(spark, sf), ["client_id", "cluster"]).select("client_id", "cluster", "answer_id", "confidence", "valid_until")


def answer_drafts(spark, sf):
    best = J.best_answer(answers(spark, sf), ["cluster"])
    evidence = answers(spark, sf).where("review_status = 'draft'").groupBy("cluster").agg(F.max("confidence").alias("confidence"))
    questions = table(spark, sf, "case_review_queue").select("load_seq", F.col("proposed_cluster").alias("cluster"))
    return A.drafts(questions, best, evidence, "load_seq", AS_OF)


def missing_evidence(spark, sf):
    drafted = table(spark, sf, "questionnaire_draft").where("matched_cluster is not null").select(F.col("matched_cluster").alias("cluster"), F.col("review_status").alias("status"), "load_seq")
    topics = table(spark, sf, "document_chunks").select(F.explode("detected_topics").alias("topic"))
    return A.missing_rows(drafted, topics, [*CLUSTERS, "logging"], "load_seq")


def latest_drafts(spark, sf):
    d = table(spark, sf, "questionnaire_draft").select("case_id", "question_id", "review_status", "confidence", "recorded_at", "load_seq")
    return A.latest(d, ["case_id", "question_id"], ["recorded_at", "load_seq"], "recorded_at").select("case_id", "question_id", "review_status", "confidence", F.unix_micros("recorded_at").alias("first_us"), "load_seq")


def upserted_findings(spark, sf):
    """Findings recorded before 2025 as the table, the later ones as changes."""
    r = table(spark, sf, "review_items").select("finding_id", "category", "recorded_at", "load_seq")
    cut = F.lit("2025-01-01").cast("timestamp")
    return A.upsert(r.where(F.col("recorded_at") < cut), r.where(F.col("recorded_at") >= cut), ["finding_id"], ["recorded_at", "load_seq"]).select("finding_id", "category", "load_seq")


def replaced_findings(spark, sf):
    r = table(spark, sf, "review_items").select("finding_id", "recorded_at", "load_seq")
    cut = F.lit("2025-01-01").cast("timestamp")
    return A.replaced(r.where(F.col("recorded_at") < cut), r.where(F.col("recorded_at") >= cut), ["finding_id"]).select("finding_id", "load_seq")


def touched_clients(spark, sf):
    """Clients with the day of their latest row."""
    start = table(spark, sf, "clients").select("client_id", F.lit("2023-06-01").alias("seen"))
    seen = table(spark, sf, "review_items").where("client_id is not null").select("client_id", F.date_format("recorded_at", "yyyy-MM-dd").alias("seen"))
    return A.touch(start, seen, ["client_id"], "seen")


def finding_versions(spark, sf):
    r = table(spark, sf, "review_items").select("finding_id", "recorded_at", "load_seq", "review_status")
    return A.versions(r, "finding_id", ["recorded_at", "load_seq"]).select("finding_id", "load_seq", "version_no", F.unix_micros("valid_to").alias("valid_to_us"), "is_current")


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "props")


def ledger_append(spark, sf):
    return G.append_chain(events(spark, sf), ["user_id"], ["event_id", "event_type", "at", "props"], ["at", "event_id"]).select("user_id", "event_id", "sequence", "event_hash")


def ledger_problems(spark, sf):
    """A chain in which the content of all errors was altered after the fact."""
    chain = G.append_chain(events(spark, sf), ["user_id"], ["event_id", "event_type", "at", "props"], ["at", "event_id"])
    altered = chain.withColumn("props", F.when(F.col("event_type") == "error", F.lit("{}")).otherwise(F.col("props")))
    return G.chain_problems(altered, ["user_id"], ["event_id", "event_type", "at", "props"])


def ledger_transitions(spark, sf):
    numbered = events(spark, sf).withColumn("sequence", F.struct("at", "event_id"))
    got = G.transition_problems(numbered, ["user_id"], "event_type", "sequence", {"purchase": ["view"], "click": ["signup"]}, {"signup": ["purchase"]}, "signup")
    return got.select("user_id", F.col("sequence.event_id").alias("event_id"), "problem")


def ledger_roles(spark, sf):
    e = events(spark, sf).withColumn("role", F.when(F.col("props").contains("9"), "reviewer").otherwise("operator"))
    return G.role_problems(e, "event_type", "role", {"sign": "operator", "purchase": "reviewer"}).select("event_id", "event_type", "role")


def ledger_completion(spark, sf):
    return G.completion_problems(events(spark, sf), ["user_id"], "event_type", "purchase")


def parts(spark, sf) -> DataFrame:
    m = table(spark, sf, "manifest")
    return m.select(
        "load_seq", F.col("title").alias("name"), F.when(F.col("file_type") == "pdf", "").otherwise(F.col("document_version")).alias("version"), F.col("public_url").alias("purl"),
        F.array_compact(F.array("license_status")).alias("licenses"), F.array_compact(F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content")))).alias("hashes"),
    )


def component_gaps(spark, sf):
    return M.gaps(parts(spark, sf), "load_seq", ["name", "purl"])


def duplicate_components(spark, sf):
    return M.duplicate_groups(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type", "p_name"])


def parsed_components(spark, sf):
    """Inventories as JSON text, read back as components."""
    m = table(spark, sf, "manifest")
    component = F.struct(F.col("title").alias("name"), F.col("document_version").alias("version"), F.array(F.struct(F.lit(" ").alias("expression"), F.struct(F.col("license_status").alias("id")).alias("license"))).alias("licenses"))
    body = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.array(component, component).alias("components")))
    return M.components(m.select("load_seq", body.alias("body")), "load_seq", "body").select("load_seq", "no", "name", "version", "purl", F.array_join("licenses", "|").alias("licenses"))


def repeated_findings(spark, sf):
    return C.duplicate_keys(table(spark, sf, "review_items"), "finding_id")


def orphan_cases(spark, sf):
    """Cases whose source the manifest of before 2025 lacks."""
    return C.missing_targets(table(spark, sf, "cases"), "source_id", table(spark, sf, "manifest").where("recorded_at < timestamp'2025-01-01'"), "source_id").select("load_seq", "source_id")


def catalog_problems(spark, sf):
    """Manifest rows that fail checks, by name."""
    m = table(spark, sf, "manifest")
    bad = C.failing(m, sha=F.col("sha256").rlike("^[0-9a-f]{64}$"), url=F.col("public_url").rlike("^https://"), kind=F.col("file_type").isin("pdf", "json", "csv", "txt"), id=F.col("source_id").rlike("^src-[0-9a-f]{12}$"))
    return bad.select("load_seq", F.array_join("violations", "|").alias("violations"))


def register_differences(spark, sf):
    """The manifest against itself as it was before 2025."""
    m = A.latest(table(spark, sf, "manifest").select("source_id", "document_version", "license_status", "recorded_at", "load_seq"), ["source_id"], ["recorded_at", "load_seq"])
    old = A.latest(table(spark, sf, "manifest").where("recorded_at < timestamp'2025-01-01'").select("source_id", "document_version", "license_status", "recorded_at", "load_seq"), ["source_id"], ["recorded_at", "load_seq"])
    return C.bijection(m, old, ["source_id"], ["document_version", "license_status"])


def unsafe_paths(spark, sf):
    """Paths, some of which step out of their folder or name a secret."""
    n = F.col("doc_id") % 50
    path = F.when(n == 1, F.concat(F.lit("../"), "source_path")).when(n == 2, F.concat("source_path", F.lit("/.env.local"))).when(n == 3, F.concat(F.lit("/"), "source_path")).otherwise(F.col("source_path"))
    d = table(spark, sf, "documents").where("source_path is not null").withColumn("source_path", path)
    return d.where(~C.safe_relative_path(F.col("source_path"))).select("doc_id", "source_path")


def url_checks(spark, sf):
    m = table(spark, sf, "manifest")
    got = C.url_check(F.col("public_url"), F.when(F.col("file_type") == "pdf", 302).otherwise(200), F.lit("/moved"), F.when(F.col("file_type") == "csv", "timeout"), r"\.example$")
    return m.where("public_url is not null").select("load_seq", got.alias("g")).select("load_seq", "g.result", "g.reason")


def field_classes(spark, sf):
    m = table(spark, sf, "manifest")
    rows = m.select("load_seq", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in ((" Website ", "public_url"), ("company_name", "publisher"), ("vat_id", "source_id"), ("dpo_phone", "sha256"), ("title", "title"))))))
    return gate.classify_fields(rows, "name", "value").select("load_seq", F.trim("name").alias("name"), "field_class", "class_reason")


def guarded_notes(spark, sf):
    """Notes masked but for two declared values."""
    notes = table(spark, sf, "review_items").where("review_note is not null")
    got = gate.guard_text(F.col("review_note"), list(KEPT))
    return notes.select("load_seq", got["text"].alias("note"), F.array_join(got["masked_types"], "|").alias("masked"))


def supplier_scores(spark, sf):
    """Points of a supplier: a base by its balance, and capped points for late, returned and large lines."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_quantity") > 49).alias("large"))
    s = table(spark, sf, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    base = F.when(F.col("s_acctbal") < 0, 60).when(F.col("s_acctbal") < 5000, 40).otherwise(20)
    out = R.points_score(s, [("returned", "p_returned", 8, 24), ("open", "p_open", 3, 15), ("large", "p_large", 3, 12)], base)
    level = S.ladder((F.col("score") >= 80, "high"), (F.col("score") >= 60, "medium"), (F.col("score") >= 35, "low"), otherwise="watch")
    return out.select("s_suppkey", "score", "basis", level.alias("level"))


def stale_answers(spark, sf):
    return answers(spark, sf).select("answer_id", TX.is_stale(F.col("valid_until"), AS_OF).alias("stale"), TX.bucket(F.col("confidence"), [(0.75, "high"), (0.5, "medium")], "low", "unknown").alias("bucket"))


def stable_ids(spark, sf):
    r = table(spark, sf, "review_items")
    return r.select("load_seq", TX.stable_id("F-", [TX.collapse(F.lower("category")), F.col("document"), F.col("evidence_level")], 8).alias("stable_id"), TX.slug_id(F.col("control_area")).alias("slug"), TX.truncate(F.col("finding"), 60).alias("short"), TX.guard_formula(F.col("review_note")).alias("cell"))


def json_lists(spark, sf):
    q = table(spark, sf, "questionnaire_draft")
    raw = F.coalesce(F.to_json("evidence_refs"), F.col("missing_evidence"))
    return q.select("load_seq", F.array_join(TX.string_list(raw), "|").alias("items"))


def review_times(spark, sf):
    r = table(spark, sf, "review_items")
    t = TX.iso_time(F.col("reviewed_at"))
    return r.groupBy(t["error"].alias("error"), (t["value"] == "").alias("blank")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_top10, bm25_set_top10, simhash_fingerprints, near_duplicate_pairs, near_duplicate_links, language_model, language_predictions, applied_reviews, cleaned_review_notes, unknown_reviews, decision_problems, accepted_evidence, shared_references,
        best_chunks, question_controls, question_evidence, best_answers, answer_drafts, missing_evidence, latest_drafts, upserted_findings, replaced_findings, touched_clients, finding_versions, ledger_append, ledger_problems,
        ledger_transitions, ledger_roles, ledger_completion, component_gaps, duplicate_components, parsed_components, repeated_findings, orphan_cases, catalog_problems, register_differences, unsafe_paths, url_checks, field_classes,
        guarded_notes, supplier_scores, stale_answers, stable_ids, json_lists, review_times,
    )
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_QTERMS = list(dict.fromkeys(t.casefold() for t in QUERY.replace(",", "").split()))
_TF = ", ".join(f"len(list_filter(tk, lambda t: t = {K.quote(q)})) as tf{i}" for i, q in enumerate(_QTERMS))
_DF = ", ".join(f"count(*) filter (tf{i} > 0)::double as df{i}" for i in range(len(_QTERMS)))
_BM = " + ".join(
    f"case when tf{i} > 0 then ln(1.0::double + (n - df{i} + 0.5::double) / (df{i} + 0.5::double)) * (tf{i}::double * 2.5::double) / (tf{i}::double + 1.5::double * (0.25::double + 0.75::double * len / avgl)) else 0.0::double end" for i in range(len(_QTERMS))
)
_BITS = ", ".join(f"sum(case when (h >> {i}) & 1 = 1 then n else -n end) as b{i}" for i in range(64))
_FP = " + ".join(f"(case when b{i} >= 0 then {1 << i}::ubigint else 0::ubigint end)" for i in range(64))
_PRINTS = (
    f"tc as (select doc_id, t, count(*) as n from (select doc_id, unnest({K.tokens('text')}) as t from documents) group by 1, 2), vo as (select doc_id, {_BITS} from (select doc_id, n, ('0x' || left(sha256(t), 16))::ubigint as h from tc) group by 1),"
    f" fp as (select d.doc_id, coalesce({_FP}, 0::ubigint) as fp from documents d left join vo using (doc_id))"
)
_FIND = "fi as (select load_seq, evidence_id, trim(source_finding_id) as finding_id from evidence_record where trim(source_finding_id) <> '')"
_TYPED = f"lower({K.strip('coalesce(review_status, $$$$)')})".replace("$$$$", "''")
_STATE = f"case when {_TYPED} in (" + ", ".join(K.quote(s) for s in V.STATES) + f") then {_TYPED} else 'open' end"
_APPLIED = f"{_FIND}, la as (select finding_id, arg_max(coalesce(review_status, ''), load_seq) as review_status from review_items where finding_id is not null group by 1), ap as (select fi.load_seq, finding_id, {_STATE} as review_state from fi left join la using (finding_id))"


def _control_sql() -> str:
    parts = []
    for name, c in CONTROLS.items():
        fold = S.fold_term
        words = [w for t in c["title"] for w in fold(t).split() if len(w) > 3]
        parts.append(f"select load_seq, {K.quote(name)} as control, 3 * {K.hits('f', [fold(k) for k in c['keywords']])} + 2 * {K.hits('f', [fold(e) for e in c['evidence']])} + {K.hits('f', words)} as score from qf")
    return f"qf as (select load_seq, {K.for_match('original_question')} as f from questionnaire_draft), cs as ({' union all '.join(parts)}), cr as (select *, row_number() over (partition by load_seq order by score desc, control) as rank from cs where score > 0), qc as (select load_seq, control, score::int as score, rank::int as rank from cr where rank <= 3)"


#: The kept values: the mail address as it stands, the number in any spacing.
_KEEP = "audit@kesselmail\\.invalid|\\(?" + "[ \\t()./-]*".join(c for c in KEPT[0] if c.isdigit()) + "\\b"
_ANS = "an as (select client_id, matched_cluster as cluster, 'A-' || lpad(load_seq::varchar, 9, '0') as answer_id, review_status, confidence, recorded_at, strftime(((recorded_at at time zone 'UTC')::date + 180)::date, '%Y-%m-%d') as valid_until, evidence_refs as refs from questionnaire_draft where matched_cluster is not null)"
_EVENTS = "ev as (select user_id, event_id, event_type, epoch_us(ts) as at_us, props, row_number() over (partition by user_id order by ts, event_id) as sequence from events)"

SQL = {
    "bm25_top10": f"with tk as (select doc_id, {K.tokens('text')} as tk from documents), tf as (select doc_id, len(tk) as len, {_TF} from tk), st as (select count(*)::double as n, avg(len) as avgl, {_DF} from tf), sc as (select doc_id, round({_BM}, 6) as score from tf, st) select * from sc where score > 0 order by score desc, doc_id limit 10",
    "bm25_set_top10": f"with tk as (select doc_id, {K.tokens('text')} as tk from documents), st as (select count(*)::double as n, avg(len(tk)) as avgl from tk), tf as (select doc_id, t, count(*)::double as tf, any_value(l)::double as l from (select doc_id, len(tk) as l, unnest(tk) as t from tk) group by 1, 2), df as (select t, count(*)::double as df from tf group by 1), sc as (select q.doc_id as query_id, d.doc_id, round(sum(ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (d.tf * 2.5::double) / (d.tf + 1.5::double * (0.25::double + 0.75::double * d.l / avgl))), 6) as score from tf q join tf d using (t) join df using (t), st where q.doc_id % 50 = 0 group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from sc where score > 0) select * from r where rank <= 10",
    "simhash_fingerprints": f"with {_PRINTS} select doc_id, lower(lpad(to_hex(fp), 16, '0')) as fp from fp",
    "near_duplicate_pairs": f"with {_PRINTS}, u as (select distinct fp, case when fp >= 9223372036854775808::ubigint then (fp - 9223372036854775808::ubigint)::bigint - 9223372036854775807 - 1 else fp::bigint end as s from fp) select lower(lpad(to_hex(a.fp), 16, '0')) as fp_a, lower(lpad(to_hex(b.fp), 16, '0')) as fp_b, bit_count(xor(a.s, b.s))::int as distance from u a join u b on a.s < b.s and bit_count(xor(a.s, b.s)) <= 6",
    "near_duplicate_links": f"with {_PRINTS}, u as (select distinct fp from fp), l as (select a.fp, count(*) as links from u a join u b on a.fp <> b.fp and bit_count(xor(a.fp, b.fp)) <= 6 group by 1), c as (select fp, min(doc_id) as class_id, count(*) as copies from fp group by 1) select doc_id, class_id, copies, coalesce(links, 0) as links from fp join c using (fp) left join l using (fp)",
    "language_model": f"with d as (select lower(lang) as label, {K.tokens('text')} as tk from documents where lang is not null and trim(coalesce(text, '')) <> ''), t as (select label, unnest(tk) as token from d), a as (select label, count(*) as docs from d group by 1), b as (select label, count(*) as total from t group by 1), v as (select count(distinct token) as vocabulary from t), w as (select sum(docs) as n, count(*) as l from a) select label, docs, coalesce(total, 0) as total, greatest(docs / n::double, 1.0::double / l) as prior, vocabulary from a left join b using (label), v, w",
    "language_predictions": f"with d as (select lower(lang) as label, {K.tokens('text')} as tk from documents where lang is not null and trim(coalesce(text, '')) <> ''), t as (select label, token, count(*) as n from (select label, unnest(tk) as token from d) group by 1, 2), a as (select label, count(*) as docs from d group by 1), b as (select label, sum(n) as total from t group by 1), v as (select count(distinct token) as voc from t), w as (select sum(docs) as nd, count(*) as l from a), m as (select label, coalesce(total, 0) as total, greatest(docs / nd::double, 1.0::double / l) as prior, voc from a left join b using (label), v, w), q as (select doc_id, {K.tokens('text')} as tk from documents), qc as (select doc_id, token, count(*) as c from (select doc_id, unnest(tk) as token from q) group by 1, 2), g as (select doc_id, label, sum(c * ln(n + 1.0::double)) as gain from qc join t using (token) group by 1, 2), s as (select q.doc_id, len(tk) as len, m.label, round(ln(prior) - len(tk) * ln((total + voc)::double) + coalesce(gain, 0.0::double), 9) as score from q cross join m left join g on g.doc_id = q.doc_id and g.label = m.label), x as (select *, max(score) over (partition by doc_id) as best from s), y as (select *, exp(score - best) / sum(exp(score - best)) over (partition by doc_id) as c, row_number() over (partition by doc_id order by case when len = 0 then 0 else -score end, label) as rn from x) select doc_id, label, round(case when len = 0 then 0.0::double else c end, 2) as confidence from y where rn = 1",
    "applied_reviews": f"with {_APPLIED} select * from ap",
    "unknown_reviews": f"with {_FIND} select distinct finding_id from review_items where finding_id is not null and finding_id not in (select finding_id from fi)",
    "decision_problems": f"with {_FIND}, d as (select finding_id, count(*) as n from review_items where review_status is not null group by 1), f as (select distinct finding_id from fi), j as (select coalesce(d.finding_id, f.finding_id) as finding_id, case when f.finding_id is null then 'unknown_finding' when d.finding_id is null then 'undecided' when n > 1 then 'decided_twice' end as problem from d full join f on d.finding_id = f.finding_id) select * from j where problem is not null",
    "accepted_evidence": f"with {_APPLIED} select load_seq, finding_id, review_state, 'EV-' || left(sha256(finding_id || chr(10) || 'x' || chr(10) || review_state), 12) as evidence_id from ap where review_state in ('accepted', 'reviewed')",
    "shared_references": "with a as (select load_seq as draft_seq, unnest(list_distinct(evidence_refs)) as x from questionnaire_draft), b as (select load_seq as queue_seq, unnest(list_distinct(evidence_refs)) as x from case_review_queue) select draft_seq, queue_seq, count(*) as shared from a join b using (x) group by 1, 2",
    "best_chunks": "with r as (select document_id, load_seq, confidence, row_number() over (partition by document_id order by confidence desc, load_seq)::int as rank from document_chunks) select * from r where rank <= 12",
    "question_controls": f"with {_control_sql()} select * from qc",
    "question_evidence": f"with {_control_sql()}, rq as (select * from {K.values([(c, e) for c, es in REQUIRED for e in es], 'control, required')}) select load_seq, array_to_string(list_sort(list_distinct(list(rq.required))), '|') as required from qc join rq using (control) group by 1",
    "best_answers": f"with {_ANS}, r as (select *, row_number() over (partition by client_id, cluster order by confidence desc, recorded_at desc, answer_id) as n from an where review_status = 'reviewed') select client_id, cluster, answer_id, confidence, valid_until from r where n = 1",
    "answer_drafts": f"with {_ANS}, b as (select * from (select *, row_number() over (partition by cluster order by confidence desc, recorded_at desc, answer_id) as n from an where review_status = 'reviewed') where n = 1), e as (select cluster, max(confidence) as ec from an where review_status = 'draft' group by 1), j as (select q.load_seq, q.proposed_cluster as cluster, b.answer_id, b.confidence as ac, ec, case when answer_id is not null and valid_until < '{AS_OF}' then 'stale' when answer_id is not null and len(coalesce(refs, [])) = 0 then 'answer_without_refs' when answer_id is not null then 'reviewed' when ec >= 0.64::double then 'draft_from_evidence' when ec is not null then 'low_confidence_evidence' else 'nothing_found' end as reason from case_review_queue q left join b on b.cluster = q.proposed_cluster left join e on e.cluster = q.proposed_cluster) select load_seq, cluster, case when reason in ('stale', 'reviewed') then reason when reason in ('draft_from_evidence', 'low_confidence_evidence') then 'needs_review' else 'missing_evidence' end as status, reason, coalesce(answer_id, '') as source_id, coalesce(case when reason in ('stale', 'reviewed') then ac when ec is not null and reason <> 'answer_without_refs' then ec else 0.0::double end, 0.0::double) as confidence from j",
    "missing_evidence": f"with l as (select matched_cluster as cluster, arg_max(review_status, load_seq) as last, count(*) as questions from questionnaire_draft where matched_cluster is not null group by 1), e as (select distinct unnest(detected_topics) as cluster from document_chunks), j as (select v.cluster, case when e.cluster is not null then 'partial' else 'missing' end as status, coalesce(questions, 0) as questions, last from {K.values([(c,) for c in [*CLUSTERS, 'logging']], 'cluster')} v left join l on l.cluster = v.cluster left join e on e.cluster = v.cluster) select cluster, status, questions from j where (last is null or last <> 'reviewed') and (questions > 0 or status = 'missing')",
    "latest_drafts": "with r as (select *, row_number() over (partition by case_id, question_id order by recorded_at desc, load_seq desc) as n, min(recorded_at) over (partition by case_id, question_id) as f from questionnaire_draft) select case_id, question_id, review_status, confidence, epoch_us(f) as first_us, load_seq from r where n = 1",
    "upserted_findings": "with r as (select *, row_number() over (partition by finding_id order by recorded_at desc, load_seq desc) as n from review_items) select finding_id, category, load_seq from r where n = 1",
    "replaced_findings": "select finding_id, load_seq from review_items where recorded_at < '2025-01-01 00:00:00+00'::timestamptz and finding_id in (select finding_id from review_items where recorded_at >= '2025-01-01 00:00:00+00'::timestamptz)",
    "touched_clients": "select c.client_id, greatest('2023-06-01', coalesce(max(strftime(recorded_at at time zone 'UTC', '%Y-%m-%d')), '2023-06-01')) as seen from clients c left join review_items r using (client_id) group by 1",
    "finding_versions": "select finding_id, load_seq, row_number() over w::int as version_no, epoch_us(lead(recorded_at) over w) as valid_to_us, lead(1) over w is null as is_current from review_items window w as (partition by finding_id order by recorded_at, load_seq)",
    "ledger_append": f"with recursive {_EVENTS}, ch as (select user_id, event_id, sequence, sha256(repeat('0', 64) || chr(10) || event_id || chr(10) || event_type || chr(10) || at_us || chr(10) || props) as event_hash from ev where sequence = 1 union all select ev.user_id, ev.event_id, ev.sequence, sha256(ch.event_hash || chr(10) || ev.event_id || chr(10) || ev.event_type || chr(10) || ev.at_us || chr(10) || ev.props) from ch join ev on ev.user_id = ch.user_id and ev.sequence = ch.sequence + 1) select * from ch",
    "ledger_problems": f"with {_EVENTS} select user_id, sequence, 'event_hash' as problem from ev where event_type = 'error' and props <> '{{}}'",
    "ledger_transitions": f"with {_EVENTS}, s as (select *, coalesce(bool_or(event_type = 'view') over w, false) as sv, coalesce(bool_or(event_type = 'signup') over w, false) as ss, coalesce(bool_or(event_type = 'purchase') over w, false) as sp from ev window w as (partition by user_id order by sequence rows between unbounded preceding and 1 preceding)), p as (select user_id, event_id, case when event_type = 'signup' and sequence <> 1 then 'not_first' when event_type = 'purchase' and not sv then 'needs_view' when event_type = 'click' and not ss then 'needs_signup' when event_type = 'signup' and sp then 'after_purchase' end as problem from s) select * from p where problem is not null",
    "ledger_roles": "with e as (select event_id, event_type, case when contains(props, '9') then 'reviewer' else 'operator' end as role from events) select * from e where (event_type = 'signup' and role <> 'operator') or (event_type = 'purchase' and role <> 'reviewer')",
    "ledger_completion": "select user_id, count(*) filter (event_type = 'purchase') as n from events group by 1 having count(*) filter (event_type = 'purchase') <> 1",
    "component_gaps": f"with p as (select load_seq, title as name, case when file_type = 'pdf' then '' else document_version end as version, public_url as purl, license_status, sha256 from manifest), d as (select {K.casefold('coalesce(name, $$$$)')} as a, {K.casefold('coalesce(purl, $$$$)')} as b from p group by 1, 2 having count(*) > 1), q as (select p.*, d.a is not null as dup from p left join d on a = {K.casefold('coalesce(name, $$$$)')} and b = {K.casefold('coalesce(purl, $$$$)')}) select load_seq, unnest(list_filter([case when trim(coalesce(version, '')) = '' then 'missing_version' end, case when license_status is null then 'missing_license' end, case when sha256 is null then 'missing_checksum' end, case when trim(coalesce(purl, '')) = '' then 'unknown_package_id' end, case when dup then 'duplicate_component' end], lambda x: x is not null)) as gap from q",
    "duplicate_components": "with g as (select *, row_number() over (partition by lower(p_brand), lower(p_type), lower(p_name) order by p_partkey)::int as copy_no, count(*) over (partition by lower(p_brand), lower(p_type), lower(p_name)) as copies from part) select p_partkey, copy_no, copies from g where copies > 1",
    "parsed_components": "select load_seq, no, trim(coalesce(title, '')) as name, trim(coalesce(document_version, '')) as version, '' as purl, coalesce(license_status, '') as licenses from manifest, (values (1), (2)) v(no)",
    "repeated_findings": "select finding_id, count(*) as n from review_items group by 1 having count(*) > 1",
    "orphan_cases": "select load_seq, source_id from cases where source_id is not null and source_id not in (select source_id from manifest where source_id is not null and recorded_at < '2025-01-01 00:00:00+00'::timestamptz)",
    "catalog_problems": "with c as (select load_seq, list_filter([case when not coalesce(regexp_matches(sha256, '^[0-9a-f]{64}$'), false) then 'sha' end, case when not coalesce(regexp_matches(public_url, '^https://'), false) then 'url' end, case when not coalesce(file_type in ('pdf', 'json', 'csv', 'txt'), false) then 'kind' end, case when not coalesce(regexp_matches(source_id, '^src-[0-9a-f]{12}$'), false) then 'id' end], lambda x: x is not null) as v from manifest) select load_seq, array_to_string(v, '|') as violations from c where len(v) > 0",
    "register_differences": "with r as (select *, row_number() over (partition by source_id order by recorded_at desc, load_seq desc) as n from manifest), a as (select * from r where n = 1), q as (select *, row_number() over (partition by source_id order by recorded_at desc, load_seq desc) as n from manifest where recorded_at < '2025-01-01 00:00:00+00'::timestamptz), b as (select * from q where n = 1), j as (select coalesce(a.source_id, b.source_id) as source_id, case when b.source_id is null then 'only_left' when a.source_id is null then 'only_right' when a.document_version is distinct from b.document_version or a.license_status is distinct from b.license_status then 'differs' end as problem from a full join b on a.source_id = b.source_id) select * from j where problem is not null",
    "unsafe_paths": "select doc_id, source_path from (select doc_id, case doc_id % 50 when 1 then '../' || source_path when 2 then source_path || '/.env.local' when 3 then '/' || source_path else source_path end as source_path from documents) where source_path is not null and (regexp_matches(source_path, '^(/|\\\\|[A-Za-z]:)') or trim(source_path) = '' or len(list_filter(string_split(replace(source_path, '\\', '/'), '/'), lambda p: p = '..' or regexp_matches(p, '(?i)^(\\.env.*|.*(secret|password|credential|id_rsa|private[_-]?key).*|.*\\.(pem|key|p12|pfx|db|sqlite3?|log))$'))) > 0)",
    "url_checks": "select load_seq, case when not ok then 'FAIL' when not tr then 'FAIL' when file_type = 'csv' then 'WARN' else 'PASS' end as result, case when not ok then 'invalid_url' when not tr then 'not_official' when file_type = 'csv' then 'unreachable' when file_type = 'pdf' then 'redirect' else 'ok' end as reason from (select *, regexp_matches(public_url, '^https://[^\\s/]+(/\\S*)?$') as ok, regexp_matches(lower(regexp_extract(public_url, '^https://([^/:?#]+)', 1)), '\\.example$') as tr from manifest where public_url is not null)",
    "field_classes": f"with f as (select load_seq, 'Website' as name, 'url' as kind, public_url as value from manifest union all select load_seq, 'company_name', 'freeform', publisher from manifest union all select load_seq, 'vat_id', 'identifier', source_id from manifest union all select load_seq, 'dpo_phone', 'phone', sha256 from manifest union all select load_seq, 'title', null, title from manifest), g as (select *, {K.collapse('coalesce(value, $$$$)')} as v from f), h as (select *, case when v = '' then false when kind = 'url' then regexp_matches(v, '(?i)^https?://[^\\s/]+\\.[^\\s]+$') when kind = 'phone' then length(regexp_replace(v, '\\D', '', 'g')) between 7 and 15 when kind = 'identifier' then regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9 ./_-]*$') else true end as ok from g) select load_seq, name, case when kind is null or not ok then 2 else 1 end as field_class, case when kind is null then 'field_not_company_metadata' when not ok then 'declared_field_failed_validation' else 'declared_company_metadata' end as class_reason from h",
    "supplier_scores": "with l as (select l_suppkey, count(*) filter (l_returnflag = 'R') as r, count(*) filter (l_linestatus = 'O') as o, count(*) filter (l_quantity > 49) as g from lineitem group by 1), p as (select s_suppkey, case when s_acctbal < 0 then 60 when s_acctbal < 5000 then 40 else 20 end as b, least(24, coalesce(r, 0) * 8) as pr, least(15, coalesce(o, 0) * 3) as po, least(12, coalesce(g, 0) * 3) as pg from supplier left join l on l_suppkey = s_suppkey), q as (select *, least(100, b + pr + po + pg) as score, (pr > 0)::int + (po > 0)::int + (pg > 0)::int as k from p) select s_suppkey, score, case when k >= 2 then 'corroborated' when k = 1 then 'partial' else 'base_only' end as basis, case when score >= 80 then 'high' when score >= 60 then 'medium' when score >= 35 then 'low' else 'watch' end as level from q",
    "stale_answers": f"with {_ANS} select answer_id, valid_until < '{AS_OF}' as stale, case when confidence is null or confidence < 0 then 'unknown' when confidence >= 0.75::double then 'high' when confidence >= 0.5::double then 'medium' else 'low' end as bucket from an",
    "stable_ids": f"select load_seq, 'F-' || left(sha256(coalesce({K.collapse('lower(category)')}, '') || chr(10) || coalesce(document, '') || chr(10) || coalesce(evidence_level, '')), 8) as stable_id, coalesce(nullif(regexp_replace(regexp_replace(upper(control_area), '[^A-Z0-9_.,()-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'UNMAPPED') as slug, case when length(finding) > 60 then regexp_replace(left(finding, 57), '{K.SPACE}$', '') || '...' else finding end as short, case when regexp_matches(review_note, '^({K.SPACE})?[=+@-]') then '''' || review_note else review_note end as cell from review_items",
    "json_lists": "select load_seq, case when evidence_refs is not null then array_to_string(list_filter(list_transform(evidence_refs, lambda x: trim(x)), lambda x: x <> ''), '|') when missing_evidence is null then null else trim(missing_evidence) end as items from questionnaire_draft",
}
_V = K.collapse("coalesce(reviewed_at, $$$$)")
_AUTH_SQL, _DOTENV_SQL, _PATH_SQL = (K.quote(x) for x in (V._AUTH, V._DOTENV, V._PRIVATE_PATH))
SQL |= {
    "review_times": f"with t as (select {_V} as v from review_items), u as (select v, v = '' or (length(v) = 10 and try_strptime(v, '%Y-%m-%d') is not null) or (regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d{{1,6}})?)?(Z|[+-]\\d{{2}}:\\d{{2}})?') and try_cast(v as timestamptz) is not null) as ok from t) select not ok as error, case when ok then v = '' end as blank, count(*) as n from u group by 1, 2",
    "cleaned_review_notes": f"with {_FIND}, la as (select finding_id, arg_max({{'n': review_note}}, load_seq).n as n from review_items where finding_id is not null group by 1), cl as (select finding_id, {K.collapse('coalesce(n, $$$$)')} as t from la), {K.masked('cl', 'finding_id', 't')}, pr as (select finding_id, regexp_replace(regexp_replace(regexp_replace(note, {_AUTH_SQL}, '[token:redacted]', 'g'), {_DOTENV_SQL}, '[path:redacted]', 'g'), {_PATH_SQL}, '[path:redacted]', 'g') as n from mk) select fi.load_seq, coalesce(case when regexp_matches(n, '^({K.SPACE})?[=+@-]') then chr(39) || n else n end, '') as review_note from fi left join pr using (finding_id)",
    "guarded_notes": f"with kp as (select load_seq, regexp_extract_all(review_note, {K.quote(_KEEP)}, 0) as k, regexp_replace(review_note, {K.quote(_KEEP)}, '\ue001', 'g') as t from review_items where review_note is not null), {K.masked('kp', 'load_seq', 't')}, sp as (select load_seq, k, note as n, string_split(note, '\ue001') as g from mk join kp using (load_seq)) select load_seq, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(k[i], '')), '') as note, array_to_string(list_sort(list_distinct(regexp_extract_all(n, '\\[([a-z_]+):redacted\\]', 1))), '|') as masked from sp",
}
SQL = {k: v.replace("$$$$", "''") for k, v in SQL.items()}
