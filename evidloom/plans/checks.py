"""Queries over single functions, joins with defaults, evaluation, coverage on the default lexicon, and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom import lexicon as L
from evidloom import sinks
from evidloom.functions import patterns as P
from evidloom.functions import text as TX
from evidloom.operators import evaluate as E
from evidloom.operators import extract as X
from evidloom.operators import ledger as G
from evidloom.operators import review as V
from evidloom.operators import rollup as R
from evidloom.operators import scoring as S
from evidloom.plans import duck as K
from evidloom.plans import evidence as EV
from evidloom.plans import pipeline as PL
from evidloom.plans import records as RC
from evidloom.session import scratch, table
from evidloom.sources.udtf import TermFinder

TYPES = ["text", "markdown", "csv", "json", "pdf"]
CLAIM_WORDS = (*L.FORBIDDEN_CLAIMS, r"\bcovered\b")


def private_addresses(spark, sf):
    """Dotted quads made of the events' numbers."""
    first = F.element_at(F.array(*(F.lit(x) for x in (10, 127, 172, 192, 198, 8, 203, 169, 240, 256))), (F.col("event_id") % 10 + 1).cast("int"))
    ip = F.concat_ws(".", first.cast("string"), ((F.col("event_id") * 7) % 260).cast("string"), (F.col("event_id") % 100).cast("string"), F.when(F.col("event_id") % 9 == 0, "01").otherwise((F.col("user_id") % 256).cast("string")))
    return table(spark, sf, "events").select("event_id", ip.alias("ip"), P.private_ip(ip).alias("private"))


def plausible_phones(spark, sf):
    number = F.concat(F.lit("+"), F.repeat(F.lit("12 "), ((F.col("event_id") % 9) + 1).cast("int")), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", P.plausible_phone(number).alias("plausible"))


def span_overlaps(spark, sf):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((100, 200), (900, 1000), (2000, 2001))))
    return table(spark, sf, "document_chunks").select("load_seq", P.overlaps(F.col("start_char"), F.col("end_char"), spans).alias("hit"))


def snippets(spark, sf):
    """The surroundings of five signs of each category."""
    r = table(spark, sf, "review_items").where("category is not null")
    line = F.concat(F.repeat(F.lit("lorem ipsum "), 5), F.lit("AB:CD"), F.repeat(F.lit(" dolor sit"), 5), F.col("category"))
    return r.select("load_seq", P.snippet(line, F.lit(60), F.lit(65), F.lit("email")).alias("snippet"), P.snippet(line, F.lit(5), F.lit(10), F.lit("token"), 36, 30).alias("short"))


def safe_texts(spark, sf):
    m = table(spark, sf, "manifest")
    said = F.concat(F.coalesce("title", F.lit("")), F.lit("  \n password = "), F.coalesce("file_type", F.lit("x")), F.lit(" end"))
    dated = F.concat(F.lit("2024-05-06 token: "), F.coalesce("source_id", F.lit("x")))
    return m.select("load_seq", P.safe_text(said, 200).alias("said"), P.safe_text(dated, 200, keep_date=True).alias("dated"))


def forbidden_claims(spark, sf):
    c = table(spark, sf, "cases")
    said = F.concat_ws(" ", "allowed_statement", F.when(F.col("load_seq") % 3 == 0, "we are NIS-2 compliant").when(F.col("load_seq") % 3 == 1, "ISO 27001 zertifiziert"))
    return c.select("load_seq", E.forbidden_claim(said, list(CLAIM_WORDS)).alias("forbidden"))


def mapped_categories(spark, sf):
    r = table(spark, sf, "review_items")
    known = ["NIS2-SCRM-01", "NIS2-SCRM-02", "NIS2-SCRM-04", "NIS2-SCRM-05"]
    got = E.map_controls(F.array(F.col("category"), F.lit("incident_reporting"), F.lit("secure_development"), F.lit("asset_management"), F.lit("access_control")), L.CATEGORY_CONTROLS, known)
    return r.select("load_seq", F.array_join(got, "|").alias("controls"))


def signals_with_reviews(spark, sf):
    """Every document with the last review of its finding, or defaults."""
    e = RC.findings(spark, sf)
    last = table(spark, sf, "review_items").groupBy("finding_id").agg(F.max_by("evidence_level", F.when(F.col("evidence_level").isNotNull(), F.col("load_seq"))).alias("evidence_level"), F.count("*").alias("reviews"))
    from evidloom.operators.joins import left_with_default

    return left_with_default(e.drop("evidence_id"), last, "finding_id", {"evidence_level": F.lit("none"), "reviews": F.lit(0)})


def with_models(spark, sf):
    m = E.with_model(table(spark, sf, "region"), "bayes", "3")
    return m.select("r_regionkey", "model.name", "model.version", "model.trained_at")


def expected_documents(spark, sf) -> DataFrame:
    """What every tenth document is to have."""
    array = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    d = table(spark, sf, "documents").where("doc_id % 10 < 4")
    odd = F.col("doc_id") % 2 == 1
    return d.select("doc_id", F.when(odd, array("access", "incidents")).otherwise(array("continuity")).alias("categories"), array("assets").alias("forbidden"), F.when(odd, array("REPORTS", "rights")).alias("terms"), F.when(odd, 1).otherwise(2).alias("least"), array("missing_owner", "outdated").alias("gaps"))


def evaluated_documents(spark, sf):
    got = E.evaluate_documents(expected_documents(spark, sf), EV.evidence(spark, sf), "doc_id")
    return got.select("doc_id", *(F.array_join(c, "|").alias(c) for c in ("missing", "forbidden_found", "missing_terms")), "enough", "passed")


def missed_gaps(spark, sf):
    return E.missed_gaps(expected_documents(spark, sf), EV.quality_rows(spark, sf), "doc_id")


def corpus_gate(spark, sf):
    status = table(spark, sf, "documents").select("doc_id", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").otherwise("parsed").alias("status"))
    return E.corpus_gate(E.evaluate_documents(expected_documents(spark, sf), EV.evidence(spark, sf), "doc_id"), status, EV.quality_rows(spark, sf), "doc_id")


def document_summaries(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    got = E.document_summary(d.select("doc_id"), X.chunks(d, "doc_id", "text", with_text=False), EV.chunk_topics(spark, sf), "doc_id")
    return got.select("doc_id", "chunk_count", "evidence_count", F.array_join("topics", "|").alias("topics"))


def type_counters(spark, sf):
    return R.counters(table(spark, sf, "documents"), "source_type", TYPES)


def answer_states(spark, sf):
    """Whether each topic's evidence is enough for an answer."""
    e = table(spark, sf, "evidence_record").select(F.explode("mapped_controls").alias("control"), "review_required", "validity")
    per = e.groupBy("control").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("review_required"), F.lit(False)).alias("r"), F.bool_and(F.coalesce(F.col("validity") == "current", F.lit(False))).alias("c"))
    return per.select("control", S.answer_status(F.col("n"), F.col("r"), F.col("c")).alias("status"))


def evidence_states(spark, sf):
    return table(spark, sf, "evidence_record").select("load_seq", S.evidence_status(F.col("review_status"), F.col("validity")).alias("status"))


def ordered_queue(spark, sf):
    return sinks.numbered(EV.review_queue(spark, sf), "priority", "doc_id").select("position", "doc_id", "priority")


def ordered_severity(spark, sf):
    return sinks.numbered(EV.severity(spark, sf).select("doc_id", "priority", "confidence"), "priority", F.desc("confidence"), "doc_id")


def answer_library(spark, sf):
    """Answers in the order of an export."""
    a = RC.answers(spark, sf).select("cluster", "review_status", "answer_id")
    return sinks.numbered(a, "cluster", F.asc_nulls_first("review_status"), "answer_id")


def listed_findings(spark, sf):
    """The first two findings of each note."""
    notes = table(spark, sf, "review_items").select("load_seq", F.concat_ws("\n", F.lit("a@b.example"), F.lit("password = x1"), F.lit("host.lan"), F.col("category")).alias("note"))
    return P.listed(P.scan_lines(notes, "load_seq", "note"), "load_seq", 2).select("load_seq", "line", "type")


def review_rows_export(spark, sf):
    """The 13 columns of a review file from the evidence."""
    rows = EV.quality_rows(spark, sf).select("doc_id", "category", "quality", "citation", "pos")
    return sinks.review_export(rows, "doc_id").select("finding_id", "category", "document", "status", "source_reference", "review_status")


def default_evidence(spark, sf) -> DataFrame:
    """Evidence on the default lexicon, in texts of which some carry its words."""
    words = [w for ws in L.CATEGORY_KEYWORDS.values() for w in ws]
    said = F.element_at(F.array(*(F.lit(w) for w in words)), (F.col("doc_id") % len(words) + 1).cast("int"))
    tail = F.when(F.col("doc_id") % 3 == 0, " is documented, approved, tested, owner CISO, reviewed monthly, export and log within 24h").when(F.col("doc_id") % 3 == 1, " is planned only").otherwise(" exists")
    d = EV.docs(spark, sf).select("doc_id", F.concat(F.lit("The "), said, tail).alias("text"))
    e = S.passage_scores(X.evidence_rows(d, "doc_id", "text", L.CATEGORY_KEYWORDS), "passage")
    return S.quality(e.withColumn("citation", TX.head_and_tail(F.col("passage"))))


def default_coverage(spark, sf):
    """The ten topics over the twelve categories."""
    bridge = spark.createDataFrame([(c, k) for c, ks in L.CONTROL_CATEGORIES.items() for k in ks], "control string, category string")
    return R.coverage(default_evidence(spark, sf), bridge, "doc_id")


def review_problems(spark, sf):
    """What a strict review would refuse."""
    return V.review_problems(table(spark, sf, "review_items"), RC.findings(spark, sf))


def continued_ledger(spark, sf):
    """A ledger of the first half of the events, validated and continued with the other half."""
    e = RC.events(spark, sf)
    parts = ["event_id", "event_type", "at", "props"]
    middle = F.lit(1_700_000_000_000_000)
    old = G.append_chain(e.where(F.col("at") < middle), ["user_id"], parts, ["at", "event_id"])
    new = G.append_validated(old, e.where(F.col("at") >= middle), ["user_id"], parts, ["at", "event_id"])
    return old.unionByName(new).select("user_id", "event_id", "sequence", "event_hash")


def locator_problems(spark, sf):
    """Stored chunks with pages and tables claimed here and there."""
    c = table(spark, sf, "document_chunks").select("load_seq", F.trim("document_id").alias("document_id"), "start_char", "end_char", F.lower("snippet_hash").alias("h"), "chunk_index")
    d = EV.table(spark, sf, "documents").select("document_id", "source_type", TX.collapse(F.col("text")).alias("t"))
    n = F.col("load_seq") % 4
    quote = F.substring(F.col("t"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    problem = X.locator_problem(F.col("t"), F.col("start_char"), F.col("end_char"), quote, F.col("h"), F.col("source_type"), F.when(n == 0, 3), F.when(n < 2, 3), F.when(n == 2, 1))
    return c.join(d, "document_id").select("load_seq", problem.alias("problem"))


def plugged_terms(spark, sf):
    """Terms found by a plug-in over whole texts: places, and a summary of each task's terms."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    terms = "backup copies|incident reports"
    hits = d.lateralJoin(TermFinder(F.col("doc_id").cast("string").outer(), F.col("text").outer(), F.lit(0), F.lit(terms)))
    return hits.where("pos >= 0").select("doc_id", "pos", "term")


def _product(spark, sf):
    """The manifest as a folder of documents, and a question for each topic."""
    where = scratch(spark, "product")
    firsts = [a[0] for a in L.TOPIC_ALIASES.values()]
    said = F.element_at(F.array(*(F.lit(a) for a in firsts[:15])), (F.col("load_seq") % 15 + 1).cast("int"))
    rows = table(spark, sf, "manifest").select(F.concat(F.col("load_seq").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("The "), said, F.when(F.col("load_seq") % 2 == 0, " is documented, tested and approved by the owner.").otherwise(" exists.")).alias("content"))
    sinks.write_files(rows, f"{where}/docs")
    asked = spark.createDataFrame([(f"q{i:02d}", f"How is {a} handled?") for i, a in enumerate(firsts)], "question_id string, question string")
    sinks.write_csv(asked, f"{where}/questions", single=True)
    return where, PL.run_product(spark, f"{where}/docs", f"{where}/questions", RC.answers(spark, sf), RC.AS_OF)


def product_drafts(spark, sf):
    """Drafts of a questionnaire from a folder of documents and the baseline of answers."""
    return _product(spark, sf)[1].drafts.select("question_id", "cluster", "status", "reason", "source_id", "confidence")


def product_readiness(spark, sf):
    return PL.readiness(_product(spark, sf)[1])


def workspace_files(spark, sf):
    """A workspace before and after a purge of one of its two folders."""
    where = scratch(spark, "workspace")
    rows = table(spark, sf, "clients").select(F.concat("client_id", F.lit(".txt")).alias("name"), "sector")
    for folder in ("keep", "drop"):
        sinks.write_files(rows, f"{where}/{folder}", content="sector")
    before = PL.inspect(spark, where).count()
    named = PL.purge(spark, where, ["drop", "none"])
    PL.purge(spark, where, ["drop", "none"], really=True)
    return spark.createDataFrame([("before", before), ("after", PL.inspect(spark, where).count()), ("named", len(named))], "what string, n long")


def sensitive_notes(spark, sf):
    """Which detectors see something in a note."""
    notes = table(spark, sf, "review_items").where("review_note is not null").select("load_seq", "review_note")
    kinds = P.scan_lines(notes, "load_seq", "review_note").groupBy("load_seq").agg(F.collect_set("type").alias("k"))
    joined = notes.join(kinds, "load_seq", "left").withColumn("k", F.coalesce("k", F.array().cast("array<string>")))
    return joined.select("load_seq", *(F.array_contains("k", F.lit(k)).alias(k) for k in ("email", "iban", "secret", "token", "keyword")), P.has_sensitive(F.col("review_note")).alias("sensitive"))


QUERIES = {
    f.__name__: f
    for f in (
        private_addresses, plausible_phones, span_overlaps, snippets, safe_texts, forbidden_claims, mapped_categories, signals_with_reviews, with_models, evaluated_documents, missed_gaps, corpus_gate, document_summaries, type_counters,
        answer_states, evidence_states, ordered_queue, ordered_severity, answer_library, listed_findings, review_rows_export, default_coverage, review_problems, continued_ledger, locator_problems, plugged_terms, sensitive_notes, product_drafts, product_readiness, workspace_files,
    )
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_IP = "ip as (select event_id, (([10, 127, 172, 192, 198, 8, 203, 169, 240, 256])[event_id % 10 + 1])::varchar || '.' || (event_id * 7) % 260 || '.' || event_id % 100 || '.' || case when event_id % 9 = 0 then '01' else (user_id % 256)::varchar end as ip from events)"
_BLOCKS = " or ".join(f"x between {(lo := sum(int(o) << (24 - 8 * k) for k, o in enumerate(a.split('.'))))} and {lo + (1 << (32 - n)) - 1}" for a, n in P._PRIVATE_BLOCKS)
_ODD = "doc_id % 2 = 1"
_WORDS = [w for ws in L.CATEGORY_KEYWORDS.values() for w in ws]
_CATEGORY = {w.strip().lower(): c for c, ws in L.CATEGORY_KEYWORDS.items() for w in ws}
_SAID = "'The ' || w || case doc_id % 3 when 0 then ' is documented, approved, tested, owner CISO, reviewed monthly, export and log within 24h' when 1 then ' is planned only' else ' exists' end"
_DEFAULT = (
    f"dd as (select doc_id, w as keyword, category, {_SAID} as passage from (select doc_id, ([{', '.join(K.quote(w) for w in _WORDS)}])[doc_id % {len(_WORDS)} + 1] as w, ([{', '.join(K.quote(_CATEGORY[w.lower()]) for w in _WORDS)}])[doc_id % {len(_WORDS)} + 1] as category from documents)),"
    f" ds as (select *, lower(passage) as low, {K.hits('lower(passage)', L.BOOST_TERMS)} as b, {K.hits('lower(passage)', L.PENALTY_TERMS)} as p, {K.hits('lower(passage)', L.CRITICAL_TERMS)} as c from dd),"
    f" df as (select *, least(greatest(0.5::double + least(0.2::double, 0.05::double * b) - least(0.3::double, 0.1::double * p), 0), 1) as score, {EV._features('category', 'low')} as features, {EV._signals('category', 'low')} as base from ds),"
    f" dq as (select *, case when not (score >= 0.7::double and c = 0) or list_has_any(base, [{', '.join(K.quote(h) for h in L.HARD_SIGNALS)}]) then 'warning' when score >= 0.7::double and len(features) >= 3 then 'strong' when score >= 0.65::double and len(features) >= 2 then 'medium' else 'weak' end as quality from df)"
)
_EXPECTED = f"ex as (select doc_id, case when {_ODD} then ['access', 'incidents'] else ['continuity'] end as cats, case when {_ODD} then ['REPORTS', 'rights'] else [] end as terms, case when {_ODD} then 1 else 2 end as least from documents where doc_id % 10 < 4)"
_EVALUATED = (
    f"{EV._EV}, {_EXPECTED}, pe as (select doc_id, list(distinct category) as cats, count(*) as n, string_agg(lower(passage), chr(10)) as t from ev where passage <> '' group by 1),"
    " ed as (select ex.doc_id, ex.cats as wanted, list_sort(list_filter(ex.cats, lambda x: not coalesce(list_contains(pe.cats, x), false))) as missing, case when coalesce(list_contains(pe.cats, 'assets'), false) then ['assets'] else [] end as forbidden,"
    " list_sort(list_filter(terms, lambda x: not contains(coalesce(t, ''), lower(x)))) as missing_terms, coalesce(n, 0) >= least as enough from ex left join pe using (doc_id))"
)
_PHONE_FREE = "load_seq, review_note"
_KEYS = "api[_-]?key|authorization|cookie|password|passwd|refresh[_-]?token|secret|token|access[_-]?token"
_SECRET_SQL = rf"(?i)\b({_KEYS})\b\s*[:=]\s*([''\"]?[^\s''\"`]+[''\"]?)"
_FIRSTS = [a[0] for a in L.TOPIC_ALIASES.values()]
_ALIASES = K.values([(t, S.fold_term(a)) for t, aliases in L.TOPIC_ALIASES.items() for a in aliases], "topic, folded")
_PRODUCT = (
    f"{RC._ANS}, pd as (select load_seq as doc_id, 'The ' || ([{', '.join(K.quote(a) for a in _FIRSTS[:15])}])[load_seq % 15 + 1] || case load_seq % 2 when 0 then ' is documented, tested and approved by the owner.' else ' exists.' end as text from manifest),"
    f" {EV._topics(L.TOPIC_ALIASES).replace('from documents', 'from pd')}, e as (select cluster, max(confidence) as ec from (select unnest(topics) as cluster, confidence from te) group by 1),"
    f" q as (select question_id, coalesce(min(topic), 'other') as cluster from {K.values([(f'q{i:02d}', S.fold_term(f'How is {a} handled?')) for i, a in enumerate(_FIRSTS)], 'question_id, f')} left join {_ALIASES} k on contains(f, folded) group by 1),"
    " b as (select * from (select *, row_number() over (partition by cluster order by confidence desc, recorded_at desc, answer_id) as n from an where review_status = 'reviewed') where n = 1),"
    f" j as (select q.*, b.answer_id, b.confidence as ac, ec, case when answer_id is not null and valid_until < '{RC.AS_OF}' then 'stale' when answer_id is not null and len(coalesce(refs, [])) = 0 then 'answer_without_refs' when answer_id is not null then 'reviewed' when ec >= 0.64::double then 'draft_from_evidence' when ec is not null then 'low_confidence_evidence' else 'nothing_found' end as reason from q left join b using (cluster) left join e using (cluster))"
)
_CHECKS = "preflight_not_blocking document_inventory_created all_files_statused unsupported_files_do_not_crash evidence_ids_unique answer_vault_created baseline_answers_imported questionnaire_draft_created human_review_queue_created missing_evidence_report_created shareable_outputs_redacted no_compliance_overclaim all".split()

SQL = {
    "product_drafts": f"with {_PRODUCT} select question_id, cluster, case when reason in ('stale', 'reviewed') then reason when reason in ('draft_from_evidence', 'low_confidence_evidence') then 'needs_review' else 'missing_evidence' end as status, reason, coalesce(answer_id, '') as source_id, coalesce(case when reason in ('stale', 'reviewed') then ac when ec is not null and reason <> 'answer_without_refs' then ec else 0.0::double end, 0.0::double) as confidence from j",
    "product_readiness": f"with a as (select count(*) > 0 as has, count(*) filter (review_status = 'reviewed' and matched_cluster is not null) > 0 as reviewed from questionnaire_draft where matched_cluster is not null), m as (select count(*) > 0 as docs from manifest), v as (select unnest([{', '.join(K.quote(c) for c in _CHECKS)}]) as \"check\", unnest([true, docs, true, true, true, has, reviewed, true, true, true, true, true, docs and has and reviewed]) as ok from a, m) select * from v",
    "workspace_files": "select 'before' as what, 2 * count(*) as n from clients union all select 'after', count(*) from clients union all select 'named', 1",
    "sensitive_notes": f"with {EV._FOUND}, s as (select load_seq, list(distinct type) as k from fi group by 1) select r.load_seq, " + ", ".join(f"coalesce(list_contains(k, {K.quote(t)}), false) as {t}" for t in ("email", "iban", "secret", "token", "keyword")) + ", k is not null as sensitive from review_items r left join s using (load_seq) where review_note is not null",
    "private_addresses": f"with {_IP}, p as (select *, string_split(ip, '.') as o from ip), q as (select *, len(list_filter(o, lambda v: regexp_matches(v, '^(0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])$'))) = 4 as valid, o[1]::bigint * 16777216 + o[2]::bigint * 65536 + o[3]::bigint * 256 + o[4]::bigint as x from p) select event_id, ip, valid and ({_BLOCKS}) and ip not in ('192.0.0.9', '192.0.0.10') as private from q",
    "plausible_phones": "select event_id, (2 * (event_id % 9 + 1) + length(user_id::varchar)) between 7 and 15 as plausible from events",
    "span_overlaps": "select load_seq, (start_char < 200 and end_char > 100) or (start_char < 1000 and end_char > 900) or (start_char < 2001 and end_char > 2000) as hit from document_chunks",
    "snippets": "with s as (select load_seq, substr(repeat('lorem ipsum ', 5), 25, 36) || '[email:redacted]' || left(repeat(' dolor sit', 5) || category, 36) as a, 'lorem[token:redacted]' || substr(repeat('lorem ipsum ', 5) || 'AB:CD', 11, 36) as b from review_items where category is not null) select load_seq, a as snippet, left(b, 27) || '...' as short from s",
    "safe_texts": f"select load_seq, {K.collapse('coalesce(title, $$$$)')} || case when {K.collapse('coalesce(title, $$$$)')} = '' then '' else ' ' end || 'password=[secret:redacted] end' as said, '2024-05-06 token=[token:redacted]' as dated from manifest".replace("$$$$", "''"),
    "forbidden_claims": r"select load_seq, load_seq % 3 < 2 or coalesce(regexp_matches(allowed_statement, '(?i)\bnis\s*-?\s*2\s*(compliant|konform)\b|\biso\s*(27001\s*)?(certified|zertifiziert)\b|\bcovered\b'), false) as forbidden from cases",
    "mapped_categories": "select load_seq, array_to_string(case category when 'supplier_security' then ['NIS2-SCRM-01', 'NIS2-SCRM-02', 'NIS2-SCRM-05'] when 'business_continuity' then ['NIS2-SCRM-04', 'NIS2-SCRM-02', 'NIS2-SCRM-05'] when 'access_control' then ['NIS2-SCRM-05', 'NIS2-SCRM-02'] when 'asset_management' then ['NIS2-SCRM-05', 'NIS2-SCRM-02'] when 'secure_auth_communications' then ['NIS2-SCRM-05', 'NIS2-SCRM-02'] else ['NIS2-SCRM-02', 'NIS2-SCRM-05'] end, '|') as controls from review_items",
    "signals_with_reviews": f"with {RC._FIND}, la as (select finding_id, arg_max(evidence_level, load_seq) filter (evidence_level is not null) as evidence_level, count(*) as reviews from review_items group by 1) select fi.load_seq, finding_id, coalesce(evidence_level, 'none') as evidence_level, coalesce(reviews, 0) as reviews from fi left join la using (finding_id)",
    "with_models": "select r_regionkey, 'bayes' as name, '3' as version, '1970-01-01T00:00:00Z' as trained_at from region",
    "evaluated_documents": f"with {_EVALUATED} select doc_id, array_to_string(missing, '|') as missing, array_to_string(forbidden, '|') as forbidden_found, array_to_string(missing_terms, '|') as missing_terms, enough, len(missing) = 0 and len(forbidden) = 0 and len(missing_terms) = 0 and enough as passed from ed",
    "missed_gaps": f"with {EV._QUALITY}, sg as (select distinct doc_id, unnest(signals) as gap from q2) select doc_id, gap from (select doc_id, unnest(['missing_owner', 'outdated']) as gap from documents where doc_id % 10 < 4) where (doc_id, gap) not in (select doc_id, gap from sg)",
    "corpus_gate": f"with {_EVALUATED}, c as (select round(sum(len(wanted) - len(missing))::double / sum(len(wanted)), 4) >= 0.8 as hit_rate, bool_and(len(missing) = 0 and len(forbidden) = 0 and len(missing_terms) = 0 and enough) as passed, count(*) filter (len(forbidden) > 0) = 0 as forb from ed), g as (select unnest(['hit_rate', 'passed', 'forbidden', 'parser_failures', 'processed', 'marketing', 'all']) as \"check\", unnest([hit_rate, passed, forb, true, true, true, hit_rate and passed and forb]) as ok from c) select * from g",
    "document_summaries": f"with {EV._TE}, c as (select doc_id, count(*) as n from chunks where chunk_text <> '' group by 1), e as (select doc_id, count(*) as n, list_sort(list_distinct(flatten(list(topics)))) as ts from te group by 1) select d.doc_id, coalesce(c.n, 0) as chunk_count, coalesce(e.n, 0) as evidence_count, coalesce(array_to_string(ts, '|'), '') as topics from documents d left join c using (doc_id) left join e using (doc_id)",
    "type_counters": f"select v.value, count(d.doc_id) as n from {K.values([(t,) for t in [*TYPES, 'other']], 'value')} v left join (select doc_id, case when source_type in ({', '.join(K.quote(t) for t in TYPES)}) then source_type else 'other' end as value from documents) d using (value) group by 1",
    "answer_states": "select control, case when coalesce(bool_or(review_required), false) or not bool_and(coalesce(validity = 'current', false)) then 'draft_review_required' else 'draft_ready' end as status from (select unnest(mapped_controls) as control, review_required, validity from evidence_record) group by 1",
    "evidence_states": "select load_seq, case when not coalesce(validity = 'current', false) then 'needs_review' when lower(review_status) in ('accepted', 'reviewed') then lower(review_status) when lower(review_status) in ('rejected', 'false_positive') then 'rejected' when lower(review_status) = 'needs_evidence' then 'needs_evidence' when lower(review_status) in ('not_applicable', 'not_assessed') then 'not_assessed' else 'needs_review' end as status from evidence_record",
    "ordered_queue": f"with rq as ({EV.SQL['review_queue']}) select row_number() over (order by priority, doc_id) as position, doc_id, priority from rq",
    "ordered_severity": f"with {EV._SEV} select row_number() over (order by priority, confidence desc, doc_id) as position, doc_id, priority, confidence from sw",
    "answer_library": f"with {RC._ANS} select row_number() over (order by cluster, review_status nulls first, answer_id) as position, cluster, review_status, answer_id from an",
    "listed_findings": "select load_seq, 2 as line, 'secret' as type from review_items union all select load_seq, 1, 'email' from review_items",
    "review_rows_export": f"with {EV._QUALITY} select 'F-' || left(sha256(doc_id || chr(10) || category || chr(10) || pos), 12) as finding_id, upper(left(category, 1)) || substr(replace(category, '_', ' '), 2) as category, doc_id::varchar as document, case quality when 'strong' then 'reviewed' when 'warning' then 'needs_evidence' else 'needs_review' end as status, doc_id || ':' || pos as source_reference, 'open' as review_status from q2",
    "default_coverage": f"with {_DEFAULT}, cv as (select control, count(dq.doc_id) as evidence_count, count(distinct case when quality = 'strong' then doc_id end) as strong_documents from {K.values([(c, k) for c, ks in L.CONTROL_CATEGORIES.items() for k in ks], 'control, category')} b left join dq using (category) group by 1) select *, case when strong_documents > 0 then 'strong' when evidence_count > 0 then 'review' else 'missing' end as status from cv",
    "review_problems": f"with {RC._FIND}, r as (select coalesce({K.strip('finding_id')}, '') as finding_id, {RC._TYPED} <> '' and {RC._TYPED} not in ({', '.join(K.quote(s) for s in V.STATES)}) as u from review_items), p as (select finding_id, count(*) as n, count(*) filter (u) as bad from r group by 1) select finding_id, 'missing_id' as problem, n from p where finding_id = '' union all select finding_id, 'repeated_id', n from p where finding_id <> '' and n > 1 union all select finding_id, 'unknown_state', bad from p where bad > 0 union all select finding_id, 'unknown_finding', n from p where finding_id <> '' and finding_id not in (select finding_id from fi)".replace("$$$$", "''"),
    "continued_ledger": RC.SQL["ledger_append"],
    "locator_problems": f"with j as (select c.load_seq, c.load_seq % 4 as n, t, start_char as s, end_char as e, lower(snippet_hash) as h, source_type from document_chunks c join (select document_id, source_type, {K.collapse('text')} as t from documents) d on d.document_id = trim(c.document_id)) select load_seq, case when not coalesce(s >= 0 and e > s and e <= length(t) and length(substr(t, s + 1, e - s)) > 0, false) then 'span' when n = 0 and source_type is distinct from 'pdf' then 'page' when n = 1 and coalesce(source_type = 'pdf', false) then 'page' when n = 2 and not coalesce(source_type in ('csv', 'xlsx'), false) then 'table' when sha256(substr(t, s + 1, e - s)) is distinct from h then 'hash' end as problem from j",
    "plugged_terms": f"with hits as ({K.keyword_hits({'a': ('backup copies', 'incident reports')})}) select doc_id, pos, lower(keyword) as term from hits",
}
