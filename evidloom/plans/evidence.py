"""Queries over documents: text, keywords, chunks, scores, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom import lexicon as L
from evidloom.functions import patterns as P
from evidloom.functions import text as TX
from evidloom.operators import extract as X
from evidloom.operators import rollup as R
from evidloom.operators import scoring as S
from evidloom.plans import duck as K
from evidloom.session import spread, table

CATEGORIES = list(L.CORPUS_CATEGORIES)
#: Which categories count for which control, m to n.
BRIDGE = [("c1", "access"), ("c2", "continuity"), ("c2", "incidents"), ("c3", "suppliers"), ("c4", "changes"), ("c4", "assets"), ("c5", "access"), ("c5", "none")]
#: Topics with words that the corpus uses.
TOPICS = {
    "access": ("access rights", "remote-logins", "admin accounts", "zugriffsrechte"),
    "backup": ("backup copies", "restore exercises", "sicherungskopien"),
    "incident": ("incident reports", "störungsmeldungen"),
    "supplier": ("supplier contracts", "vendor audits", "lieferantenverträge"),
    "patch": ("patch windows", "change requests", "wartungsfenster"),
    "logging": ("log retention", "protokolldaten"),
    "continuity": ("continuity plans", "notfallpläne"),
    "policy": ("policy editor", "risk registers", "risikolisten"),
}


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "document_id", "lang", "text"))


def text_sizes(spark, sf):
    d = docs(spark, sf)
    flat = TX.collapse(F.col("text"))
    tok = TX.tokens(F.col("text"))
    return d.select("doc_id", F.coalesce(F.char_length(flat), F.lit(0)).alias("n_chars"), F.size(tok).alias("n_tokens"), F.left(F.sha2(TX.for_match(F.col("text")), 256), F.lit(12)).alias("match_hash"))


def normalized_texts(spark, sf):
    d = TX.normalize_text(docs(spark, sf), "text")
    return d.select("doc_id", F.sha2("text", 256).alias("text_hash"))


def document_frequency(spark, sf):
    from evidloom.operators.search import document_frequency

    return document_frequency(docs(spark, sf), "doc_id", "text").select("term", "df", "cf")


def keyword_positions(spark, sf):
    words = [w for ws in L.CORPUS_CATEGORIES.values() for w in ws]
    return X.keyword_hits(docs(spark, sf), "doc_id", "text", words)


def evidence(spark, sf) -> DataFrame:
    return X.evidence_rows(docs(spark, sf), "doc_id", "text", L.CORPUS_CATEGORIES)


def evidence_rows(spark, sf):
    e = X.dedupe_evidence(evidence(spark, sf), "doc_id")
    return e.select("doc_id", "pos", "category", "evidence_no", TX.head_and_tail(F.col("passage"), 160).alias("citation"))


def text_windows(spark, sf):
    w = X.windows(docs(spark, sf), "doc_id", "text", 2048, 100, 512)
    return w.select("doc_id", "window_index", "start", "end", "core_end", "is_tail")


def windowed_hits(spark, sf):
    """Hits counted by the window that owns them: as many as without windows."""
    w = X.windows(docs(spark, sf), "doc_id", "text", 2048, 100, 512)
    return X.owned(keyword_positions(spark, sf), w, "doc_id").groupBy("doc_id", "window_index").agg(F.count("*").alias("n"))


def text_chunks(spark, sf):
    return X.chunks(docs(spark, sf), "doc_id", "text", with_text=False)


def chunk_locators(spark, sf):
    """Stored chunks whose hash is that of the text at their offsets."""
    c = table(spark, sf, "document_chunks").select("load_seq", F.trim("document_id").alias("document_id"), "start_char", "end_char", F.lower("snippet_hash").alias("h"))
    flat = docs(spark, sf).select("document_id", TX.collapse(F.col("text")).alias("t"))
    piece = F.trim(F.substring(F.col("t"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
    return c.join(flat, "document_id").select("load_seq", F.coalesce(F.sha2(piece, 256) == F.col("h"), F.lit(False)).alias("ok"))


def scored(spark, sf) -> DataFrame:
    return S.passage_scores(evidence(spark, sf), "passage", L.CORPUS_BOOST, L.CORPUS_PENALTY, L.CORPUS_CRITICAL)


def passage_scores(spark, sf):
    return scored(spark, sf).select("doc_id", "pos", "boost_hits", "penalty_hits", "critical_hits", F.round("score", 4).alias("score"), "positive")


def keyword_confidence(spark, sf):
    e = evidence(spark, sf)
    return e.select("doc_id", "pos", F.round(S.keyword_confidence(F.col("passage"), F.col("keyword"), L.CORPUS_BOOST, L.CORPUS_PENALTY), 4).alias("confidence"))


def quality_rows(spark, sf) -> DataFrame:
    e = scored(spark, sf).withColumn("citation", TX.head_and_tail(F.col("passage"))).withColumn("positive", F.col("critical_hits") == 0)
    return S.quality(e, strong=(0.55, 3), medium=(0.5, 2))


def evidence_quality(spark, sf):
    return quality_rows(spark, sf).select("doc_id", "pos", "category", F.array_join("features", "|").alias("features"), F.array_join("signals", "|").alias("signals"), "quality")


def quality_counts(spark, sf):
    return R.quality_counts(quality_rows(spark, sf), "doc_id", ["strong", "medium", "weak", "warning"])


def category_rollup(spark, sf):
    return R.category_counts(evidence(spark, sf), "doc_id", [*CATEGORIES, "none"])


def coverage_matrix(spark, sf):
    bridge = spark.createDataFrame(BRIDGE, "control string, category string")
    return R.coverage(quality_rows(spark, sf), bridge, "doc_id")


def chunk_topics(spark, sf) -> DataFrame:
    return S.chunk_scores(X.chunks(docs(spark, sf), "doc_id", "text"), topics=TOPICS)


def topic_chunks(spark, sf):
    return chunk_topics(spark, sf).select("doc_id", "chunk_index", F.array_join("topics", "|").alias("topics"), "n_terms", "confidence", "status")


def topic_coverage(spark, sf):
    return R.topic_coverage(chunk_topics(spark, sf), [*TOPICS, "encryption"])


def default_topics(spark, sf):
    """The default lexicon over the corpus."""
    rows = S.chunk_scores(X.chunks(docs(spark, sf), "doc_id", "text"))
    return rows.select("doc_id", "chunk_index", F.array_join("topics", "|").alias("topics"), "n_terms", "confidence", "status")


def top_topics(spark, sf):
    each = chunk_topics(spark, sf).select("doc_id", "chunk_index", F.explode("topics").alias("topic"))
    return R.top_values(each, "doc_id", "topic", "chunk_index", 5)


def topic_metrics(spark, sf):
    """Topics noted in the stored chunks against those found in the texts."""
    d = docs(spark, sf)
    expected = table(spark, sf, "document_chunks").select(F.trim("document_id").alias("document_id"), F.explode("detected_topics").alias("topic"))
    found = chunk_topics(spark, sf).select("doc_id", F.explode("topics").alias("topic")).join(d.select("doc_id", "document_id"), "doc_id")
    return R.set_metrics(expected, found, ["document_id", "topic"])


def topic_label_metrics(spark, sf):
    d = docs(spark, sf)
    expected = table(spark, sf, "document_chunks").groupBy(F.trim("document_id").alias("document_id")).agg(F.array_distinct(F.flatten(F.collect_list("detected_topics"))).alias("e"))
    found = chunk_topics(spark, sf).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("p")).join(d.select("doc_id", "document_id"), "doc_id")
    both = expected.join(found, "document_id", "left").select("e", F.coalesce("p", F.array().cast("array<string>")).alias("p"))
    return R.label_metrics(both, "document_id", "e", "p", list(TOPICS))


def candidates(spark, sf):
    """Candidates from chunks: how sure, by concrete, stale and conflicting terms; any negative term rules one out."""
    c = TX.bind(X.chunks(docs(spark, sf), "doc_id", "text"), "flat", TX.for_match(F.col("chunk_text")))
    from evidloom.functions.terms import any_hit, count_hits

    kept = c.where(~any_hit(F.col("flat"), L.NEGATIVE_TERMS))
    got = S.candidate_category(count_hits(F.col("flat"), L.CONCRETE_TERMS), count_hits(F.col("flat"), L.STALE_TERMS), count_hits(F.col("flat"), L.CONFLICT_TERMS))
    return kept.withColumn("g", got).groupBy("g.status", "g.confidence").agg(F.count("*").alias("n"))


def item_features(spark, sf):
    return S.item_features(docs(spark, sf), "doc_id", "text")


def weak_labels(spark, sf):
    return S.weak_labels(docs(spark, sf), "doc_id", "text").select("doc_id", F.array_join("labels", "|").alias("labels"), "conflict", "confidence")


def severity(spark, sf) -> DataFrame:
    return S.ranked(S.item_features(docs(spark, sf), "doc_id", "text"), S.severity_rules())


def severity_rank(spark, sf):
    return severity(spark, sf).select("doc_id", "points", F.array_join("reasons", "|").alias("reasons"), "priority", "confidence")


def control_suggestions(spark, sf):
    return S.suggest(docs(spark, sf), "doc_id", "text")


def merged_signals(spark, sf):
    """Suggestions and priorities of a document in one row."""
    a = control_suggestions(spark, sf).select("doc_id", F.lit(1).alias("o"), "control", "confidence", F.concat(F.lit("control:"), "status").alias("reason"))
    b = severity(spark, sf).select("doc_id", F.lit(2).alias("o"), F.lit(None).cast("string").alias("control"), "confidence", F.explode("reasons").alias("reason"))
    rows = a.unionByName(b).withColumn("ord", F.struct("o", "control"))
    return R.merge_signals(rows, "doc_id")


def review_queue(spark, sf):
    """All reasons from one scan of the texts."""
    features = S.item_features(docs(spark, sf), "doc_id", "text", keep=("text",))
    ranked = S.ranked(features, S.severity_rules()).select("doc_id", "text", "priority", "reasons")
    both = S.weak_labels(ranked, "doc_id", "text", keep=("priority", "reasons"))
    said = F.when(F.col("priority") != "P3", F.transform("reasons", lambda r: F.struct(F.col("priority"), r.alias("reason"))))
    named = F.array(
        F.when(F.col("conflict"), F.struct(F.lit("P1").alias("priority"), F.lit("weak_label_conflict").alias("reason"))),
        F.when(F.size("labels") == 0, F.struct(F.lit("P3").alias("priority"), F.lit("no_label").alias("reason"))),
    )
    stream = both.select("doc_id", F.inline(F.concat(F.coalesce(said, F.array().cast("array<struct<priority:string,reason:string>>")), F.array_compact(named))))
    return R.review_queue([stream], "doc_id", table(spark, sf, "documents").where("lang = 'fr'").select("doc_id"))


def sensitive_flags(spark, sf):
    d = docs(spark, sf).where("text is not null")
    return d.select("doc_id", *(F.col("text").rlike(p).alias(n) for n, p in (("email", P.EMAIL), ("host", P.HOST), ("token", P.TOKEN_VALUE), ("keyword", P.KEYWORD), ("ipv4", P.IPV4))))


def note_findings(spark, sf):
    """Findings of all detectors in the notes, by type."""
    notes = table(spark, sf, "review_items").select("load_seq", "review_note")
    return P.scan_lines(notes, "load_seq", "review_note").groupBy("type", "severity").agg(F.count("*").alias("n"), F.countDistinct("load_seq").alias("rows"))


def note_verdicts(spark, sf):
    notes = table(spark, sf, "review_items").select("load_seq", "review_note")
    return P.verdicts(P.scan_lines(notes, "load_seq", "review_note"), notes, "load_seq", strict=True)


def masked_notes(spark, sf):
    notes = table(spark, sf, "review_items").where("review_note is not null")
    return notes.select("load_seq", P.mask(F.col("review_note")).alias("note"), P.has_sensitive(F.col("review_note")).alias("sensitive"))


QUERIES = {
    f.__name__: f
    for f in (
        text_sizes, normalized_texts, document_frequency, keyword_positions, evidence_rows, text_windows, windowed_hits, text_chunks, chunk_locators, passage_scores, keyword_confidence, evidence_quality, quality_counts,
        category_rollup, coverage_matrix, topic_chunks, topic_coverage, default_topics, top_topics, topic_metrics, topic_label_metrics, candidates, item_features, weak_labels, severity_rank, control_suggestions,
        merged_signals, review_queue, sensitive_flags, note_findings, note_verdicts, masked_notes,
    )
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_HITS = K.keyword_hits(L.CORPUS_CATEGORIES)
_EV = f"hits as ({_HITS}), ev as (select *, {K.around('text', 'pos', 300)} as passage from hits)"
_HEAD = lambda x, n: f"case when length({x}) > {n} then regexp_replace(left({x}, {n // 2}), '{K.SPACE}$', '') || ' ... ' || regexp_replace(right({x}, {n - n // 2 - 5}), '^{K.SPACE}', '') else {x} end"
_SCORED = (
    f"{_EV}, sc as (select *, {K.hits('lower(passage)', L.CORPUS_BOOST)} as boost_hits, {K.hits('lower(passage)', L.CORPUS_PENALTY)} as penalty_hits, {K.hits('lower(passage)', L.CORPUS_CRITICAL)} as critical_hits from ev where passage <> ''),"
    " sd as (select *, least(greatest(0.5::double + least(0.2::double, 0.05::double * boost_hits) - least(0.3::double, 0.1::double * penalty_hits), 0), 1) as score from sc)"
)


def _features(cat: str, low: str) -> str:
    parts = [f"case when {K.any_hit(low, t)} then {K.quote(n)} end" for n, t in L.CONCRETE_FEATURES.items()]
    parts += [f"case when {cat} = {K.quote(c)} and {K.any_hit(low, t)} then {K.quote(n)} end" for c, n, t in L.CATEGORY_FEATURES]
    return f"list_sort(list_filter([{', '.join(parts)}], lambda x: x is not null))"


def _signals(cat: str, low: str) -> str:
    years = "|".join(str(y) for y in range(2000, 2024))
    parts = [f"case when {K.any_hit(low, t)}" + (f" or (contains({low}, 'review') and regexp_matches({low}, '{years}'))" if n == "outdated" else "") + f" then {K.quote(n)} end" for n, t in L.NEGATIVE_SIGNALS.items()]
    parts += [f"case when {cat} = {K.quote(c)} and not {K.any_hit(low, t)} then {K.quote(n)} end" for c, n, t in L.ABSENCE_SIGNALS]
    return f"list_filter([{', '.join(parts)}], lambda x: x is not null)"


_QUALITY = (
    f"{_SCORED}, q0 as (select *, lower({_HEAD('passage', 280)}) as low from sd), q1 as (select *, {_features('category', 'low')} as features, {_signals('category', 'low')} as base from q0),"
    " q2 as (select *, list_sort(list_distinct(base || list_filter([case when not list_contains(features, 'owner') then 'missing_owner' end, case when not list_contains(features, 'review_or_frequency') then 'missing_review_date' end], lambda x: x is not null))) as signals,"
    f" case when critical_hits > 0 or list_has_any(base, [{', '.join(K.quote(h) for h in L.HARD_SIGNALS)}]) then 'warning' when score >= 0.55::double and len(features) >= 3 then 'strong' when score >= 0.5::double and len(features) >= 2 then 'medium' else 'weak' end as quality from q1)"
)
_CHUNKS = (
    f"flat as (select doc_id, {K.collapse('text')} as t from documents), chunks as (select doc_id, i as chunk_index, start_char, least(start_char + 900, length(t)) as end_char, trim(substr(t, start_char + 1, 900)) as chunk_text from ("
    "select doc_id, t, unnest(range(1, n + 2)) as i, unnest(list_transform(range(0, n + 1), lambda k: k * 780)) as start_char from (select *, ceil(greatest(length(t) - 900, 0) / 780.0)::int as n from flat where length(t) > 0)))"
)


def _topics(topics: dict[str, tuple[str, ...]]) -> str:
    rows = K.values([(t, a, S.fold_term(a)) for t, aliases in topics.items() for a in aliases], "topic, term, folded")
    return (
        f"{_CHUNKS}, ft as (select *, {K.for_match('chunk_text')} as f from chunks where chunk_text <> ''), th as (select doc_id, chunk_index, list_sort(list_distinct(list(topic))) as topics, count(distinct term) as n_terms from ft, {rows} k where contains(f, folded) group by all),"
        f" tc as (select th.*, {K.hits('f', L.CONCRETE_TERMS)} as c, {K.hits('f', L.NEGATIVE_TERMS)} as n, {K.hits('f', L.STALE_TERMS)} as s, {K.hits('f', L.CONFLICT_TERMS)} as x from th join ft using (doc_id, chunk_index)),"
        " td as (select *, round(least(greatest(0.48::double + least(n_terms * 0.06::double, 0.24::double) + least(c * 0.04::double, 0.16::double) - least((n + s + x) * 0.14::double, 0.32::double), 0), 1), 4) as confidence from tc),"
        " te as (select doc_id, chunk_index, topics, n_terms::int as n_terms, confidence, case when x > 0 then 'conflicting' when s > 0 then 'stale_evidence' when n > 0 or confidence < 0.74::double then 'needs_review' else 'covered' end as status from td where confidence >= 0.55::double)"
    )


_TE = _topics(TOPICS)
_LOWTEXT = K.casefold("coalesce(text, '')")
_FEATURE_SQL = ", ".join(f"{K.any_hit('low', [t.casefold().replace('ß', 'ss') for t in terms])} as {name}" for name, terms in L.ITEM_FEATURES.items())
_DATE = r"\b(19|20)\d{2}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.(19|20)\d{2}\b"
_FEAT = f"fe as (select doc_id, lang, len({K.tokens('text')})::int as word_count, regexp_matches(coalesce(text, ''), '{_DATE}') as has_date, {_FEATURE_SQL} from (select *, {_LOWTEXT} as low from documents))"
_SEV = (
    f"{_FEAT}, sv as (select *, list_sort(list_filter([case when has_backup_terms and not has_review_terms then 'missing_restore_test' end, case when contains_negative_phrase then 'negative_evidence_phrase' end, case when contains_future_tense then 'future_tense_commitment' end,"
    " case when has_incident_terms and not has_date then 'incident_without_date' end, case when has_supplier_terms and not has_policy_owner then 'supplier_without_owner' end], lambda x: x is not null)) as rs,"
    " 2 * (has_backup_terms and not has_review_terms)::int + 2 * contains_negative_phrase::int + contains_future_tense::int + (has_incident_terms and not has_date)::int + (has_supplier_terms and not has_policy_owner)::int as points from fe),"
    " sw as (select *, case when len(rs) = 0 then ['baseline_review'] else rs end as reasons, case when points >= 4 then 'P1' when points >= 2 then 'P2' else 'P3' end as priority, round(least(0.9::double, 0.5::double + points * 0.08::double), 2) as confidence from sv)"
)
_RULES = ", ".join(f"case when {K.any_hit('low', t)} then {K.quote(n)} end" for n, t in L.WEAK_LABELS.items())
_WEAK = (
    f"wl as (select doc_id, lang, list_sort(list_filter([{_RULES}], lambda x: x is not null)) as ls, {K.any_hit('low', L.LABEL_CONFLICT_TERMS)} as neg from (select *, {_LOWTEXT} as low from documents)),"
    f" wm as (select doc_id, lang, ls, len(list_intersect(ls, [{', '.join(K.quote(x) for x in L.DOCUMENT_LABELS)}])) > 1 or (len(list_filter(ls, lambda x: suffix(x, '_evidence'))) > 0 and neg) as conflict from wl)"
)
_SUGGEST = "sg as (select * from (" + " union all ".join(
    f"select doc_id, {K.quote(c)} as control, {K.hits(K.casefold('text'), t)} as n_terms from documents" for c, t in L.CONTROL_TERMS.items()
) + ") where n_terms > 0), sh as (select doc_id, control, n_terms, round(least(0.9::double, 0.45::double + n_terms * 0.1::double), 2) as confidence, case when least(0.9::double, 0.45::double + n_terms * 0.1::double) >= 0.7::double then 'suggested' else 'experimental' end as status from sg where least(0.9::double, 0.45::double + n_terms * 0.1::double) >= 0.55::double)"
_WINDOWS = (
    "win as (select doc_id, k::int as window_index, (k * 1536)::int as \"start\", (case when k = f then n else k * 1536 + 2048 end)::int as \"end\", (case when k = f then n else k * 1536 + 1536 end)::int as core_end, k = f as is_tail from ("
    "select doc_id, n, f, unnest(range(0, f + 1)) as k from (select doc_id, length(text) as n, greatest(ceil((length(text) - 3584) / 1536.0), 0)::int as f from documents where length(text) > 0)))"
)

_FOUND = K.findings("review_items", "load_seq", "review_note")
_SEEN = " or ".join(f"count(*) filter (type = {K.quote(t)}) > 0" for t in P.SEVERITIES)

SQL = {
    "note_findings": f"with {_FOUND} select type, severity, count(*) as n, count(distinct load_seq) as rows from fi group by 1, 2",
    "note_verdicts": f"with {_FOUND}, c as (select load_seq, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from fi group by 1) select distinct r.load_seq, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low, case when coalesce(high, 0) + coalesce(medium, 0) > 0 then 'block' when coalesce(low, 0) > 0 then 'warn' else 'pass' end as status from review_items r left join c using (load_seq)",
    "masked_notes": f"with sn as (select load_seq, review_note from review_items where review_note is not null), {K.masked('sn', 'load_seq', 'review_note')}, {_FOUND}, se as (select distinct load_seq from fi) select load_seq, note, load_seq in (select load_seq from se) as sensitive from mk",
    "text_sizes": f"select doc_id, coalesce(length({K.collapse('text')}), 0)::int as n_chars, len({K.tokens('text')})::int as n_tokens, left(sha256({K.for_match('text')}), 12) as match_hash from documents",
    "normalized_texts": "select doc_id, sha256(regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), chr(0), ''), ' {3,}', ' ', 'g'), '^SP|SP$', '', 'g')) as text_hash from documents".replace("SP", K.SPACE),
    "document_frequency": f"select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({K.tokens('text')}) as term from documents) group by 1",
    "keyword_positions": f"with hits as ({_HITS}) select doc_id, pos, keyword from hits",
    "evidence_rows": f"with {_EV}, no as (select *, row_number() over (partition by doc_id order by pos) as evidence_no from ev where passage <> ''), de as (select *, row_number() over (partition by doc_id, category, {K.casefold('passage')} order by pos) as n from no) select doc_id, pos, category, evidence_no::int as evidence_no, {_HEAD('passage', 160)} as citation from de where n = 1",
    "text_windows": f"with {_WINDOWS} select * from win",
    "windowed_hits": f"with hits as ({_HITS}), {_WINDOWS} select doc_id, window_index, count(*) as n from hits join win using (doc_id) where pos >= \"start\" and pos < core_end group by 1, 2",
    "text_chunks": f"with {_CHUNKS} select doc_id, chunk_index::int as chunk_index, start_char::int as start_char, end_char::int as end_char, sha256(chunk_text) as snippet_hash from chunks where chunk_text <> ''",
    "chunk_locators": f"select c.load_seq, coalesce(sha256(trim(substr(t, start_char + 1, end_char - start_char))) = lower(snippet_hash), false) as ok from document_chunks c join (select document_id, {K.collapse('text')} as t from documents) d on d.document_id = trim(c.document_id)",
    "passage_scores": f"with {_SCORED} select doc_id, pos, boost_hits, penalty_hits, critical_hits, round(score, 4) as score, score >= 0.7::double and critical_hits = 0 as positive from sd",
    "keyword_confidence": f"with {_EV} select doc_id, pos, round(least(greatest(0.5::double + case when k > 1 then least(0.2::double, 0.05::double * (k - 1)) else 0 end + least(0.2::double, 0.05::double * {K.hits('lower(passage)', L.CORPUS_BOOST)}) - least(0.3::double, 0.1::double * {K.hits('lower(passage)', L.CORPUS_PENALTY)}) + case when keyword = upper(keyword) then 0.05::double else 0 end, 0), 1), 4) as confidence from (select *, (length(passage) - length(replace(lower(passage), lower(keyword), ''))) // length(keyword) as k from ev where passage <> '')",
    "evidence_quality": f"with {_QUALITY} select doc_id, pos, category, array_to_string(features, '|') as features, array_to_string(signals, '|') as signals, quality from q2",
    "quality_counts": f"with {_QUALITY} select doc_id, " + ", ".join(f"count(*) filter (quality = '{q}') as {q}" for q in ("strong", "medium", "weak", "warning")) + " from q2 group by 1",
    "category_rollup": f"with {_EV} select doc_id, category, count(*) as n from ev where passage <> '' group by 1, 2 union all select null, category, count(ev.doc_id) from {K.values([(c,) for c in [*CATEGORIES, 'none']], 'category')} v left join (select * from ev where passage <> '') ev using (category) group by category",
    "coverage_matrix": f"with {_QUALITY}, cv as (select control, count(q2.doc_id) as evidence_count, count(distinct case when quality = 'strong' then doc_id end) as strong_documents from {K.values(BRIDGE, 'control, category')} b left join q2 using (category) group by 1) select *, case when strong_documents > 0 then 'strong' when evidence_count > 0 then 'review' else 'missing' end as status from cv",
    "topic_chunks": f"with {_TE} select doc_id, chunk_index::int as chunk_index, array_to_string(topics, '|') as topics, n_terms, confidence, status from te",
    "default_topics": f"with {_topics(L.TOPIC_ALIASES)} select doc_id, chunk_index::int as chunk_index, array_to_string(topics, '|') as topics, n_terms, confidence, status from te",
    "topic_coverage": f"with {_TE}, ex as (select unnest(topics) as topic, confidence, status from te), fo as (select topic, count(*) as n, max(confidence) as confidence, bool_or(status = 'conflicting') as c, bool_or(status = 'stale_evidence') as s from ex group by 1) select topic, coalesce(n, 0) as n, coalesce(confidence, 0.0::double) as confidence, case when n is null then 'missing' when c then 'conflicting' when s then 'stale_evidence' when confidence >= 0.74::double then 'covered' when confidence >= 0.62::double then 'partial' else 'needs_review' end as status from {K.values([(t,) for t in [*TOPICS, 'encryption']], 'topic')} v left join fo using (topic)",
    "top_topics": f"with {_TE}, ex as (select doc_id, chunk_index, unnest(topics) as topic from te), co as (select doc_id, topic, count(*) as n, min(chunk_index) as f from ex group by 1, 2), ra as (select doc_id, topic, n, row_number() over (partition by doc_id order by n desc, f, topic)::int as rank from co) select * from ra where rank <= 5",
    "topic_metrics": f"with {_TE}, e as (select distinct trim(document_id) as document_id, unnest(detected_topics) as topic from document_chunks), f as (select distinct document_id, topic from (select doc_id, unnest(topics) as topic from te) join documents using (doc_id)), j as (select e.topic as et, f.topic as ft from e full join f on e.document_id = f.document_id and e.topic = f.topic), c as (select count(*) filter (et is not null and ft is not null) as tp, count(*) filter (et is null) as fp, count(*) filter (ft is null) as fn from j) select tp, fp, fn, round(tp::double / nullif(tp + fp, 0), 4) as precision, round(tp::double / nullif(tp + fn, 0), 4) as recall from c",
    "topic_label_metrics": f"with {_TE}, e as (select trim(document_id) as document_id, flatten(list(detected_topics)) as e from document_chunks group by 1), f as (select document_id, flatten(list(topics)) as p from te join documents using (doc_id) group by 1), j as (select name, coalesce(list_contains(e, name), false) as e, coalesce(list_contains(p, name), false) as p from e left join f using (document_id), {K.values([(t,) for t in TOPICS], 'name')} v), c as (select name, count(*) filter (e and p) as tp, count(*) filter (not e and p) as fp, count(*) filter (e and not p) as fn from j group by 1) select *, round(tp::double / nullif(tp + fp, 0), 4) as precision, round(tp::double / nullif(tp + fn, 0), 4) as recall from c",
    "candidates": f"with {_CHUNKS}, ft as (select *, {K.for_match('chunk_text')} as f from chunks where chunk_text <> ''), k as (select {K.hits('f', L.CONCRETE_TERMS)} as c, {K.hits('f', L.STALE_TERMS)} + {K.hits('f', L.CONFLICT_TERMS)} as x from ft where not {K.any_hit('f', L.NEGATIVE_TERMS)}) select case when x > 0 then 'ambiguous' when c >= 2 then 'positive' else 'partial' end as status, case when x > 0 then 'low' when c >= 2 then 'high' when c = 1 then 'medium' else 'low' end as confidence, count(*) as n from k group by 1, 2",
    "item_features": f"with {_FEAT} select * exclude (lang) from fe",
    "weak_labels": f"with {_WEAK} select doc_id, array_to_string(ls, '|') as labels, conflict, case when len(ls) = 0 then 0.0::double else round(least(0.95::double, 0.55::double + len(ls) * 0.05::double) - case when conflict then 0.05::double else 0 end, 2) end as confidence from wm",
    "severity_rank": f"with {_SEV} select doc_id, points, array_to_string(reasons, '|') as reasons, priority, confidence from sw",
    "control_suggestions": f"with {_SUGGEST} select * from sh",
    "merged_signals": f"with {_SEV}, {_SUGGEST}, u as (select doc_id, 1 as o, control, confidence, 'control:' || status as reason from sh union all select doc_id, 2, null, confidence, unnest(reasons) from sw) select doc_id, min(control) as control, max(confidence) as confidence, array_to_string(list_sort(list_distinct(list(reason))), '|') as reasons from u group by 1",
    "review_queue": f"with {_SEV}, {_WEAK}, u as (select doc_id, priority, unnest(reasons) as reason, lang from sw where priority <> 'P3' union all select doc_id, 'P1', 'weak_label_conflict', lang from wm where conflict union all select doc_id, 'P3', 'no_label', lang from wm where len(ls) = 0) select doc_id, min(priority) as priority, array_to_string(list_sort(list_distinct(list(reason))), '|') as reasons from u where coalesce(lang, '') <> 'fr' group by 1",
    "sensitive_flags": "select doc_id, " + ", ".join(f"regexp_matches(text, {K._java(p)}) as {n}" for n, p in (("email", P.EMAIL), ("host", P.HOST), ("token", P.TOKEN_VALUE), ("keyword", P.KEYWORD), ("ipv4", P.IPV4))) + " from documents where text is not null",
}
