"""Queries of the text problems over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.canonical import map_values
from evidloom.llm.formatting_duplicates import collapse, duplicates
from evidloom.llm.leakage import leaked_spans, remove_leaks
from evidloom.llm.pii import redact_fields
from evidloom.llm.shared_spans import shared_links, shared_pairs, shared_part, shared_passages
from evidloom.llm.splitting import split_texts
from evidloom.llm.tokenizer import encode_corpus
from evidloom.session import table


#: Secret of the pseudonyms in these queries; a real corpus brings its own.
PSEUDONYM_KEY = b"evidloom query key"
NOTES = (("review_items", ["review_note"]), ("case_review_queue", ["reviewer_note", "final_answer"]))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    parts = [redact_fields(table(spark, sf, t), fields, ["load_seq"], PSEUDONYM_KEY).withColumn("source_table", F.lit(t)) for t, fields in NOTES]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_redacted(spark, sf).select("source_table", "load_seq", "field_name", F.explode("pii_types").alias("pii_type"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(table(spark, sf, "documents"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).where("piece_index = 0").select("doc_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    got = duplicates(table(spark, sf, "questionnaire_draft"))
    return got.where("load_seq <> first").select(F.col("first").alias("first_seq"), F.col("load_seq").alias("copy_seq"))


def p6_questions(spark: SparkSession, sf: str) -> DataFrame:
    return collapse(table(spark, sf, "questionnaire_draft"))


TYPED_VALUES = (("review_items", "review_status"), ("case_review_queue", "reviewer_decision"))


def mapped_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-blank typed value with its entry, literal ones included, and all entries within distance."""
    lists = table(spark, sf, "canonical_values")
    parts = []
    for name, column in TYPED_VALUES:
        reference = lists.where(F.col("list_name") == column).select("canon_value", "label_en", "label_de")
        mapped = map_values(table(spark, sf, name), column, reference, ["load_seq"])
        parts.append(mapped.select(F.lit(name).alias("source_table"), "load_seq", F.col(column).alias("typed"), "canon_value", "distance", "candidates"))
    return parts[0].unionByName(parts[1])


def p7_mapped(spark: SparkSession, sf: str) -> DataFrame:
    return mapped_values(spark, sf).drop("candidates")


def p7_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All entries within distance of each typed value, by the path nearest to it."""
    each = mapped_values(spark, sf).select("source_table", "load_seq", F.explode("candidates").alias("c"))
    return each.groupBy("source_table", "load_seq", F.col("c.entry").alias("canon_value")).agg(F.min("c.distance").alias("distance"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mapped_values(spark, sf).where("typed <> canon_value").select("source_table", "load_seq", "canon_value")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_spans(table(spark, sf, "documents"), table(spark, sf, "test_items")).select("doc_id", "item_id").distinct()


def p9_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return remove_leaks(docs, leaked_spans(docs, table(spark, sf, "test_items"))).where("removed > 0")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_pairs(table(spark, sf, "documents"))


def p10_links(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each document: its class of equal texts and the number of other classes that it shares a passage with."""
    return shared_links(table(spark, sf, "documents"))


def p10_passages(spark: SparkSession, sf: str) -> DataFrame:
    return shared_passages(table(spark, sf, "documents"))


def p10_shared_part(spark: SparkSession, sf: str) -> DataFrame:
    return shared_part(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p3_found, p3_pieces, p6_found, p6_questions, p7_found, p7_mapped, p7_candidates, p8_ids, p9_found, p9_cleaned, p10_found, p10_links, p10_passages, p10_shared_part)}

# --- the same in SQL -------------------------------------------------------------------------------------------------

# p6: letters and digits, lower case; the data have no character that folds to several. A question's fields, sorted.
_SOLID = "regexp_replace(lower(%s), '[^\\pL\\pN]+', '', 'g')"
_QUESTIONS = f"""
with p as (
  select load_seq, {_SOLID % "original_question"} as s, list_filter(string_split_regex(original_question, '[|;\\n\\r]'), lambda x: {_SOLID % "x"} <> '') as parts
  from questionnaire_draft where original_question is not null
), k as (
  select load_seq, s, case when len(parts) > 1 and len(list_filter(parts, lambda x: contains(x, ':') and {_SOLID % "string_split(x, ':')[1]"} <> '')) = len(parts)
    then list_sort(list_transform(parts, lambda x: {_SOLID % "string_split(x, ':')[1]"} || ':' || {_SOLID % "substr(x, strpos(x, ':'))"}))::varchar end as f
  from p where s <> ''
), g as (select load_seq, coalesce(min(f) over (partition by s), s) as gid from k),
h as (select load_seq, min(load_seq) over (partition by gid) as first_seq from g)
"""

# p7: the readings of a typed value, from most to least literal, and the nearest entry of the first that has one.
_FOLD = "trim(regexp_replace(lower(nfc_normalize(%s)), '[\\s_\\x{A0}\\x{2010}-\\x{2015}\\x{200B}\\x{FEFF}-]+', ' ', 'g'))"
_EDGES = "regexp_replace(%s, '^[^\\pL\\pN_]+|[^\\pL\\pN_]+$', '', 'g')"
_PLAIN = "replace(replace(replace(replace(%s, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
#: DuckDB counts edits of bytes, so every letter is to be one byte; the entries have no others than these.
_ONE_BYTE = "regexp_replace(translate(%s, 'äöüß', chr(1) || chr(2) || chr(3) || chr(4)), '[^\\x00-\\x7F]', chr(5), 'g')"
_EDITS = f"damerau_levenshtein({_ONE_BYTE % 'q'}, {_ONE_BYTE % 'path'})"
_MAPPED = f"""
with t as (
  select 'review_items' as source_table, load_seq, 'review_status' as list_name, review_status as v from review_items
  union all select 'case_review_queue', load_seq, 'reviewer_decision', reviewer_decision from case_review_queue
), d as (select distinct list_name, v from t where regexp_matches(v, '[^\\s\\x{{A0}}\\x{{200B}}\\x{{FEFF}}]')),
w as (select *, {_FOLD % "v"} as whole from d),
u as (select *, regexp_replace(regexp_replace(whole, '^[^\\pL\\pN_]+', ''), '^[\\pL]{{2,12}} ?[:=]\\s*', '') as bare from w),
r as (
  select list_name, v, 1 as o, whole as q from u union all select list_name, v, 2, {_EDGES % "whole"} from u union all select list_name, v, 3, {_EDGES % "bare"} from u
  union all select list_name, v, 4, {_EDGES % "string_split_regex(bare, '[,;/(\\[|]| [?!–-]')[1]"} from u
), e as (
  select distinct list_name, canon_value, path from (
    select list_name, canon_value, unnest([{_FOLD % "canon_value"}, {_FOLD % "label_en"}, {_FOLD % "label_de"}]) as path from canonical_values)
  union select distinct list_name, canon_value, {_PLAIN % "path"} from (select list_name, canon_value, unnest([{_FOLD % "canon_value"}, {_FOLD % "label_en"}, {_FOLD % "label_de"}]) as path from canonical_values)
), m as (
  select r.list_name, v, o, canon_value, min({_EDITS}) as dist, min({_EDITS} * 1000 + {_EDITS}::double / length(path)) as score
  from r join e on r.list_name = e.list_name and q <> '' and abs(length(q) - length(path)) <= 3
    and {_EDITS} <= case when length(path) < 3 then 0 when length(path) < 6 then 1 when length(path) < 9 then 2 else 3 end
  group by all
), b as (select *, rank() over (partition by list_name, v order by o, score) as n from m),
c as (select list_name, v, min(canon_value) as canon_value, count(*) as ties, min(dist) as dist from b where n = 1 group by all)
"""

# p9: every run of twelve words of an item and of a document. p10: every span of 300 code points.
_WORDS = "regexp_extract_all(lower(text), '[\\pL\\pN]+')"
_GRAMS = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))"

# p9: the leaked spans of each document as words, as places of the text, joined where they overlap, and the rest.
_LEAKED = f"""
with i as (select item_id, {_WORDS} as w from test_items), ig as (select distinct item_id, {_GRAMS} as g from i where len(w) >= 12),
d as (select doc_id, text, {_WORDS} as w, regexp_extract_all(text, '[\\pL\\pN]+') as ws, string_split_regex(text, '[\\pL\\pN]+') as gaps from documents),
dg as (select doc_id, unnest(range(1, len(w) - 10)) as k, {_GRAMS} as g from d where len(w) >= 12),
h as (select distinct doc_id, item_id, k from dg join ig using (g)),
r as (select doc_id, item_id, min(k) as a, max(k) + 11 as z from (select *, k - row_number() over (partition by doc_id, item_id order by k) as n from h) group by doc_id, item_id, n),
wd as (select doc_id, k, sum(g + s) over w - s as "start", sum(g + s) over w as "end" from (
  select doc_id, unnest(range(1, len(ws) + 1)) as k, unnest(list_transform(ws, lambda x: length(x))) as s, unnest(list_transform(gaps[1:len(ws)], lambda x: length(x))) as g from d where doc_id in (select doc_id from h)) window w as (partition by doc_id order by k)),
sp as (select distinct r.doc_id, x."start", y."end", z - a + 1 as words from r join wd x on x.doc_id = r.doc_id and x.k = a join wd y on y.doc_id = r.doc_id and y.k = z),
us as (select doc_id, sum(greatest("end" - greatest("start", coalesce(u, 0)), 0)) as chars from (select *, max("end") over (partition by doc_id order by "start", "end", words rows between unbounded preceding and 1 preceding) as u from sp) group by 1),
cut as (select sp.* from sp join us using (doc_id) join d using (doc_id) where words > 16 or chars > 0.05::double * length(text)),
e as (select *, coalesce("start" > max("end") over (partition by doc_id order by "start", "end", words rows between unbounded preceding and 1 preceding), true) as fresh from cut),
il as (select doc_id, min("start") as s, max("end") as e from (select *, sum(fresh::int) over (partition by doc_id order by "start", "end", words rows unbounded preceding) as n from e) group by doc_id, n),
ip as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as b from il),
cleaned as (select doc_id, (string_agg(case when s > 0 then substr(text, b::int + 1, (s - b)::int) || ' ' else '' end, '' order by s) || substr(text, max(e)::int + 1)) as text, sum(e - s)::int as removed from ip join d using (doc_id) group by doc_id, d.text)
"""
_SPANS = "g as (select doc_id, i, hash(substr(text, i, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300))"
_SHARED = f"{_SPANS}, k as (select h from g group by 1 having min(doc_id) <> max(doc_id))"

SQL = {
    "p3_found": "select doc_id from documents where length(text) > 2400",
    "p6_found": _QUESTIONS + "select first_seq, load_seq as copy_seq from h where load_seq <> first_seq",
    "p6_questions": _QUESTIONS + "select load_seq, original_question, copies from questionnaire_draft join (select first_seq as load_seq, count(*) as copies from h group by 1) using (load_seq)",
    "p7_found": _MAPPED + "select source_table, load_seq, case when ties = 1 then canon_value else 'unmatched' end as canon_value from t join d using (list_name, v) left join c using (list_name, v) where v <> coalesce(case when ties = 1 then canon_value end, 'unmatched')",
    "p7_mapped": _MAPPED + "select source_table, load_seq, v as typed, case when ties = 1 then canon_value else 'unmatched' end as canon_value, case when ties = 1 then dist end::int as distance from t join d using (list_name, v) left join c using (list_name, v)",
    "p7_candidates": _MAPPED + ", w1 as (select list_name, v, min(o) as o from m group by all) select source_table, load_seq, m.canon_value, min(m.dist)::int as distance from t join w1 using (list_name, v) join m using (list_name, v, o) group by all",
    "p9_cleaned": _LEAKED + "select * from cleaned where removed > 0",
    "p9_found": f"with i as (select item_id, {_WORDS} as w from test_items), d as (select doc_id, {_WORDS} as w from documents), ig as (select distinct item_id, {_GRAMS} as g from i where len(w) >= 12), dg as (select doc_id, {_GRAMS} as g from d where len(w) >= 12) select distinct doc_id, item_id from dg join ig using (g)",
    "p10_found": "with g as (select distinct doc_id, hash(substr(text, i, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300)), k as (select h from g group by 1 having count(*) > 1), s as (select g.* from g semi join k using (h)) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from s a join s b using (h) where a.doc_id < b.doc_id",
    "p10_passages": f'with {_SHARED}, s as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as r from g semi join k using (h)) select doc_id, (min(i) - 1)::int as "start", (max(i) + 299)::int as "end" from s group by doc_id, r',
    "p10_links": "with c as (select doc_id, text, min(doc_id) over (partition by coalesce(text, 'null ' || doc_id)) as class_id, count(*) over (partition by coalesce(text, 'null ' || doc_id)) as copies from documents), g as (select distinct doc_id, hash(substr(text, i, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from c where doc_id = class_id and length(text) >= 300)), k as (select h from g group by 1 having count(*) > 1), s as (select g.* from g semi join k using (h)), l as (select doc_id as class_id, count(distinct o) as links from (select a.doc_id, b.doc_id as o from s a join s b using (h) where a.doc_id <> b.doc_id) group by 1) select doc_id, class_id, copies, coalesce(links, 0) as links from c left join l using (class_id)",
    "p10_shared_part": f"with {_SHARED}, s as (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i + 300) as n from g semi join k using (h)), t as (select doc_id, sum(least(300, n - i)) as c from s group by 1) select doc_id, coalesce(length(text), 0)::int as n_chars, coalesce(c, 0)::int as shared_chars from documents left join t using (doc_id)",
}
