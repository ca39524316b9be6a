"""Queries of the general data problems: instants (p1), unloadable rows (p4) and orphan references (p5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.operators import orphans as O
from evidloom.operators.rowparse import REVIEW_FIELDS, load_review_lines
from evidloom.operators.timestamps import ABBREVIATIONS, ISO_UTC, is_canonical, normalize_timestamps
from evidloom.session import table

TYPED_TIMES = (("review_items", "reviewed_at"), ("cases", "reviewed_at"), ("manifest", "retrieved_at"))


def instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the three typed time columns with its instant or the reason why it has none."""
    rows = None
    for name, column in TYPED_TIMES:
        part = table(spark, sf, name).select(F.lit(name).alias("source_table"), "load_seq", "client_id", F.col(column).alias("raw_time"))
        rows = part if rows is None else rows.unionByName(part)
    clients = table(spark, sf, "clients").select("client_id", "home_zone", "date_order")
    return normalize_timestamps(rows.join(clients, "client_id", "left"), "raw_time", "home_zone", "date_order", source="source_table")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    got = instants(spark, sf)
    return got.where((F.col("verdict") == "instant") & ~is_canonical(F.col("raw_time"))).select("source_table", "load_seq", "utc_second")


def p1_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return instants(spark, sf).groupBy("source_table", "verdict").agg(F.count("*").alias("n"))


def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    statuses = table(spark, sf, "canonical_values").where("list_name = 'review_status'").select("canon_value")
    return load_review_lines(table(spark, sf, "review_lines"), statuses)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return review_rows(spark, sf).where("reason is not null").select("line_no", "reason")


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return review_rows(spark, sf).where("reason is null").drop("reason", "error_offset")


def references(spark: SparkSession, sf: str) -> list[tuple[DataFrame, DataFrame]]:
    """The references of each of three tables with the lifetimes of their targets."""
    chunks, evidence, drafts = (table(spark, sf, t) for t in ("document_chunks", "evidence_record", "questionnaire_draft"))
    return [
        (O.scalar_refs(chunks, "document_chunks", "document_id"), O.lifetimes(table(spark, sf, "documents"), "document_id")),
        (O.scalar_refs(evidence, "evidence_record", "source_finding_id"), O.lifetimes(table(spark, sf, "review_items"), "finding_id")),
        (O.array_refs(drafts, "questionnaire_draft", "evidence_refs"), O.lifetimes(evidence, "evidence_id")),
    ]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = reduce(DataFrame.unionByName, (O.orphans(refs, targets) for refs, targets in references(spark, sf)))
    return found.select("ref_table", F.date_format("recorded_at", "yyyy-MM").alias("period"), "load_seq", "ref_value")


def p5_orphan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (O.orphan_counts(refs, targets) for refs, targets in references(spark, sf)))


QUERIES = {f.__name__: f for f in (p1_found, p1_verdicts, p4_found, p4_loaded, p5_found, p5_orphan_counts)}

_BLANKS = r"^[\s\x{00A0}\x{200B}\x{FEFF}]+|[\s\x{00A0}\x{200B}\x{FEFF}]+$"
_TRIM = f"regexp_replace(%s, '{_BLANKS}', '', 'g')"
_BROKEN_SQL = f"""
with refs as (
  select 'document_chunks' as ref_table, load_seq, recorded_at, {_TRIM % 'document_id'} as ref_value, 1 as kind from document_chunks
  union all select 'evidence_record', load_seq, recorded_at, {_TRIM % 'source_finding_id'}, 2 from evidence_record
  union all select distinct 'questionnaire_draft', load_seq, recorded_at, {_TRIM % 'r'}, 3
    from (select load_seq, recorded_at, unnest(evidence_refs) as r from questionnaire_draft)
), targets as (
  select 1 as kind, document_id as ref_value, min(recorded_at) as first_at, min(deleted_at) as gone_at from documents group by all
  union all select 2, finding_id, min(recorded_at), min(deleted_at) from review_items group by all
  union all select 3, evidence_id, min(recorded_at), min(deleted_at) from evidence_record group by all
), broken as (
  select refs.* from refs left join targets using (kind, ref_value)
  where ref_value <> '' and (first_at is null or first_at > recorded_at or coalesce(gone_at <= recorded_at, false))
)
"""

# A record is sound if it is a sequence of fields, each quoted as a whole or without any quote; commas outside of quotes
# separate fields.
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NTH = f"regexp_extract(raw_line, '^(?s:(?:{_FIELD},){{%d}}({_FIELD}))(?:,|$)', 1)"
_BARE = "case when prefix(%s, '\"') then replace(substr(%s, 2, length(%s) - 2), '\"\"', '\"') else %s end"
_DAY = "try_strptime(left(reviewed_at, 10), '%Y-%m-%d') is not null"
_ROWS_SQL = f"""
with l as (
  select line_no, raw_line, coalesce(regexp_full_match(raw_line, '(?s){_FIELD}(?:,{_FIELD})*'), true) as sound,
    case when raw_line is null then 0 else length(regexp_replace(regexp_replace(raw_line, '(?s)"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 end as n
  from review_lines
), f as (
  select *, {_NTH % 0} as f0, {_NTH % 9} as f9, {_NTH % 12} as f12 from l
), g as (
  select *, {_BARE % (("f0",) * 4)} as finding_id, {_BARE % (("f9",) * 4)} as review_status, {_BARE % (("f12",) * 4)} as reviewed_at from f
), r as (
  select line_no, case when not sound then 'quoting' when n <> 13 then 'column_count' when not regexp_full_match(finding_id, 'F-[0-9a-f]{{12}}') then 'finding_id'
    when review_status <> '' and review_status not in (select canon_value from canonical_values where list_name = 'review_status') then 'review_status'
    when reviewed_at <> '' and not coalesce(regexp_full_match(reviewed_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9]))?') and {_DAY}, false) then 'reviewed_at' end as reason
  from g
)
"""

# Instants: each form of a value is taken apart by a pattern of its own; then date, wall time, offset and zone are the
# same columns for all.
_TIME_SQL = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?"
_FORMS_SQL = [
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt]|\s+){_TIME_SQL}(.*)", "'y', 'mo', 'd', 'h', 'mi', 's', 'rest'", "mo", "''"),
    (r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(.*)", "'y', 'mo', 'd', 'h', 'mi', 's', 'rest'", "mo", "''"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_TIME_SQL}(.*)", "'d', 'mo', 'y', 'h', 'mi', 's', 'rest'", "mo", "''"),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_TIME_SQL}(.*)", "'a', 'b', 'y', 'h', 'mi', 's', 'rest'", "", "''"),
    (rf"(?:([A-Za-z]{{3}}),\s*)?(\d{{1,2}})\s+([A-Za-zä]+)\.?\s+(\d{{4}}),?\s+{_TIME_SQL}(.*)", "'wd', 'd', 'mon', 'y', 'h', 'mi', 's', 'rest'", "mon", "x.wd"),
    (rf"([A-Za-z]+)\.?\s+(\d{{1,2}}),\s+(\d{{4}}),?\s+{_TIME_SQL}(.*)", "'mon', 'd', 'y', 'h', 'mi', 's', 'rest'", "mon", "''"),
    (rf"(\d{{1,2}})\.\s*([A-Za-zä]+)\.?\s+(\d{{4}}),?\s+{_TIME_SQL}(.*)", "'d', 'mon', 'y', 'h', 'mi', 's', 'rest'", "mon", "''"),
]
_MONTH = "coalesce(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(lower(x.mon), 3)), list_position(['jän', '', 'mär', '', 'mai', '', '', '', '', 'okt', '', 'dez'], left(lower(x.mon), 3)))"


def _form(k: int) -> str:
    pattern, names, month, weekday = _FORMS_SQL[k]
    day, mo = "x.d::int", _MONTH if month == "mon" else "x.mo::int"
    if not month:
        day, mo = "case date_order when 'dmy' then x.a::int when 'mdy' then x.b::int end", "case date_order when 'dmy' then x.b::int when 'mdy' then x.a::int end"
    earlier = "".join(f" and not regexp_full_match(v, '{p}')" for p, *_ in _FORMS_SQL[:k])
    return f"select source_table, load_seq, raw, home_zone, x.y::int as y, {mo} as mo, {day} as d, x.h::int as h, x.mi::int as mi, coalesce(nullif(x.s, ''), '0')::int as s, x.rest as rest, lower({weekday}) as wd from (select *, regexp_extract(v, '^{pattern}$', [{names}]) as x from v where regexp_full_match(v, '{pattern}'){earlier})"


_ABBREVIATED = ", ".join(f"('{name}', {minutes})" for name, minutes in ABBREVIATIONS.items())
#: Abbreviations of several meanings, where the client's zone settles which.
_AT_HOME = "('EST', 'America/New_York', -300), ('BST', 'Europe/London', 60), ('NST', 'America/St_Johns', -210), ('IST', 'Asia/Kolkata', 330)"
_INSTANTS_SQL = f"""
with r as (
  select 'review_items' as source_table, load_seq, client_id, reviewed_at as raw from review_items union all select 'cases', load_seq, client_id, reviewed_at from cases
  union all select 'manifest', load_seq, client_id, retrieved_at from manifest
), v as (select r.*, home_zone, date_order, {_TRIM % "raw"} as v from r left join clients using (client_id) where raw is not null),
f as ({" union all ".join(_form(k) for k in range(len(_FORMS_SQL)))}),
o as (select *, regexp_extract(rest, '^\\s*(?:([AaPp][Mm])\\b)?\\s*(?:Uhr)?\\s*([Zz]|[+-]\\d{{2}}:?\\d{{2}})?\\s*(?:\\[?([A-Za-z]+(?:[/_+-][A-Za-z0-9_]+)+|[A-Za-z]{{2,5}})\\]?)?\\s*$', ['half', 'off', 'zone']) as z
  from f where regexp_full_match(rest, '\\s*(?:([AaPp][Mm])\\b)?\\s*(?:Uhr)?\\s*([Zz]|[+-]\\d{{2}}:?\\d{{2}})?\\s*(?:\\[?([A-Za-z]+(?:[/_+-][A-Za-z0-9_]+)+|[A-Za-z]{{2,5}})\\]?)?\\s*')),
w as (select *, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, case when z.half = '' then h when h between 1 and 12 then h % 12 + 12 * (lower(z.half) = 'pm')::int else 99 end, mi, s) as timestamp) as wall from o),
x as (select w.*, coalesce(b.minutes, m.minutes) as minutes, case when z.off = '' then null when lower(z.off) = 'z' then 0 else (left(z.off, 1) || '1')::int * (substr(z.off, 2, 2)::int * 60 + right(z.off, 2)::int) end as east, case when contains(z.zone, '/') then z.zone when z.zone = '' then home_zone end as tz
  from w left join (select * from (values {_ABBREVIATED}) as b(name, minutes)) b on b.name = upper(z.zone) left join (select * from (values {_AT_HOME}) as m(name, home, minutes)) m on m.name = upper(z.zone) and m.home = w.home_zone where wall is not null and (wd = '' or wd = lower(strftime(wall, '%a')))),
y as (select *, case when east is null and minutes is null and tz is not null then timezone(tz, wall) end as u from x),
i as (
  select source_table, load_seq, raw, case when east is not null then epoch(wall)::bigint - 60 * east when minutes is not null then epoch(wall)::bigint - 60 * minutes
    when u is not null and timezone(tz, u) = wall and timezone(tz, u + interval 1 hour) <> wall and timezone(tz, u - interval 1 hour) <> wall then epoch(u)::bigint end as utc_second from y
  union all select source_table, load_seq, raw, try_cast(v as bigint) // case length(v) when 10 then 1 else 1000 end from v where regexp_full_match(v, '[0-9]{{10}}|[0-9]{{13}}')
)
"""
# Why a value denotes no instant, in the order of the checks.
_DATES_SQL = r"\d{4}-\d{1,2}-\d{1,2}|\d{8}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
_VERDICTS_SQL = (
    _INSTANTS_SQL
    + f"""
, a as (
  select r.source_table, r.load_seq, case when {_TRIM % "coalesce(r.raw, '')"} = '' then 'blank' when i.utc_second is not null then 'instant' when regexp_full_match({_TRIM % "r.raw"}, '{_DATES_SQL}') then 'date_only'
    when o.load_seq is null then 'unparsed' when w.wall is null or x.load_seq is null then 'impossible' when y.tz is null then 'no_zone' when timezone(y.tz, y.u) <> y.wall then 'local_time_skipped' else 'local_time_repeats' end as verdict
  from r left join i using (source_table, load_seq) left join o using (source_table, load_seq) left join w using (source_table, load_seq) left join x using (source_table, load_seq) left join y using (source_table, load_seq)
)
"""
)

SQL = {
    "p1_verdicts": _VERDICTS_SQL + "select source_table, verdict, count(*) as n from a group by 1, 2",
    "p1_found": _INSTANTS_SQL + f"select source_table, load_seq, utc_second from i where utc_second is not null and not regexp_full_match(raw, '{ISO_UTC[1:-1]}')",
    "p4_loaded": _ROWS_SQL + "select line_no, batch_name, " + ", ".join(f"{_BARE % ((_NTH % k,) * 4)} as {name}" for k, name in enumerate(REVIEW_FIELDS)) + " from r join review_lines using (line_no) where reason is null",
    "p4_found": _ROWS_SQL + "select line_no, reason from r where reason is not null",
    "p5_found": _BROKEN_SQL + "select ref_table, strftime(recorded_at at time zone 'UTC', '%Y-%m') as period, load_seq, ref_value from broken",
    "p5_orphan_counts": _BROKEN_SQL + "select ref_table, strftime(recorded_at at time zone 'UTC', '%Y-%m') as period, count(*) as broken, count(distinct ref_value) as missing_keys from broken group by 1, 2",
}
