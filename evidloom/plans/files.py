"""Queries over readers and writers: tables are written as files of each format, read back and compared."""

from __future__ import annotations

import io
import sqlite3
import tempfile
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidloom import sinks
from evidloom.functions import patterns as P
from evidloom.functions import text as TX
from evidloom.operators import constraints as C
from evidloom.operators import evaluate as E
from evidloom.operators import scoring as S
from evidloom.operators.rowparse import REVIEW_FIELDS
from evidloom.plans import duck as K
from evidloom.session import scratch, table
from evidloom.sources import artefacts as A
from evidloom.sources import files, preflight

#: What of a manifest row goes into its file.
PARTS = ("title", "publisher", "public_url", "document_version", "inclusion_reason")
CONTROLS = [("SC-01", ["supplier", "contract"], ["SC-02"]), ("SC-02", ["incident"], []), ("SC-03", ["patch"], ["SC-01", "SC-04"])]


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _docx(lines: pd.Series) -> pd.Series:
    return lines.map(lambda ls: _zip({"word/document.xml": "<w:document xmlns:w='w'>" + "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in ls) + "</w:document>"}))


@F.pandas_udf(T.BinaryType())
def _xlsx(lines: pd.Series) -> pd.Series:
    def one(ls):
        shared = "<sst xmlns='s'>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in ls) + "</sst>"
        cells = "".join(f"<row><c t='s'><v>{i}</v></c></row>" for i in range(len(ls)))
        return _zip({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": f"<worksheet xmlns='s'><sheetData>{cells}<row><c t='inlineStr'><is><t>end</t></is></c><c><v>7</v></c></row></sheetData></worksheet>"})

    return lines.map(one)


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "manifest")
    return m.select("load_seq", F.array(*(F.coalesce(TX.collapse(F.col(c)), F.lit("")) for c in PARTS)).alias("lines"))


def _read(spark: SparkSession, rows: DataFrame, content: Column, suffix: str, limits: files.Limits = files.WHOLE) -> DataFrame:
    """(load_seq, source_type, status, text_hash) of the rows, each written as a file and read again."""
    where = scratch(spark, "files")
    sinks.write_files(rows.select(F.concat(F.col("load_seq").cast("string"), F.lit(suffix)).alias("name"), content.alias("content")), where)
    got = files.read_documents(files.scan(spark, where), limits)
    seq = F.regexp_extract("path", r"([0-9]+)\.[^/]*$", 1).cast("long")
    return got.select(seq.alias("load_seq"), "source_type", "status", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


def read_text_files(spark, sf):
    rows = _manifest(spark, sf)
    body = F.array_join("lines", "\n")
    return _read(spark, rows.where("load_seq % 2 = 0"), body, ".txt").unionByName(_read(spark, rows.where("load_seq % 2 = 1"), body, ".md"))


def read_csv_files(spark, sf):
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    return _read(spark, _manifest(spark, sf), F.concat(F.lit("a,b\n"), body, F.lit("\n")), ".csv")


def read_json_files(spark, sf):
    return _read(spark, _manifest(spark, sf), F.to_json(F.struct(F.col("lines").alias("z"), F.struct(F.col("load_seq").alias("n"), F.lit(True).alias("b")).alias("a"))), ".json")


def read_docx_files(spark, sf):
    return _read(spark, _manifest(spark, sf), _docx("lines"), ".docx")


def read_xlsx_files(spark, sf):
    return _read(spark, _manifest(spark, sf), _xlsx("lines"), ".xlsx")


def read_limited_files(spark, sf):
    """CSV files under limits: two cells of a row, ten characters of a cell."""
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    return _read(spark, _manifest(spark, sf), body, ".csv", files.Limits(cells=2, width=10))


SUFFIXES = (".txt", ".MD", ".csv", ".json", ".png", ".xyz", ".pdf.bak", ".jpeg")


def scanned_types(spark, sf):
    """Files of many suffixes, by type and status, from two scans: all, and those of one suffix."""
    where = scratch(spark, "types")
    rows = table(spark, sf, "manifest").select("load_seq", "title")
    name = F.concat(F.col("load_seq").cast("string"), F.element_at(F.array(*(F.lit(s) for s in SUFFIXES)), (F.col("load_seq") % len(SUFFIXES) + 1).cast("int")))
    sinks.write_files(rows.select(name.alias("name"), F.lit('{"a": 1}').alias("content")), where)
    every = files.read_documents(files.scan(spark, where)).groupBy("source_type", "status").agg(F.count("*").alias("n")).withColumn("scan", F.lit("all"))
    some = files.scan(spark, where, glob="*.csv").groupBy("source_type").agg(F.count("*").alias("n")).withColumn("status", F.lit("")).withColumn("scan", F.lit("csv"))
    missing = files.scan_items(spark, f"{where}/none").groupBy("source_type", F.col("error").alias("status")).agg(F.count("*").alias("n")).withColumn("scan", F.lit("missing"))
    return every.unionByName(some).unionByName(missing)


def text_blocks(spark, sf):
    """Texts in blocks of 500, as places and hashes."""
    b = files.text_blocks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 500)
    return b.select("doc_id", "block_no", "start", F.sha2("block", 256).alias("block_hash"))


def folder_verdicts(spark, sf):
    """Files with secrets and of barred names: what was found in each, and what was not looked through."""
    where = scratch(spark, "verdicts")
    n = F.col("load_seq") % 5
    body = F.when(n == 0, "password = hunter2").when(n == 1, "write to a@b.example").when(n == 2, "nothing to see").when(n == 3, "-----").otherwise("x")
    name = F.concat(F.col("load_seq").cast("string"), F.when(n < 3, ".txt").when(n == 3, ".pem").otherwise(".rst"))
    sinks.write_files(table(spark, sf, "manifest").select(name.alias("name"), body.alias("content")), where)
    listed = files.scan(spark, where).withColumn("document_id", F.regexp_extract("path", r"([0-9]+)\.[^/]*$", 1))
    read = files.read_documents(listed.drop("document_id")).withColumn("document_id", F.regexp_extract("path", r"([0-9]+)\.[^/]*$", 1))
    found = preflight.findings(listed, read.where("status = 'parsed'"), "document_id")
    passed = preflight.skipped(listed, preflight.unlisted(spark, where).withColumn("document_id", F.lit("")), "document_id")
    counted = found.unionByName(passed.select("document_id", F.lit(None).cast("int").alias("line"), "type", "severity", F.col("reason").alias("match")))
    got = P.verdicts(counted, listed.select("document_id"), "document_id")
    return got.select(F.col("document_id").cast("long").alias("load_seq"), "high", "medium", "low", "status")


def dataset_checks(spark, sf):
    """A dataset's files against its manifest: some altered, some missing, some of another type, some without licence."""
    where = scratch(spark, "dataset")
    m = table(spark, sf, "manifest").select("load_seq", F.coalesce("title", F.lit("")).alias("title"), "license_status")
    n = F.col("load_seq") % 4
    name = F.concat(F.col("load_seq").cast("string"), F.when(n == 2, ".md").otherwise(".txt"))
    sinks.write_files(m.where(n != 3).select(name.alias("name"), F.when(n == 1, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("content")), where)
    manifest = m.select(name.alias("local_path"), F.sha2("title", 256).alias("sha256"), F.lit("text").alias("file_type"), "license_status")
    read = files.scan(spark, where).select("path", F.sha2("content", 256).alias("sha256"), "source_type", "length")
    bad = E.dataset_problems(manifest, read)
    return bad.unionByName(E.unlicensed(manifest, ("approved_public_license", "project_created")))


def questionnaire_problems(spark, sf):
    """The drafts as a questionnaire file."""
    where = scratch(spark, "questionnaire")
    d = table(spark, sf, "questionnaire_draft").select(F.col("question_id"), F.col("original_question").alias("question"))
    sinks.write_csv(d, where, single=True)
    got = A.questionnaire(spark, where, most=None, width=60)
    return got.groupBy("question_id", "problem").agg(F.count("*").alias("n"))


def review_files(spark, sf):
    """Review files written and read again, every column."""
    where = scratch(spark, "reviews")
    sinks.write_csv(table(spark, sf, "review_items").select(*REVIEW_FIELDS), where)
    return A.review_csv(spark, where).select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("finding_id", "category", "evidence_level", "review_status", "reviewed_at")))


def training_files(spark, sf):
    """Findings as training items in CSV."""
    where = scratch(spark, "training")
    rows = table(spark, sf, "review_items").select(F.lit(None).cast("string").alias("item_id"), TX.collapse("finding").alias("text"), F.col("category").alias("label"))
    sinks.write_csv(rows, f"{where}/items.csv")
    return A.training_items(spark, f"{where}/items.csv").select("item_id", F.coalesce("label", F.lit("")).alias("label"))


def feature_files(spark, sf):
    """Feature records as JSON lines."""
    where = scratch(spark, "features")
    f = S.item_features(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    flags = [c for c in f.columns if c != "doc_id"]
    sinks.write_json(f.select(F.lit("feature").alias("record_type"), F.col("doc_id").cast("string").alias("item_id"), F.struct(*flags).alias("features")), where)
    return A.json_objects(spark, where, A.FEATURES, lines=True).select(F.col("item_id").cast("long").alias("doc_id"), "features.word_count", "features.has_date", "features.has_review_terms")


def ledger_files(spark, sf):
    """Events written as a ledger of JSON lines and read again."""
    where = scratch(spark, "ledger")
    e = table(spark, sf, "events")
    rows = e.select(F.lit("1").alias("schema_version"), F.col("event_id").cast("int").alias("sequence"), F.col("user_id").cast("string").alias("tenant_id"), "event_type", F.create_map(F.lit("props"), F.col("props")).alias("details"))
    sinks.write_json(rows, where, "append")
    return A.json_objects(spark, where, A.LEDGER, lines=True).select("sequence", "tenant_id", "event_type", F.element_at("details", F.lit("props")).alias("props"))


def catalog_edges(spark, sf):
    """Controls and their edges from a catalog file."""
    where = scratch(spark, "catalog")
    controls = spark.createDataFrame(CONTROLS, "control_id string, keywords array<string>, maps_to array<string>")
    one = controls.groupBy().agg(F.array_sort(F.collect_list(F.struct("control_id", "keywords", "maps_to"))).alias("controls")).select(F.lit("cat").alias("catalog_id"), "controls")
    sinks.write_json(one.coalesce(1), where)
    return A.control_catalog(spark, [where])[1]


def evidence_store_problems(spark, sf):
    known = spark.createDataFrame([(f"SCRM-{i:02d}",) for i in range(1, 9)], "control_id string")
    bad = A.evidence_problems(table(spark, sf, "evidence_record").select("evidence_id", "sha256", "mapped_controls"), known)
    return bad.select("evidence_id", F.array_join("violations", "|").alias("violations"))


def vault_tables(spark, sf):
    """Clients through an SQLite file."""
    rows = table(spark, sf, "clients").select("client_id", "home_zone", "sector").limit(10_000).collect()
    with tempfile.TemporaryDirectory() as where:
        with sqlite3.connect(f"{where}/vault.db") as c:
            A.create_vault(c)
            c.executemany("insert into suppliers (supplier_id, name, criticality) values (?, ?, ?)", [tuple(r) for r in rows])
        return A.sqlite_table(f"{where}/vault.db", "suppliers", spark).select("supplier_id", "name", "criticality")


def csv_cells(spark, sf):
    """Cells that a spreadsheet would take for formulas, written and read again."""
    where = scratch(spark, "cells")
    signs = F.element_at(F.array(*(F.lit(x) for x in ("=", "+", "-", "@", "x"))), (F.col("load_seq") % 5 + 1).cast("int"))
    rows = table(spark, sf, "review_items").select("load_seq", F.concat(signs, F.coalesce("category", F.lit(""))).alias("cell"), F.array("category", "status").alias("list"))
    sinks.write_csv(rows, where)
    back = spark.read.schema("load_seq long, cell string, list string").option("header", True).option("escape", '"').csv(where)
    return back.select("load_seq", "cell", F.coalesce("list", F.lit("")).alias("list"))


def dual_writes(spark, sf):
    """Full records in one place, chosen columns in another."""
    private, open_ = scratch(spark, "private"), scratch(spark, "shareable")
    sinks.dual_write(table(spark, sf, "evidence_record").select("load_seq", "evidence_id", "source_path"), private, open_, ["load_seq", "evidence_id"])
    a, b = spark.read.json(private), spark.read.json(open_)
    return b.select("load_seq", "evidence_id", F.lit("shareable").alias("place")).unionByName(a.where("source_path is not null").select("load_seq", "evidence_id", F.lit("private").alias("place")))


def report_lines(spark, sf):
    """A Markdown report of regions and nations, line by line."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    text = sinks.markdown_report("Places", {"Regions": r.select("r_regionkey", "r_name").orderBy("r_regionkey"), "Nations": n.select("n_nationkey", "n_name").orderBy("n_nationkey")})
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string")


def report_page(spark, sf):
    """The same as HTML paragraphs."""
    r = table(spark, sf, "region")
    page = sinks.html_report(sinks.markdown_report("Places & more", {"Regions": r.select("r_regionkey", "r_name").orderBy("r_regionkey")}))
    return spark.createDataFrame([(x,) for x in page.split("\n") if x.startswith("<p>#")], "line string")


def bundle_hashes(spark, sf):
    """A bundle of two tables with the hashes that its manifest has."""
    import hashlib
    import json

    with tempfile.TemporaryDirectory() as where:
        sinks.bundle(f"{where}/out", {"regions": table(spark, sf, "region").select("r_name").orderBy("r_regionkey"), "clients": table(spark, sf, "clients").select("client_id").orderBy("client_id")}, {"made": "here"})
        manifest = json.load(open(f"{where}/out/manifest.json", encoding="utf-8"))
        rows = []
        for n in ("clients", "regions"):
            body = open(f"{where}/out/{n}.json", "rb").read()
            rows.append((n, len(json.loads(body)), hashlib.sha256(body).hexdigest() == manifest["sha256"][n]))
    return spark.createDataFrame(rows, "name string, n long, ok boolean")


QUERIES = {
    f.__name__: f
    for f in (
        read_text_files, read_csv_files, read_json_files, read_docx_files, read_xlsx_files, read_limited_files, scanned_types, text_blocks, folder_verdicts, dataset_checks, questionnaire_problems, review_files, training_files,
        feature_files, ledger_files, catalog_edges, evidence_store_problems, vault_tables, csv_cells, dual_writes, report_lines, report_page, bundle_hashes,
    )
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_LINES = "ln as (select load_seq, [" + ", ".join(f"coalesce({K.collapse(c)}, '')" for c in PARTS) + "] as l from manifest)"
_SOME = "list_filter(l, lambda x: x <> '')"


def _files_sql(kind: str, body: str, status: str = "parsed") -> str:
    return f"with {_LINES} select load_seq, {kind} as source_type, '{status}' as status, sha256({body}) as text_hash from ln"


_FEATURES = ", ".join(f"{K.any_hit('low', [t.casefold().replace('ß', 'ss') for t in terms])} as {name}" for name, terms in S.L.ITEM_FEATURES.items())
_DAY = r"\b(19|20)\d{2}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.(19|20)\d{2}\b"
_CASE = " ".join(f"when {i} then '{t}'" for i, t in enumerate(("text", "markdown", "csv", "json", "image", "unsupported", "unsupported", "image")))

SQL = {
    "read_text_files": _files_sql("case when load_seq % 2 = 0 then 'text' else 'markdown' end", "array_to_string(l, chr(10))"),
    "read_csv_files": _files_sql("'csv'", f"'a | b' || case when len({_SOME}) > 0 then chr(10) || array_to_string({_SOME}, ' | ') else '' end"),
    "read_json_files": _files_sql("'json'", "array_to_string(['a', 'b', 'true', 'n', load_seq::varchar, 'z'] || l, chr(10))"),
    "read_docx_files": _files_sql("'docx'", f"array_to_string({_SOME}, chr(10))"),
    "read_xlsx_files": _files_sql("'xlsx'", f"array_to_string({_SOME} || ['end', '7'], chr(10))"),
    "read_limited_files": _files_sql("'csv'", "array_to_string(list_filter(list_transform(l[1:2], lambda x: case when length(x) > 10 then regexp_replace(left(x, 7), ' +$', '') || '...' else x end), lambda x: x <> ''), ' | ')"),
    "scanned_types": f"with t as (select case load_seq % 8 {_CASE} end as source_type, load_seq from manifest) select source_type, case source_type when 'image' then 'ocr_required' when 'unsupported' then 'unsupported' else 'parsed' end as status, count(*) as n, 'all' as scan from t group by all union all select 'csv', '', count(*), 'csv' from t where source_type = 'csv' union all select '', 'missing_input', 1, 'missing'",
    "text_blocks": "select doc_id, (k // 500)::int as block_no, k::int as \"start\", sha256(substr(text, k::int + 1, 500)) as block_hash from (select doc_id, text, unnest(range(0, length(text), 500)) as k from documents where length(text) > 0)",
    "folder_verdicts": "select load_seq, (n = 0 or n = 3)::bigint as high, (n = 1)::bigint as medium, 0::bigint as low, case n when 0 then 'block' when 3 then 'block' when 1 then 'warn' else 'pass' end as status from (select load_seq, load_seq % 5 as n from manifest)",
    "dataset_checks": "with m as (select load_seq::varchar || case when load_seq % 4 = 2 then '.md' else '.txt' end as local_path, load_seq % 4 as n, license_status from manifest) select local_path, case n when 1 then 'hash' when 2 then 'type' else 'missing' end as problem from m where n <> 0 union all select local_path, 'licence' from m where coalesce(license_status, '') not in ('approved_public_license', 'project_created')",
    "questionnaire_problems": f"with q as (select trim(question_id) as question_id, coalesce({K.collapse('original_question')}, '') as q, count(*) over (partition by trim(question_id)) as c from questionnaire_draft) select question_id, case when q = '' then 'blank' when length(q) > 60 then 'too_long' when c > 1 then 'repeated_id' end as problem, count(*) as n from q group by all",
    "review_files": "select " + ", ".join(f"case when regexp_matches({c}, '^({K.SPACE})?[=+@-]') then '''' || {c} else coalesce({c}, '') end as {c}" for c in ("finding_id", "category", "evidence_level", "review_status", "reviewed_at")) + " from review_items",
    "training_files": f"select 'item-' || left(sha256(coalesce(nullif({K.collapse('finding')}, ''), '') || chr(10) || coalesce(category, '')), 12) as item_id, coalesce(category, '') as label from review_items",
    "feature_files": f"select doc_id, len({K.tokens('text')})::int as word_count, regexp_matches(coalesce(text, ''), '{_DAY}') as has_date, has_review_terms from (select *, {_FEATURES} from (select *, {K.casefold('coalesce(text, $$$$)')} as low from documents))".replace("$$$$", "''"),
    "ledger_files": "select event_id::int as sequence, user_id::varchar as tenant_id, event_type, props from events",
    "catalog_edges": f"select * from {K.values([(a, b) for a, _, bs in CONTROLS for b in bs], 'source, target')}",
    "evidence_store_problems": "with r as (select evidence_id from evidence_record group by 1 having count(*) > 1), u as (select distinct evidence_id from (select evidence_id, unnest(mapped_controls) as c from evidence_record) where c not in (" + ", ".join(f"'SCRM-{i:02d}'" for i in range(1, 9)) + ")), b as (select e.evidence_id, list_filter([case when coalesce(trim(e.evidence_id), '') = '' then 'id' end, case when r.evidence_id is not null then 'unique' end, case when not coalesce(regexp_matches(sha256, '^[0-9a-f]{64}$'), false) then 'sha256' end, case when u.evidence_id is not null then 'controls' end], lambda x: x is not null) as v from evidence_record e left join r using (evidence_id) left join u using (evidence_id)) select distinct evidence_id, array_to_string(v, '|') as violations from b where len(v) > 0",
    "vault_tables": "select client_id as supplier_id, home_zone as name, sector as criticality from clients",
    "csv_cells": "select load_seq, case when load_seq % 5 < 4 then '''' else '' end || (['=', '+', '-', '@', 'x'])[load_seq % 5 + 1] || coalesce(category, '') as cell, array_to_string(list_filter([category, status], lambda x: x is not null), ';') as list from review_items",
    "dual_writes": "select load_seq, evidence_id, 'shareable' as place from evidence_record union all select load_seq, evidence_id, 'private' from evidence_record where source_path is not null",
    "report_lines": "with r as (select row_number() over (order by r_regionkey) as i, r_regionkey, r_name from region), c as (select count(*) as k from region), n as (select row_number() over (order by n_nationkey) as i, n_nationkey, n_name from nation), d as (select count(*) as k from nation) select * from (values (0, '# Places'), (1, ''), (2, '## Regions'), (3, ''), (4, '| r_regionkey | r_name |'), (5, '|---|---|')) v(line_no, line) union all select 5 + i, '| ' || r_regionkey || ' | ' || r_name || ' |' from r union all select 6 + k + x, y from c, (values (0, ''), (1, '## Nations'), (2, ''), (3, '| n_nationkey | n_name |'), (4, '|---|---|')) w(x, y) union all select 10 + k + i, '| ' || n_nationkey || ' | ' || n_name || ' |' from n, c union all select 11 + c.k + d.k, '' from c, d",
    "report_page": "select '<p># Places &amp; more</p>' as line union all select '<p>## Regions</p>'",
    "bundle_hashes": "select 'regions' as name, count(*) as n, true as ok from region union all select 'clients', count(*), true from clients",
}
