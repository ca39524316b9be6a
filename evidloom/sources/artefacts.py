"""Readers of structured inputs. Every schema is explicit; nothing is inferred."""

from __future__ import annotations

import csv
import io
import sqlite3
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidloom.functions import text as TX
from evidloom.operators.constraints import duplicate_keys, failing, missing_targets, require
from evidloom.session import materialize

EVIDENCE = (
    "evidence_id string, type string, source_path string, source_type string, source_report string, source_finding_id string, sha256 string, mapped_controls array<string>, claims array<string>, "
    "validity string, review_status string, review_required boolean, requires_human_review boolean"
)
CATALOG = "catalog_id string, title string, version string, controls array<struct<control_id:string,framework:string,title:string,summary:string,required_evidence:array<string>,keywords:array<string>,maps_to:array<string>>>"
CROSS_MAP = "map_id string, version string, mappings array<struct<source_control_id:string,maps_to:array<string>,relationship:string>>"
FEATURES = (
    "record_type string, feature_schema_version string, item_id string, item_type string, source_ref string, text_hash string, features struct<word_count:int,has_date:boolean,has_policy_owner:boolean,"
    "has_backup_terms:boolean,has_incident_terms:boolean,has_supplier_terms:boolean,has_review_terms:boolean,contains_future_tense:boolean,contains_negative_phrase:boolean,read_error:boolean>, warnings array<string>"
)
TRAINING = "items array<struct<item_id:string,text:string,label:string>>"
MANIFEST = (
    "dataset_id string, reference_status string, expected_cases_path string, sources array<struct<source_id:string,title:string,publisher:string,public_url:string,retrieved_at:string,document_version:string,"
    "sha256:string,file_type:string,source_class:string,license_status:string,local_path:string,known_limitations:array<string>>>"
)
CASES = (
    "cases array<struct<case_id:string,source_id:string,expected_control:string,expected_text:string,expected_page:int,expected_evidence_status:string,allowed_statement:string,forbidden_statement:string,"
    "expected_confidence_category:string,rationale:string,reviewer:string,review_status:string,reviewed_at:string,second_review:string>>"
)
LEDGER = "schema_version string, sequence int, timestamp string, tenant_id string, actor_id string, role string, run_id string, event_type string, previous_hash string, details map<string,string>, event_hash string"
ANSWERS = (
    "answers array<struct<question_cluster:string,canonical_question:string,answer_de:string,answer_en:string,evidence_refs:array<string>,review_status:string,reviewer:string,reviewed_at:string,"
    "valid_until:string,confidence:double,source_case_id:string>>"
)


def json_objects(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON objects with a fixed schema; one that does not parse stops the read."""
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def nested(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The entries of an array of objects as rows."""
    return json_objects(spark, path, schema).select(F.explode(field).alias("_x")).select("_x.*")


def evidence_store(spark: SparkSession, path: str) -> DataFrame:
    return nested(spark, path, f"schema_version string, evidence array<struct<{EVIDENCE.replace(' ', ':').replace(',:', ',')}>>", "evidence")


def control_catalog(spark: SparkSession, paths: list[str], cross_map: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(controls, edges): controls of all catalogs, and (source, target) pairs from both the controls and the map."""
    controls = json_objects(spark, paths, CATALOG).select("catalog_id", F.explode("controls").alias("_c")).select("catalog_id", "_c.*")
    edges = controls.select(F.col("control_id").alias("source"), F.explode("maps_to").alias("target"))
    if cross_map:
        mapped = json_objects(spark, cross_map, CROSS_MAP).select(F.explode("mappings").alias("_m"))
        edges = edges.unionByName(mapped.select(F.col("_m.source_control_id").alias("source"), F.explode("_m.maps_to").alias("target")))
    return controls, edges.distinct()


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def _csv_rows(content: pd.Series) -> pd.Series:
    return pd.Series([[{k: v for k, v in row.items() if isinstance(k, str) and isinstance(v, str)} for row in csv.DictReader(io.StringIO(bytes(c).decode("utf-8-sig", "replace"), newline=""))] for c in content], dtype=object)


def questionnaire(spark: SparkSession, path: str, most: int | None = 300, width: int | None = 600) -> DataFrame:
    """(question_id, question, problem): ids from question_id or id, else numbered within the file; a blank or too long
    question, an id repeated in the file, and rows beyond `most` are problems (None: no limit).

    A file is one row of a binary scan, so its rows keep their order and files are read in parallel; a single file should
    fit into one task.
    """
    header = spark.read.option("header", True).csv(path).columns
    if "question" not in header:
        raise ValueError("the column question is required")
    files = spark.read.format("binaryFile").load(path).select("path", _csv_rows("content").alias("_rows"))
    own = [F.nullif(F.trim(F.element_at("_r", F.lit(c))), F.lit("")) for c in ("question_id", "id") if c in header]
    each = files.select("path", F.posexplode("_rows").alias("_i", "_r"))
    n = F.col("_i") + 1
    rows = each.select("path", n.alias("_n"), F.coalesce(*own, F.format_string("question_%03d", n)).alias("question_id"), TX.collapse(F.coalesce(F.element_at("_r", F.lit("question")), F.lit(""))).alias("question"))
    repeated = F.count("*").over(Window.partitionBy("path", "question_id")) > 1
    many = F.lit(False) if most is None else F.col("_n") > most
    long = F.lit(False) if width is None else F.char_length("question") > width
    problem = F.when(many, "too_many").when(F.col("question") == "", "blank").when(long, "too_long").when(repeated, "repeated_id")
    return rows.withColumn("problem", problem).drop("_n", "path")


def review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A review file of 13 columns with a header, as strings."""
    from evidloom.operators.rowparse import REVIEW_FIELDS

    schema = ", ".join(f"{c} string" for c in REVIEW_FIELDS)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def training_items(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(item_id, text, label) from JSON or CSV; item ids default to a hash of text and label. With `strict` a blank text or
    label raises ConstraintError."""
    if path.endswith(".csv"):
        rows = spark.read.schema("item_id string, text string, label string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        rows = nested(spark, path, TRAINING, "items")
    if strict:
        require(failing(rows, text=F.trim("text") != "", label=F.trim("label") != ""), "a training item is incomplete")
    return rows.withColumn("item_id", F.coalesce(F.nullif(F.trim("item_id"), F.lit("")), TX.stable_id("item-", [F.col("text"), F.col("label")], 12)))


def evidence_problems(store: DataFrame, controls: DataFrame) -> DataFrame:
    """(evidence_id, violations): entries of an evidence store whose id is blank or repeated, whose hash is none, or that
    name a control the catalog (control_id) lacks."""
    repeated = duplicate_keys(store, "evidence_id").select(F.col("evidence_id").alias("_id"))
    named = store.select("evidence_id", F.explode("mapped_controls").alias("_c"))
    unknown = missing_targets(named, "_c", controls, "control_id").select(F.col("evidence_id").alias("_u")).distinct()
    j = store.join(repeated, F.col("evidence_id").eqNullSafe(F.col("_id")), "left").join(unknown, F.col("evidence_id").eqNullSafe(F.col("_u")), "left")
    bad = failing(j, id=F.trim("evidence_id") != "", unique=F.col("_id").isNull(), sha256=F.col("sha256").rlike("^[0-9a-f]{64}$"), controls=F.col("_u").isNull())
    return bad.select("evidence_id", "violations").distinct()


# The tables of a vault of answers, as they are created in an SQLite file.
VAULT = {
    "suppliers": "supplier_id text primary key, name text not null, criticality text",
    "questions": "question_id text primary key, question_cluster text not null, canonical_question text not null",
    "answers": "answer_id text primary key, question_cluster text not null, answer_de text, answer_en text, review_status text not null, reviewer text, reviewed_at text, valid_until text, confidence real, source_case_id text, first_seen text",
    "answer_versions": "answer_id text not null, version_no integer not null, answer_de text, answer_en text, replaced_at text, primary key (answer_id, version_no)",
    "evidence_refs": "answer_id text not null, evidence_id text not null, primary key (answer_id, evidence_id)",
}


def create_vault(connection: sqlite3.Connection) -> None:
    """The tables of VAULT in an open database; those that exist stay."""
    for name, columns in VAULT.items():
        connection.execute(f"create table if not exists {name} ({columns})")


SQLITE_PAGE = 50_000  # rows that the driver holds at once


def sqlite_table(path: str, name: str, spark: SparkSession) -> DataFrame:
    """One table of a SQLite file, which is local to the driver. It is read a page at a time, and each page is written to
    shared storage before the next, so the driver never holds more than SQLITE_PAGE rows."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        known = {r[0] for r in c.execute("select name from sqlite_master where type = 'table'")}
        if name not in known:
            raise ValueError(f"no table {name}")
        cursor = c.execute(f'select * from "{name}"')
        types = {r[1]: {"INTEGER": "bigint", "REAL": "double"}.get(r[2].upper(), "string") for r in c.execute(f'pragma table_info("{name}")')}
        schema = ", ".join(f"`{d[0]}` {types.get(d[0], 'string')}" for d in cursor.description)
        pages = [spark.createDataFrame([], schema)]
        while page := cursor.fetchmany(SQLITE_PAGE):
            pages.append(materialize(spark.createDataFrame(page, schema), f"sqlite-{name}"))
        return reduce(DataFrame.unionByName, pages)
