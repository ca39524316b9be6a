"""Writers of results: data with Spark, bounded reports on the driver."""

from __future__ import annotations

import html
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evidloom.functions.text import guard_formula, stable_id

REPORT_ROWS = 10_000  # rows that a report on the driver holds at most


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; arrays joined by a semicolon, cells guarded against formulas."""
    columns = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.array_join(F.col(f.name).cast("array<string>"), ";") if kind.startswith("array") else F.col(f.name).cast("string")
        columns.append(guard_formula(c).alias(f.name))
    out = df.select(*columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_files(df: DataFrame, directory: str, name: str = "name", content: str = "content") -> None:
    """Each row as a file of its own, written by the tasks and put in place by a rename, so that a repeated task does no
    harm. directory: a URI that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{root}/.{n}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(c)
                store.move(part, f"{root}/{n}")
            yield b.select([0])

    df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """(position, columns...) in an order, from 1: sorted by ranges over all tasks and numbered without gathering rows."""
    ordered = df.orderBy(*order)
    schema = StructType([StructField("position", LongType(), False), *ordered.schema.fields])
    return df.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda r: (r[1] + 1, *r[0])), schema)


# What a finding's quality means for its review.
QUALITY_STATES = {"strong": "reviewed", "medium": "needs_review", "weak": "needs_review", "warning": "needs_evidence"}


def review_export(evidence: DataFrame, key: str) -> DataFrame:
    """The 13 columns of a review file from evidence rows (key, category, quality, citation, pos), a stable id for each;
    the review's own columns are empty. Rows that are written go through write_csv()."""
    low = F.replace("category", F.lit("_"), F.lit(" "))
    human = F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, F.lit(2), F.char_length(low)))
    states = F.create_map(*(F.lit(x) for kv in QUALITY_STATES.items() for x in kv))
    check = F.when(F.col("quality") == "strong", "Confirm that the source is current").when(F.col("quality") == "warning", "Ask for evidence that is free of the warning").otherwise("Look for a stronger source")
    blank = F.lit("")
    document = F.col(key).cast("string")
    return evidence.select(
        stable_id("F-", [document, F.col("category"), F.col("pos")], 12).alias("finding_id"), human.alias("category"), F.col("category").alias("control_area"), document.alias("document"), F.col("quality").alias("evidence_level"),
        F.coalesce(F.try_element_at(states, "quality"), F.lit("open")).alias("status"), F.col("citation").alias("finding"), check.alias("recommended_manual_check"), F.concat(document, F.lit(":"), F.col("pos").cast("string")).alias("source_reference"),
        F.lit("open").alias("review_status"), blank.alias("review_note"), blank.alias("reviewer"), blank.alias("reviewed_at"),
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; with mode `append` a ledger that grows."""
    df.write.mode(mode).json(path)


def dual_write(df: DataFrame, private: str, shareable: str, columns: list[str]) -> None:
    """Full records to one place, chosen columns to another."""
    df.write.mode("append").json(private)
    df.select(*columns).write.mode("append").json(shareable)


def rows_of(df: DataFrame, most: int = REPORT_ROWS) -> list[dict]:
    """The rows of a report; more than `most` are refused, not cut."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return [r.asDict(recursive=True) for r in got]


def markdown_table(rows: list[dict]) -> str:
    """A Markdown table; bars and line ends in cells are escaped."""
    if not rows:
        return "_no rows_\n"
    names = list(rows[0])

    def cell(v: object) -> str:
        text = ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v)
        return text.replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows]) + "\n"


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(rows_of(df))}" for name, df in sections.items())


def html_report(markdown: str) -> str:
    """Paragraphs of escaped text."""
    body = "\n".join(f"<p>{html.escape(p)}</p>" for p in markdown.split("\n\n") if p.strip())
    return f'<!doctype html>\n<html><head><meta charset="utf-8"></head><body>\n{body}\n</body></html>\n'


def write_text(path: str, text: str) -> None:
    """A text file on the driver, put in place by a rename."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "x", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def staged(directory: str, fill: Callable[[str], None], allowed: set[str] | None = None) -> None:
    """A directory that appears whole or not at all: filled beside its place, then renamed. An existing one must be
    empty or hold only `allowed` names."""
    if os.path.exists(directory):
        strange = sorted(set(os.listdir(directory)) - (allowed or set()))
        if strange:
            raise FileExistsError(f"{directory} holds {strange[:3]}")
    pending = f"{directory.rstrip('/')}.{uuid.uuid4().hex}.pending"
    os.makedirs(pending)
    try:
        fill(pending)
        if os.path.exists(directory):
            shutil.rmtree(directory)
        os.replace(pending, directory)
    finally:
        shutil.rmtree(pending, ignore_errors=True)


def bundle(directory: str, tables: dict[str, DataFrame], manifest: dict, inputs: tuple[str, ...] = ()) -> None:
    """Several small tables as JSON files and a manifest of their hashes, written together. Inputs inside the output are
    refused."""
    import hashlib

    inside = os.path.realpath(directory)
    for i in inputs:
        if os.path.commonpath([inside, os.path.realpath(i)]) == inside:
            raise ValueError(f"the input {i} lies inside the output")

    def fill(where: str) -> None:
        hashes = {}
        for name, df in tables.items():
            text = json.dumps(rows_of(df), indent=2, sort_keys=True, default=str) + "\n"
            hashes[name] = hashlib.sha256(text.encode()).hexdigest()
            write_text(f"{where}/{name}.json", text)
        write_text(f"{where}/manifest.json", json.dumps(manifest | {"sha256": hashes}, indent=2, sort_keys=True) + "\n")

    staged(directory, fill, {f"{n}.json" for n in (*tables, "manifest")})
