"""What of a folder's files is looked through for sensitive values, and a finding for each file that is not, or not wholly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidloom.functions import patterns as P
from evidloom.sources import files

# Suffixes of plain text, of inputs that are never allowed, and marks of names that hold secrets.
TEXT = (".csv", ".json", ".md", ".markdown", ".rst", ".txt", ".yaml", ".yml")
FORBIDDEN = (
    ".db", ".sqlite", ".sqlite3", ".mdb", ".accdb", ".dbf", ".zip", ".rar", ".7z", ".tar", ".gz", ".tgz", ".bz2", ".xz",
    ".key", ".pem", ".pfx", ".p12", ".p8", ".crt", ".cer", ".der", ".jks", ".keystore", ".asc", ".gpg", ".ppk",
)
SECRET_NAMES = (".env", "credential", "private-config", "secret")
MAX_BINARY = 25_000_000


def _name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _suffix(path: Column) -> Column:
    return F.regexp_extract(_name(path), r".(\.[^.]+)$", 1)


def barred(path: Column) -> Column:
    """secret_file or forbidden_input for a file that is not to be read, judged by its name; else null."""
    named = F.lit(False)
    for mark in SECRET_NAMES:
        named = named | _name(path).contains(mark)
    return F.when(named, "secret_file").when(_suffix(path).isin(*FORBIDDEN), "forbidden_input")


def unlisted(spark: SparkSession, root: str, skip: tuple[str, ...] = files.SKIPPED_DIRECTORIES) -> DataFrame:
    """(path, length) of files that files.scan() has no row for: hidden ones (the name, or a folder's below root, begins
    with a dot or underscore) and those of no bytes whose name is barred. Directories in `skip` are left out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(top).toString().rstrip("/")
    out, walk = [], system.listFiles(top, True)
    while walk.hasNext():
        status = walk.next()
        path = status.getPath().toString()
        parts = path[len(base) :].strip("/").split("/") if path != base else [path.rpartition("/")[2]]
        hidden = any(p.startswith((".", "_")) for p in parts)
        if not any(p in skip for p in parts[:-1]) and (hidden or status.getLen() == 0):
            out.append((path, status.getLen(), hidden))
    found = spark.createDataFrame(out, "path string, length long, hidden boolean")
    return found.where(F.col("hidden") | barred(F.col("path")).isNotNull()).select("path", "length")


@F.pandas_udf(T.StringType())
def _decoded(kind: pd.Series, content: pd.Series) -> pd.Series:
    def one(k, c):
        try:
            if k == "json" and b"\\" in c:
                return files.json_text(bytes(c), files.WHOLE)[0]
            if k == "csv" and b'"' in c:
                return files.csv_text(bytes(c), files.WHOLE)[0]
        except Exception:  # noqa: BLE001  what cannot be parsed is looked through as it is
            pass
        return None

    return pd.Series([None if k is None or c is None else one(k, c) for k, c in zip(kind, content, strict=True)], dtype=object)


def findings(scanned: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """(key, line, type, severity, match) of the sensitive values in scanned files (key, path, length, content,
    source_type), whole files and whole lines.

    Every file that is not barred, no image and at most MAX_BYTES long is looked through as it is, unless it holds a NUL
    byte; bytes that are not UTF-8 are replaced. CSV with quotes and JSON with escapes are also looked through decoded,
    and `parsed` (key, text) has the text of office files and PDF; values found only there have no line if decoded.
    """
    office = F.col("source_type").isin("docx", "xlsx", "pdf", "image")
    open_ = scanned.where(barred(F.col("path")).isNull() & (F.col("length") <= files.MAX_BYTES))
    raw = open_.where(~office).select(key, F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(~F.col("text").contains("\x00"))
    own = P.scan_lines(raw, key, "text")
    quoted = open_.where(F.col("source_type").isin("csv", "json")).select(key, _decoded("source_type", "content").alias("text")).where("text is not null")
    more = P.scan_lines(quoted, key, "text").join(own.select(key, "type", "match"), [key, "type", "match"], "left_anti")
    inner = parsed.join(open_.where(office).select(key), key, "left_semi")
    return own.unionByName(more.select(key, F.lit(None).cast("int").alias("line"), "type", "severity", "match")).unionByName(P.scan_lines(inner, key, "text"))


def skipped(scanned: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """(key, path, type, severity, reason) of each file that was not looked through, or only in part.

    high: barred names, and files of over MAX_BINARY bytes that are no text. low: the others, among them office files,
    of which only the body was looked through, and text of an unknown kind or not UTF-8, which was.
    """
    text = _suffix(F.col("path")).isin(*TEXT)
    plain = F.col("content").cast("string")
    reason = (
        F.when(~text & (F.col("length") > MAX_BINARY), "oversize_binary").when(F.col("source_type") == "image", "image_ocr_required").when(~text, "unsupported_type")
        .when(F.col("length") > files.MAX_BYTES, "too_large").when(F.make_valid_utf8(plain).contains("\x00"), "binary_content")
        .when(~F.is_valid_utf8(plain), "not_utf8")
    )
    rows = scanned.select(key, "path", F.coalesce(barred(F.col("path")), reason).alias("reason")).unionByName(hidden.select(key, "path", F.coalesce(barred(F.col("path")), F.lit("hidden_file")).alias("reason")))
    kind = F.when(F.col("reason") == "secret_file", "secret").when(F.col("reason").isin("forbidden_input", "oversize_binary"), "forbidden_binary").otherwise("unsupported")
    return rows.where("reason is not null").select(key, "path", kind.alias("type"), F.when(kind == "unsupported", "low").otherwise("high").alias("severity"), "reason")
