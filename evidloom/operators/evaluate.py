"""Results held against expectations: per document, over all documents, and as a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.operators.rollup import ratio

_NONE = "array<string>"


def evaluate_documents(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row per expected document: which categories it lacks, which it must not have, whether enough evidence was
    found and which terms are missing; `passed` if nothing is wrong. A document without any result has none of what was
    expected.

    expected: key, categories, forbidden, terms (arrays, null being empty) and least (number of evidence rows);
    found: key, category, passage. Results of documents nobody expects are ignored.
    """
    per = found.groupBy(key).agg(F.collect_set("category").alias("_cats"), F.count("*").alias("_n"))
    asked = expected.select(key, F.explode(F.array_distinct("terms")).alias("_term"))
    said = found.join(asked, key).where(F.contains(F.lower("passage"), F.lower("_term"))).groupBy(key).agg(F.collect_set("_term").alias("_said"))
    j = expected.join(per, key, "left").join(said, key, "left")
    arr = lambda c: F.coalesce(F.col(c), F.array().cast(_NONE))
    out = j.select(
        key,
        F.array_sort(F.array_except(arr("categories"), arr("_cats"))).alias("missing"),
        F.array_sort(F.array_intersect(arr("forbidden"), arr("_cats"))).alias("forbidden_found"),
        F.array_sort(F.array_except(arr("terms"), arr("_said"))).alias("missing_terms"),
        (F.coalesce("_n", F.lit(0)) >= F.coalesce("least", F.lit(0))).alias("enough"),
        F.size(F.array_intersect(arr("categories"), arr("_cats"))).alias("hits"),
        F.size(arr("categories")).alias("wanted"),
    )
    return out.withColumn("passed", (F.size("missing") == 0) & (F.size("forbidden_found") == 0) & (F.size("missing_terms") == 0) & F.col("enough"))


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: documents, passed, hit_rate of the expected categories (null if none was expected)."""
    return evaluated.agg(F.count("*").alias("documents"), F.count_if("passed").alias("passed"), ratio(F.sum("hits"), F.sum("wanted")).alias("hit_rate"))


# What a corpus must reach as a whole.
HIT_RATE, PROCESSED, PARSER_FAILURES, MARKETING_STRONG = 0.8, 1.0, 0, 0


def corpus_gate(evaluated: DataFrame, documents: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """(check, ok) of the thresholds over all documents, and a last row `all`.

    evaluated: evaluate_documents(); documents: key and status (parsed, empty, ocr_required, unsupported or error);
    quality: rows with key, quality and signals. Checks: expected categories found, all documents passed, no forbidden
    category, no parser failure, every document processed, no strong evidence from marketing.
    """
    hits = summary(evaluated).select("documents", "passed", "hit_rate")
    forbidden = evaluated.agg(F.count_if(F.size("forbidden_found") > 0).alias("forbidden"))
    read = documents.agg(F.count_if(F.col("status") == "error").alias("failures"), ratio(F.count_if(F.col("status") != "error"), F.count("*")).alias("processed"))
    marketing = quality.agg(F.count_if((F.col("quality") == "strong") & F.array_contains("signals", "marketing_only")).alias("marketing"))
    row = hits.crossJoin(forbidden).crossJoin(read).crossJoin(marketing)  # each is one row
    return gate(
        row, hit_rate=F.col("hit_rate") >= HIT_RATE, passed=F.col("passed") == F.col("documents"), forbidden=F.col("forbidden") == 0, parser_failures=F.col("failures") <= PARSER_FAILURES,
        processed=F.col("processed") >= PROCESSED, marketing=F.col("marketing") <= MARKETING_STRONG,
    )


def missed_gaps(expected: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """(key, gap) of the expected gaps (key, gaps: array of signals) that no evidence of the document signals."""
    asked = expected.select(key, F.explode(F.array_distinct("gaps")).alias("gap"))
    shown = quality.select(key, F.explode("signals").alias("gap")).distinct()
    return asked.join(shown, [key, "gap"], "left_anti")


def gate(row: DataFrame, **checks: Column) -> DataFrame:
    """(check, ok) of a one-row frame, and a last row `all`; an unknown check fails."""
    each = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()))
    return row.select(F.inline(F.concat(each, F.array(F.struct(F.lit("all").alias("check"), F.forall(each, lambda x: x["ok"]).alias("ok"))))))


def document_summary(documents: DataFrame, chunks: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Documents with chunk_count, evidence_count and detected topics; those without any count 0."""
    c = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    e = scored.groupBy(key).agg(F.count("*").alias("evidence_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"))
    j = documents.join(c, key, "left").join(e, key, "left")
    return j.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0))).withColumn("topics", F.coalesce("topics", F.array().cast(_NONE)))


def dataset_problems(manifest: DataFrame, files: DataFrame, most_bytes: int = 50_000_000) -> DataFrame:
    """(local_path, problem) of a manifest (local_path, sha256, file_type) against read files (path, sha256, source_type,
    length): missing, too_large, hash or type. Paths are compared by their end."""
    m = manifest.select("local_path", F.col("sha256").alias("_want"), "file_type", F.element_at(F.split("local_path", "/"), -1).alias("_name"))
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("_name"), "path", F.col("sha256").alias("_have"), "source_type", "length")
    j = m.join(f, "_name", "left").where(F.col("path").isNull() | F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("local_path"))))
    best = j.groupBy("local_path").agg(F.max(F.struct(F.col("path").isNotNull().alias("there"), "_want", "_have", "file_type", "source_type", "length")).alias("_b"))
    known = manifest.select("local_path").distinct().join(best, "local_path", "left").select("local_path", "_b.*")
    problem = F.when(~F.coalesce("there", F.lit(False)), "missing").when(F.col("length") > most_bytes, "too_large").when(F.col("_want") != F.col("_have"), "hash").when(F.col("file_type") != F.col("source_type"), "type")
    return known.select("local_path", problem.alias("problem")).where("problem is not null")


def unlicensed(manifest: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(local_path, problem): entries of a manifest whose licence is none of the allowed ones."""
    known = F.coalesce(F.lower(F.trim("license_status")), F.lit("")).isin(*allowed)
    return manifest.where(~known).select("local_path", F.lit("licence").alias("problem"))


def too_large_in_all(files: DataFrame, most_bytes: int = 200_000_000) -> DataFrame:
    """(bytes, problem): one row if the files (length) are too large together, else none."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).where(F.col("bytes") > most_bytes).withColumn("problem", F.lit("too_large_in_all"))


def map_controls(categories: Column, mapping: dict[str, list[str]], known: list[str]) -> Column:
    """The controls of an array of categories, each once, in the order of the categories; only known ones."""
    table = F.create_map(*(x for c, cs in mapping.items() for x in (F.lit(c), F.array(*(F.lit(v) for v in cs)))))
    found = F.flatten(F.transform(categories, lambda c: F.coalesce(F.try_element_at(table, c), F.array().cast(_NONE))))
    return F.array_intersect(F.array_distinct(found), F.array(*(F.lit(k) for k in known)))


def forbidden_claim(text: Column, patterns: list[str]) -> Column:
    """Whether a text makes any of the claims that the patterns describe; null makes none."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?i){p}")
    return F.coalesce(out, F.lit(False))


def with_model(df: DataFrame, name: str, version: str, trained_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Adds what made the rows; the time defaults to a constant, so that equal runs give equal rows."""
    return df.withColumn("model", F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(trained_at).alias("trained_at")))
