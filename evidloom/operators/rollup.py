"""Counts per group, zero-filled along a spine, and the ladders and metrics made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.operators.scoring import ladder


def spine(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row per value, in the session of df."""
    return df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")


def category_counts(evidence: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """(key, category, n): per document and, with a null key, over all documents; categories without rows count 0 there."""
    counted = evidence.rollup("category", key).agg(F.count("*").alias("n"), F.grouping(key).alias("_all")).where("category is not null")
    total = spine(evidence, "category", categories).join(counted.where("_all = 1").select("category", "n"), "category", "left")
    kind = evidence.schema[key].dataType
    return counted.where("_all = 0").select(key, "category", "n").unionByName(total.select(F.lit(None).cast(kind).alias(key), "category", F.coalesce("n", F.lit(0)).alias("n")))


def counters(df: DataFrame, column: str, values: list[str], other: str = "other") -> DataFrame:
    """(value, n) for each value, 0 where none has it, and `other` for null and all else."""
    known = F.when(F.col(column).isin(values), F.col(column)).otherwise(other)
    counted = df.groupBy(known.alias("value")).agg(F.count("*").alias("n"))
    return spine(df, "value", [*values, other]).join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def quality_counts(evidence: DataFrame, key: str, levels: list[str]) -> DataFrame:
    """One row per document with a count for each quality level."""
    return evidence.groupBy(key).agg(*(F.count_if(F.col("quality") == q).alias(q) for q in levels))


def coverage(evidence: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """(control, evidence_count, strong_documents, status) from (control, category) pairs, m to n.

    Evidence is counted per category and document first; the bridge meets these counts, not the rows. A document that
    is strong in several categories of one control counts once.
    """
    per = evidence.groupBy("category", key).agg(F.count("*").alias("n"), F.bool_or(F.col("quality") == "strong").alias("strong"))
    joined = bridge.join(per, "category", "left")
    out = joined.groupBy("control").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("evidence_count"), F.countDistinct(F.when(F.col("strong"), F.col(key))).alias("strong_documents"))
    return out.withColumn("status", ladder((F.col("strong_documents") > 0, "strong"), (F.col("evidence_count") > 0, "review"), otherwise="missing"))


def topic_coverage(scored: DataFrame, topics: list[str], covered: float = 0.74, partial: float = 0.62) -> DataFrame:
    """(topic, n, confidence, status) of every topic, from chunks with topics, confidence and status."""
    each = scored.select(F.explode("topics").alias("topic"), "confidence", "status")
    found = each.groupBy("topic").agg(
        F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.bool_or(F.col("status") == "conflicting").alias("_c"), F.bool_or(F.col("status") == "stale_evidence").alias("_s")
    )
    all_ = spine(scored, "topic", topics).join(found, "topic", "left")
    status = ladder(
        (F.col("n").isNull(), "missing"), (F.col("_c"), "conflicting"), (F.col("_s"), "stale_evidence"), (F.col("confidence") >= F.lit(covered), "covered"), (F.col("confidence") >= F.lit(partial), "partial"), otherwise="needs_review"
    )
    return all_.select("topic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), status.alias("status"))


def top_values(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """(key, value, n, rank): the commonest values of each key, ties by first appearance."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "_first", value)
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("_first")


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded; null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def set_metrics(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision and recall of two sets of keys; a ratio with nothing under it is null."""
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    b = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    both = a.join(b, keys, "full")
    counts = both.agg(F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    return counts.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def label_metrics(labels: DataFrame, key: str, expected: str, predicted: str, names: list[str]) -> DataFrame:
    """(name, tp, fp, fn, precision, recall) per label from two array columns of one row per key."""
    each = labels.select(expected, predicted, F.explode(F.array(*(F.lit(n) for n in names))).alias("name"))
    each = each.select("name", F.array_contains(expected, F.col("name")).alias("e"), F.array_contains(predicted, F.col("name")).alias("p"))
    out = each.groupBy("name").agg(F.count_if(F.col("e") & F.col("p")).alias("tp"), F.count_if(~F.col("e") & F.col("p")).alias("fp"), F.count_if(F.col("e") & ~F.col("p")).alias("fn"))
    return out.select("name", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def merge_signals(signals: DataFrame, key: str) -> DataFrame:
    """(key, control, confidence, reasons) from rows (key, ord, control, confidence, reason): the first control wins,
    confidence is the largest, reasons are distinct, sorted and joined by a bar."""
    return signals.groupBy(key).agg(
        F.min_by("control", F.when(F.col("control").isNotNull(), F.col("ord"))).alias("control"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons")
    )


def review_queue(streams: list[DataFrame], key: str, resolved: DataFrame | None = None) -> DataFrame:
    """(key, priority, reasons): union of streams (key, priority, reason), the best priority first; keys in `resolved`
    are left out. A reason that several streams give counts once, before the shuffle."""
    rows = streams[0].select(key, "priority", "reason")
    for s in streams[1:]:
        rows = rows.unionByName(s.select(key, "priority", "reason"))
    queue = rows.groupBy(key).agg(F.min("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))
    return queue if resolved is None else queue.join(resolved.select(key).distinct(), key, "left_anti")


def points_score(df: DataFrame, parts: list[tuple[str, str, int, int]], base: Column, most: int = 100) -> DataFrame:
    """Adds `score`: base plus, for each (column, name, weight, cap), weight times the column up to the cap; capped
    itself at `most`. Adds `basis`: how many of the parts are not zero."""
    out = df
    for column, name, weight, cap in parts:
        out = out.withColumn(name, F.least(F.lit(cap), F.coalesce(F.col(column), F.lit(0)) * weight))
    total = base
    families = F.lit(0)
    for _, name, _, _ in parts:
        total = total + F.col(name)
        families = families + (F.col(name) > 0).cast("int")
    basis = F.when(families >= 2, "corroborated").when(families == 1, "partial").otherwise("base_only")
    return out.withColumn("score", F.least(F.lit(most), total)).withColumn("basis", basis)
