"""Tables that change: newest row per key, versions before a replacement, missing entries along a spine, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import text as TX
from evidloom.operators.rollup import spine
from evidloom.operators.scoring import ladder


def latest(rows: DataFrame, keys: list[str], order: list[str], first_seen: str | None = None) -> DataFrame:
    """The last row of each key by `order`; with first_seen, that column keeps the smallest value of the key, as an
    insert-or-replace that preserves it. By aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    earliest = [F.min(first_seen).alias("_first")] if first_seen else []
    out = rows.groupBy(*keys).agg(newest, *earliest)
    return out.select(*keys, *(F.col("_first").alias(c) if c == first_seen else F.col(f"_row.{c}").alias(c) for c in rest))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str], first_seen: str | None = None) -> DataFrame:
    """The table after changes: their newest row per key in place of the current one."""
    return latest(current.unionByName(changes), keys, order, first_seen)


def touch(current: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Only `column` moves on to the largest value; all else stays as it was first."""
    new = changes.groupBy(*keys).agg(F.max(column).alias("_new"))
    moved = current.join(new, keys, "left").withColumn(column, F.greatest(column, F.coalesce("_new", column))).drop("_new")
    return moved.unionByName(changes.join(current.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def versions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds version_no, is_current and the time the next version took over (valid_to)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("version_no", F.row_number().over(w)).withColumn("valid_to", F.lead(order[0]).over(w)).withColumn("is_current", F.lead(F.lit(1)).over(w).isNull())


def replaced(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows that changes are about to replace: what goes to the history."""
    return current.join(changes.select(*keys).distinct(), keys, "left_semi")


def drafts(questions: DataFrame, answers: DataFrame, evidence: DataFrame, key: str, as_of: str, enough: float = 0.64) -> DataFrame:
    """(key, cluster, status, source_id, confidence): what is known for each question of a cluster.

    answers: best answer per cluster with answer_id, confidence, valid_until, refs; evidence: best confidence per
    cluster. Outcomes, first that applies: stale, missing_evidence (answer without refs), reviewed, needs_review
    (evidence, sure or not), missing_evidence.
    """
    a = answers.select("cluster", "answer_id", F.col("confidence").alias("_ac"), "valid_until", F.size(F.coalesce("refs", F.array())).alias("_refs"))
    e = evidence.select("cluster", F.col("confidence").alias("_ec"))
    j = questions.join(a, "cluster", "left").join(e, "cluster", "left")
    has = F.col("answer_id").isNotNull()
    reason = ladder(
        (has & TX.is_stale(F.col("valid_until"), as_of), "stale"), (has & (F.col("_refs") == 0), "answer_without_refs"), (has, "reviewed"), (F.col("_ec") >= F.lit(enough), "draft_from_evidence"),
        (F.col("_ec").isNotNull(), "low_confidence_evidence"), otherwise="nothing_found",
    )
    j = j.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("stale", "reviewed"), F.col("reason")).when(F.col("reason").isin("draft_from_evidence", "low_confidence_evidence"), "needs_review").otherwise("missing_evidence")
    conf = F.when(F.col("reason").isin("stale", "reviewed"), F.col("_ac")).when(F.col("_ec").isNotNull() & ~F.col("reason").isin("answer_without_refs"), F.col("_ec")).otherwise(F.lit(0.0))
    return j.select(key, "cluster", status.alias("status"), "reason", F.coalesce("answer_id", F.lit("")).alias("source_id"), F.coalesce(conf, F.lit(0.0)).alias("confidence"))


def missing_rows(drafted: DataFrame, evidence_topics: DataFrame, topics: list[str], order: str) -> DataFrame:
    """(cluster, status, questions): topics that the last draft did not settle; `partial` where evidence exists."""
    last = drafted.groupBy("cluster").agg(F.max_by("status", order).alias("_last"), F.count("*").alias("questions"))
    found = evidence_topics.select(F.col("topic").alias("cluster")).distinct().withColumn("_e", F.lit(True))
    j = spine(drafted, "cluster", topics).join(last, "cluster", "left").join(found, "cluster", "left").where("_last is null or _last <> 'reviewed'")
    out = j.select("cluster", F.when(F.col("_e"), "partial").otherwise("missing").alias("status"), F.coalesce("questions", F.lit(0)).alias("questions"))
    return out.where("questions > 0 or status = 'missing'")
