"""Review decisions applied to findings, and the cleaning of what reviewers typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions import patterns as P
from evidloom.functions import text as TX
from evidloom.operators.constraints import ConstraintError, require

# Accepted review states.
STATES = ("open", "accepted", "reviewed", "rejected", "false_positive", "needs_evidence", "not_applicable", "resolved")


def review_state(raw: Column, states=STATES) -> Column:
    """(state, unknown): lower case and trimmed; blank and unknown values become `open`."""
    low = F.lower(TX.strip(F.coalesce(raw, F.lit(""))))
    known = low.isin(*states)
    return F.struct(F.when(known, low).otherwise(F.lit("open")).alias("state"), (~known & (low != "")).alias("unknown"))


# Credentials, and paths that name a user or hold settings.
_AUTH = r"(?i)\b(?:authorization|bearer|cookie)\b\s*:?\s*(?:Bearer\s+)?[A-Za-z0-9._~+/=-]{4,}"
_DOTENV = r"(?i)(^|[\\/])\.env(?:$|[.\s\\/])"
_PRIVATE_PATH = r"(?i)(?:[A-Z]:\\Users\\[^\s]+|/(?:home|Users|root)/[^\s]+)"


MOST_NOTE = 4000  # characters of a note that clean_note() keeps by default


def clean_note(raw: Column, most: int | None = MOST_NOTE) -> Column:
    """(note, changed, cut): one line, sensitive values, credentials and private paths masked in all of it, then cut to
    `most` characters and formulas guarded. cut says whether something is missing; with `most` None nothing is."""
    single = TX.collapse(F.coalesce(raw, F.lit("")))
    masked = P.mask(single)
    for pattern, mark in ((_AUTH, "[token:redacted]"), (_DOTENV, "[path:redacted]"), (_PRIVATE_PATH, "[path:redacted]")):
        masked = F.regexp_replace(masked, pattern, mark)
    cut = F.lit(False) if most is None else F.char_length(masked) > most
    safe = TX.guard_formula(masked if most is None else F.left(masked, F.lit(most)))
    return F.struct(safe.alias("note"), (safe != single).alias("changed"), cut.alias("cut"))


def apply_reviews(findings: DataFrame, reviews: DataFrame, key: str = "finding_id", most: int | None = MOST_NOTE) -> DataFrame:
    """Findings with review_state and review_note of their review; findings without one are open. most: see clean_note().

    Of several reviews of one finding the one with the largest `load_seq` counts. Reviews of unknown findings are given
    by unknown_reviews(). A finding that a third of the reviews name is pre-aggregated before the join.
    """
    last = reviews.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("review_status", "review_note"), "load_seq").alias("_r"))
    joined = findings.join(last, key, "left")
    state = review_state(F.col("_r.review_status"))["state"]
    return joined.withColumn("review_state", state).withColumn("review_note", clean_note(F.col("_r.review_note"), most)["note"]).drop("_r")


def review_problems(reviews: DataFrame, findings: DataFrame, key: str = "finding_id") -> DataFrame:
    """(key, problem, n): what a strict review refuses: rows without an id, ids that occur twice, unknown states, and
    reviews of unknown findings."""
    for c in (key, "review_status"):
        if c not in reviews.columns:
            raise ConstraintError(f"the reviews have no column {c}")
    rows = reviews.select(TX.strip(F.coalesce(F.col(key), F.lit(""))).alias(key), review_state(F.col("review_status"))["unknown"].alias("_u"))
    per = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("_u").alias("_bad"))
    known = findings.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_known", F.lit(True))
    j = per.join(known, key, "left")
    blank = F.col(key) == ""
    each = F.array(
        F.when(blank, F.struct(F.lit("missing_id").alias("problem"), F.col("_n").alias("n"))), F.when(~blank & (F.col("_n") > 1), F.struct(F.lit("repeated_id").alias("problem"), F.col("_n").alias("n"))),
        F.when(F.col("_bad") > 0, F.struct(F.lit("unknown_state").alias("problem"), F.col("_bad").alias("n"))), F.when(~blank & F.col("_known").isNull(), F.struct(F.lit("unknown_finding").alias("problem"), F.col("_n").alias("n"))),
    )
    return j.select(key, F.inline(F.array_compact(each)))


def apply_strict(findings: DataFrame, reviews: DataFrame, key: str = "finding_id", most: int | None = MOST_NOTE) -> DataFrame:
    """apply_reviews(), unless review_problems() has any: then ConstraintError."""
    require(review_problems(reviews, findings, key), "the reviews cannot be applied")
    return apply_reviews(findings, reviews, key, most)


def unknown_reviews(reviews: DataFrame, findings: DataFrame, key: str = "finding_id") -> DataFrame:
    """Distinct ids of reviews without a finding."""
    return reviews.where(F.col(key).isNotNull()).select(key).distinct().join(findings.select(key).distinct(), key, "left_anti")


def total_match(decisions: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, problem): findings without exactly one decision, and decisions without a finding; empty if all is right."""
    d = decisions.groupBy(key).agg(F.count("*").alias("_d"))
    f = findings.select(key).distinct().withColumn("_f", F.lit(1))
    both = d.join(f, key, "full")
    problem = F.when(F.col("_f").isNull(), "unknown_finding").when(F.col("_d").isNull(), "undecided").when(F.col("_d") > 1, "decided_twice")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def accepted(findings: DataFrame, states=("accepted", "reviewed")) -> DataFrame:
    """The findings that reviewers accepted, as evidence records with a metadata hash."""
    kept = findings.where(F.col("review_state").isin(*states))
    return kept.withColumn("evidence_id", TX.stable_id("EV-", [F.col("finding_id"), F.col("category"), F.col("review_state")], 12))
