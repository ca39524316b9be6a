"""References to records that did not exist, by a skew-aware split of the referencing keys.

References are pre-aggregated per key and period; these groups are judged against the lifetimes of the targets, heavy keys
by broadcast, all others by a shuffled join. Counts come from the groups; rows are fetched for the broken ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.operators.skew import HOT_ROWS, hot_of, spread_join
from evidloom.session import materialize

REF_COLUMNS = ("ref_table", "load_seq", "recorded_at", "ref_value")


def trimmed(key: Column) -> Column:
    """The key without surrounding blanks of any kind; null where nothing is left."""
    return F.nullif(F.regexp_replace(key, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", ""), F.lit(""))


def scalar_refs(df: DataFrame, ref_table: str, key: str) -> DataFrame:
    """One reference per row of `df` from a string column; null and blank keys give none."""
    return df.select(F.lit(ref_table).alias("ref_table"), "load_seq", "recorded_at", trimmed(F.col(key)).alias("ref_value")).where("ref_value is not null")


def array_refs(df: DataFrame, ref_table: str, keys: str) -> DataFrame:
    """The distinct references of each row from an array column; null, empty and blank ones give none."""
    each = F.explode(F.array_distinct(F.transform(F.col(keys), trimmed)))
    return df.select(F.lit(ref_table).alias("ref_table"), "load_seq", "recorded_at", each.alias("ref_value")).where("ref_value is not null")


def lifetimes(df: DataFrame, key: str) -> DataFrame:
    """Per key, when its first row was recorded and when it was deleted (the earliest, where delivered twice)."""
    gone = F.min("deleted_at") if "deleted_at" in df.columns else F.min(F.lit(None).cast("timestamp"))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("ref_value")).agg(F.min("recorded_at").alias("first_at"), gone.alias("gone_at"))


def _state(n: Column, earliest: Column, latest: Column) -> Column:
    """`ok`, `broken` or `mixed`: what holds for all references to a key that were recorded between two times.

    A group in which some row has no time is broken where no target exists, else mixed.
    """
    first, gone = F.col("first_at"), F.col("gone_at")
    whole = F.col("timed") == n
    return (
        F.when(first.isNull(), "broken")
        .when(whole & ((first > latest) | F.coalesce(gone <= earliest, F.lit(False))), "broken")
        .when((first <= F.coalesce(earliest, first)) & F.coalesce(gone > F.coalesce(latest, gone - F.expr("interval 1 microsecond")), F.lit(True)), "ok")
        .otherwise("mixed")
    )


def _broken() -> Column:
    at = F.col("recorded_at")
    return F.col("first_at").isNull() | (F.col("first_at") > at) | F.coalesce(F.col("gone_at") <= at, F.lit(False))


def period(at: str = "recorded_at") -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(""))


def preaggregate(refs: DataFrame) -> DataFrame:
    """(ref_table, ref_value, period, n, timed, earliest, latest): one small row for each key and month, combined before the
    shuffle."""
    return refs.groupBy("ref_table", "ref_value", period().alias("period")).agg(F.count("*").alias("n"), F.count("recorded_at").alias("timed"), F.min("recorded_at").alias("earliest"), F.max("recorded_at").alias("latest"))


def judged(refs: DataFrame, targets: DataFrame, least: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """((ref_table, ref_value, period, n, first_at, gone_at, state), heavy keys or None): the groups of preaggregate() that
    are not wholly sound.

    Keys with very many references, MOST_HOT at most by construction, are checked by a broadcast of their lifetimes; the
    groups of all others meet the lifetimes in a shuffled join. Both counts are united. Written to shared storage.
    """
    groups = materialize(preaggregate(refs), "reference-groups")
    heavy = hot_of(groups.groupBy("ref_value").agg(F.sum("n").alias("n")), ["ref_value"], "n", least)
    rest = groups
    checked = None
    if heavy is not None:
        keys = heavy.select("ref_value")
        lives = F.broadcast(keys.join(targets, "ref_value"))
        checked = groups.join(F.broadcast(keys), "ref_value", "left_semi").join(lives, "ref_value", "left")
        rest = groups.join(F.broadcast(keys), "ref_value", "left_anti")
    shuffled = rest.join(targets, "ref_value", "left")
    both = shuffled if checked is None else checked.unionByName(shuffled)
    state = both.withColumn("state", _state(F.col("n"), F.col("earliest"), F.col("latest"))).where("state <> 'ok'")
    return materialize(state.select("ref_table", "ref_value", "period", "n", "first_at", "gone_at", "state"), "reference-states"), heavy


def _rows(refs: DataFrame, groups: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """The references of groups, each with its target's lifetime, if it is broken itself."""
    on = ["ref_table", "ref_value", "period"]
    dated = refs.withColumn("period", period())
    found = spread_join(dated, groups.select(*on, "first_at", "gone_at"), on, ["load_seq"], heavy)
    return found.where(_broken())


def orphans(refs: DataFrame, targets: DataFrame, least: int = HOT_ROWS) -> DataFrame:
    """The references (REF_COLUMNS) whose target had not been recorded, or had been deleted, at `recorded_at`.

    targets: lifetimes() of the referenced table. References are judged by key and month first, see judged(); only those
    of groups that are not wholly sound are then looked up, the rows of heavy keys dealt to several tasks. A row without
    recorded_at counts as broken only if no such target exists at all. Result order is undefined.
    """
    groups, heavy = judged(refs, targets, least)
    return _rows(refs, groups, heavy).select(*REF_COLUMNS)


def orphan_counts(refs: DataFrame, targets: DataFrame, least: int = HOT_ROWS) -> DataFrame:
    """(ref_table, period, broken, missing_keys): broken references and their keys per table and month (UTC), the month
    being null where recorded_at is.

    Groups of one key and month that are broken as a whole count by their size; rows are looked at only where a target
    came or went in the month.
    """
    groups, heavy = judged(refs, targets, least)
    whole = groups.where("state = 'broken'").select("ref_table", "ref_value", "period", "n")
    mixed = _rows(refs, groups.where("state = 'mixed'"), heavy).groupBy("ref_table", "ref_value", "period").agg(F.count("*").alias("n"))
    counted = whole.unionByName(mixed).groupBy("ref_table", F.nullif("period", F.lit("")).alias("period"))
    return counted.agg(F.sum("n").alias("broken"), F.countDistinct("ref_value").alias("missing_keys"))
