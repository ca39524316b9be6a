"""Joins and groups whose keys may hold a large part of all rows: hot keys are found first, then split or pre-aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.session import materialize

HOT_ROWS = 20_000  # rows of one key above which it is split
MOST_HOT = 10_000  # hot keys at most, whatever the input: what is broadcast of them has this bound
_TRACKED = 10_000  # items that the sketch of hot_values() follows


def hot_of(counts: DataFrame, on: list[str], n: str = "n", least: int = HOT_ROWS, most: int = MOST_HOT) -> DataFrame | None:
    """(on..., _parts) of the keys with at least `least` rows and at least a `most`-th of all, given (on..., n), one row
    for each key: so there are at most `most` of them. None if there are none. Null keys match nothing and are no hot keys.

    _parts is the number of tasks to deal the key's rows to. Written to shared storage.
    """
    big = counts.where(F.col(n) >= least).select(*on, n)
    for c in on:
        big = big.where(F.col(c).isNotNull())
    total = counts.agg(F.sum(n).alias("_total"))
    size = F.greatest(F.lit(least), F.col("_total") / most)
    hot = materialize(big.join(F.broadcast(total), F.col(n) >= size).select(*on, F.ceil(F.col(n) / size).cast("long").alias("_parts")), "hot-keys")
    return None if hot.isEmpty() else hot


def hot_keys(rows: DataFrame, on: list[str], least: int = HOT_ROWS, most: int = MOST_HOT) -> DataFrame | None:
    """hot_of() the rows' keys, counted with a combine before the shuffle."""
    return hot_of(rows.groupBy(*on).agg(F.count("*").alias("n")), on, "n", least, most)


def hot_values(rows: DataFrame, column: str, least: int = HOT_ROWS, most: int = 1000) -> DataFrame | None:
    """(column) of the values that hold about `least` rows and more, by a sketch of fixed size, without a shuffle; None if
    there are none.

    The sketch finds every value that holds more than some 1/2000 of all rows; what it misses is a fair share of a task.
    Which way a value takes must not change the result.
    """
    got = rows.select(F.expr(f"inline(approx_top_k({column}, {most}, {_TRACKED}))")).where(F.col("count") >= least).select(F.col("item").alias(column)).collect()
    return rows.sparkSession.createDataFrame(got, f"{column} {rows.schema[column].dataType.simpleString()}") if got else None


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many.join(one, on, how), the rows of hot keys dealt to several tasks by a hash of their columns `by`; the rows of
    `one` with such a key are repeated for each of them. hot: hot_of() or hot_keys() of `many`, by all of `on` or some."""
    if hot is None:
        return many.join(one, on, how)
    marks, keys = F.broadcast(hot), [c for c in hot.columns if c != "_parts"]
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0))
    left = many.join(marks, keys, "left").withColumn("_part", part).drop("_parts")
    right = one.join(marks, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def join_groups(rows: DataFrame, on: list[str], hot: DataFrame | None, keep: Column, **stats: Column) -> DataFrame:
    """The rows of those groups whose stats fulfil `keep`, with the stats.

    Groups that are not hot are aggregated and joined in one shuffle. Hot ones, of which there are few, are combined before
    theirs and looked up by broadcast, so that their rows stay where they are. hot: the keys' first column, as hot_values()
    has it. The stats must use all columns of the rows, or the aggregate and the join read two shuffles instead of one.
    """
    aggs = [c.alias(n) for n, c in stats.items()]
    cold = rows if hot is None else rows.join(F.broadcast(hot), on[0], "left_anti")
    placed = cold.repartition(*on)
    out = placed.join(placed.groupBy(*on).agg(*aggs).where(keep), on)
    if hot is None:
        return out
    mine = rows.join(F.broadcast(hot), on[0], "left_semi")
    return out.unionByName(mine.join(F.broadcast(mine.groupBy(*on).agg(*aggs).where(keep)), on))
