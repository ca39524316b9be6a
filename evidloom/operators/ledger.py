"""Hash-chained event ledgers: validation in parallel, one writer per chain for appending."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.operators.skew import hot_of, spread_join

GENESIS = "0" * 64


def event_hash(previous: Column, parts: list[Column]) -> Column:
    """SHA-256 over the previous hash and the parts of an event, one to a line; nulls count as empty."""
    return F.sha2(F.concat_ws("\n", previous, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def chain_problems(events: DataFrame, by: list[str], parts: list[str], sequence: str = "sequence", previous: str = "previous_hash", own: str = "event_hash") -> DataFrame:
    """(by..., sequence, problem): numbers that do not follow the one before or occur twice, a previous hash that is not the
    one before, and events whose hash is not that of their content.

    Every event meets its neighbour by an equi-join on the chain and the number, so that a chain of any length is checked
    by many tasks; none is sorted or gathered.
    """
    before = events.groupBy(*by, (F.col(sequence) + 1).alias(sequence)).agg(F.min(own).alias("_before"), F.lit(True).alias("_follows"))
    twice = events.groupBy(*by, sequence).agg(F.count("*").alias("_same"))
    checked = events.join(before, [*by, sequence], "left").join(twice, [*by, sequence], "left")
    first = F.col(sequence) == 1
    problem = (
        F.when(F.col(sequence).isNull() | (F.col("_same") > 1) | ~(first | F.coalesce("_follows", F.lit(False))), "sequence")
        .when(~F.col(previous).eqNullSafe(F.when(first, F.lit(GENESIS)).otherwise(F.col("_before"))), "previous_hash")
        .when(~F.col(own).eqNullSafe(event_hash(F.col(previous), [F.col(p) for p in parts])), "event_hash")
    )
    return checked.select(*by, sequence, problem.alias("problem")).where("problem is not null")


class LedgerError(ValueError):
    """A ledger that does not hold together cannot be added to."""


def append_validated(ledger: DataFrame, events: DataFrame, by: list[str], parts: list[str], order: list[str]) -> DataFrame:
    """append_chain() behind the last event of each chain of a ledger, which is validated as a whole first: any problem
    raises LedgerError, and nothing is appended."""
    bad = chain_problems(ledger, by, parts).limit(1).collect()
    if bad:
        raise LedgerError(f"the ledger has a problem: {bad[0].asDict()}")
    heads = ledger.groupBy(*by).agg(F.max("sequence").alias("sequence"), F.max_by("event_hash", "sequence").alias("event_hash"))
    return append_chain(events, by, parts, order, heads)


def append_chain(events: DataFrame, by: list[str], parts: list[str], order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """Events with sequence, previous_hash and event_hash, going on from heads (by..., sequence, event_hash).

    A chain is serial by nature: each is written by one task, in order, in a stream of batches; chains run in parallel.
    """
    start = events.withColumn("_head", F.lit(GENESIS)).withColumn("_at", F.lit(0)) if heads is None else (
        events.join(heads.select(*by, F.col("event_hash").alias("_h"), F.col("sequence").alias("_s")), by, "left").withColumn("_head", F.coalesce("_h", F.lit(GENESIS))).withColumn("_at", F.coalesce("_s", F.lit(0))).drop("_h", "_s")
    )
    lined = start.withColumn("_text", F.concat_ws("\n", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)))
    ordered = lined.repartition(*by).sortWithinPartitions(*by, *order)
    kept = [f for f in ordered.schema.fields if f.name not in ("_head", "_at", "_text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence long, previous_hash string, event_hash string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last, at = None, GENESIS, 0
        for frame in frames:
            rows = []
            for key, head, begin, text in zip(frame[by].itertuples(index=False, name=None), frame["_head"], frame["_at"], frame["_text"], strict=True):
                if key != chain:
                    chain, last, at = key, head, int(begin)
                at += 1
                own = hashlib.sha256(f"{last}\n{text}".encode()).hexdigest()
                rows.append((at, last, own))
                last = own
            out = frame[[f.name for f in kept]].copy()
            out["sequence"], out["previous_hash"], out["event_hash"] = zip(*rows, strict=True) if rows else ([], [], [])
            yield out

    return ordered.mapInPandas(run, schema)


def transition_problems(events: DataFrame, by: list[str], kind: str, sequence: str, needs: dict[str, list[str]], forbids: dict[str, list[str]], first: str | None = None) -> DataFrame:
    """(by..., sequence, problem) of events out of order.

    needs: event -> events of which each must have come before; forbids: event -> events of which none may have come.
    `first` may only be the first event. What came before is known from where each kind of event came first: one row for
    each chain, combined before its shuffle; the events of long chains are dealt to several tasks.
    """
    seen = {e: f"_seen_{i}" for i, e in enumerate(sorted({x for xs in (*needs.values(), *forbids.values()) for x in xs}))}
    firsts = [F.min(F.when(F.col(kind) == event, F.col(sequence))).alias(column) for event, column in seen.items()]
    chains = events.groupBy(*by).agg(F.min(sequence).alias("_start"), F.count("*").alias("_n"), *firsts)
    flagged = spread_join(events, chains.drop("_n"), by, [sequence], hot_of(chains.select(*by, "_n"), by, "_n"))

    def came(event: str) -> Column:
        return F.coalesce(F.col(seen[event]) < F.col(sequence), F.lit(False))

    problem = F.when(F.lit(first is not None) & (F.col(kind) == F.lit(first)) & (F.col(sequence) != F.col("_start")), "not_first")
    for event, wanted in needs.items():
        for other in wanted:
            problem = problem.when((F.col(kind) == event) & ~came(other), f"needs_{other}")
    for event, others in forbids.items():
        for other in others:
            problem = problem.when((F.col(kind) == event) & came(other), f"after_{other}")
    return flagged.select(*by, sequence, problem.alias("problem")).where("problem is not null")


def role_problems(events: DataFrame, kind: str, role: str, allowed: dict[str, str], always: tuple[str, ...] = ("admin",)) -> DataFrame:
    """Events whose role may not cause them: allowed maps an event's prefix or name to its role."""
    wanted = F.lit(None).cast("string")
    for prefix, who in sorted(allowed.items(), key=lambda kv: len(kv[0])):
        wanted = F.when(F.startswith(F.col(kind), F.lit(prefix)), F.lit(who)).otherwise(wanted)
    return events.where(~F.col(role).isin(*always) & wanted.isNotNull() & (F.col(role) != wanted))


def completion_problems(events: DataFrame, by: list[str], kind: str, completion: str) -> DataFrame:
    """(by..., n): chains without exactly one completion event."""
    return events.groupBy(*by).agg(F.count_if(F.col(kind) == completion).alias("n")).where("n <> 1")
