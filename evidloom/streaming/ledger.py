"""Event streams (an extension: the batch operators cover the reference's needs).

A stream of ledger events is checked as it arrives; the state of a chain is its last sequence and hash, whatever its
length. Repeated deliveries are dropped within a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidloom.operators.ledger import GENESIS

PROBLEMS = "chain string, sequence long, problem string"


def _check(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, head = state.get if state.exists else (0, GENESIS)
    found = []
    for frame in frames:
        for sequence, previous, own in frame.sort_values("sequence")[["sequence", "previous_hash", "event_hash"]].itertuples(index=False, name=None):
            if sequence != last + 1:
                found.append((key[0], int(sequence), "sequence"))
            elif previous != head:
                found.append((key[0], int(sequence), "previous_hash"))
            last, head = int(sequence), own
    state.update((last, head))
    yield pd.DataFrame(found, columns=["chain", "sequence", "problem"])


def check_chains(events: DataFrame, chain: str) -> DataFrame:
    """A stream of (chain, sequence, problem) from one of events with sequence, previous_hash and event_hash."""
    return events.groupBy(F.col(chain).cast("string").alias("chain")).applyInPandasWithState(_check, PROBLEMS, "last long, head string", "append", GroupStateTimeout.NoTimeout)


def without_repeats(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """A stream without the repeats of a key that arrive within `late`; state older than that is dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event counts per window and value; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
