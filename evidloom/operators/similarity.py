"""64-bit SimHash fingerprints and the pairs of documents whose fingerprints differ in few bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import tokens
from evidloom.session import materialize

_AT_ONCE = 1 << 15  # tokens whose bits are laid out at once


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tokens), none without tokens, as (key, b0 to b63): the sums of their tokens' votes."""
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            lists = part.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            coded = lists.flatten().dictionary_encode()
            heads = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest()[7::-1] for t in coded.dictionary.to_pylist()), np.uint8).reshape(-1, 8)
            codes, ones = coded.indices.to_numpy(), np.zeros((part.num_rows, 64), np.int64)
            for at in range(0, len(codes), _AT_ONCE):
                stop = min(at + _AT_ONCE, len(codes))
                low, high = np.searchsorted(ends, [at, stop - 1], "right")
                starts = np.concatenate(([at], ends[low:high])) - at
                bits = np.unpackbits(heads[codes[at:stop]], axis=1, bitorder="little").astype(np.int32)
                ones[low : high + 1] += np.add.reduceat(bits, starts, axis=0)
            sums = 2 * ones - lists.value_lengths().to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], names=[part.schema.names[0], *(f"b{i}" for i in range(64))])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp bigint): each token votes for the bits of the first 8 bytes of its SHA-256, as often as it occurs; a bit
    is set at a sum of 0 or more. Texts without tokens, and nulls, get 0. Rows of one key vote together.

    Votes are summed where the text is read, each term of a batch hashed once; one row of sums per text is shuffled.
    """
    worded = df.select(key, tokens(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    kind = worded.schema[key].dataType.simpleString()
    sums = worded.mapInArrow(_votes, f"`{key}` {kind}, " + ", ".join(f"b{i} bigint" for i in range(64)))
    votes = sums.groupBy(key).agg(*(F.sum(f"b{i}").alias(f"b{i}") for i in range(64)))
    fp = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"b{i}") >= 0, F.expr(f"shiftleft(1L, {i})")).otherwise(F.expr("0L")) for i in range(64)))
    return df.select(key).join(votes.select(F.col(key), fp.alias("fp")).hint("merge"), key, "left").select(key, F.coalesce("fp", F.expr("0L")).alias("fp"))


def _scheme(count: int, most: int, group: int = 32) -> tuple[list[int], list[tuple[int, ...]]]:
    """(edges of blocks, combinations of blocks): with most + keep blocks, two fingerprints that differ in `most` bits
    agree on at least `keep` of them. keep grows with the number of fingerprints, so that about `group` share a key."""
    keep = 1
    while keep < 6 and count / 2 ** (64 * keep / (most + keep)) > group:
        keep += 1
    blocks = most + keep
    return [round(64 * k / blocks) for k in range(blocks + 1)], list(combinations(range(blocks), keep))


def near_pairs(prints: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(fp_a, fp_b, distance), fp_a < fp_b: pairs of different fingerprints at most `most` bits apart, exactly.

    Documents with one fingerprint are one class, see classes(). Fingerprints meet on the bits of a combination of
    blocks; the larger the corpus, the more bits, so the number of fingerprints with one key stays small. A pair is
    given out at the first combination it agrees on only, so none comes twice.

    Either side has a row for each fingerprint and combination, which Spark does not see in the size of the fingerprints:
    it would broadcast a frame some hundred times larger than it thinks, hence the hint.
    """
    distinct = materialize(prints.select("fp").distinct(), "fingerprints")  # counted, then joined with itself
    edges, chosen = _scheme(distinct.agg(F.approx_count_distinct("fp")).first()[0], most)
    part = [F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(len(edges) - 1)]
    each = distinct.select("fp", F.posexplode(F.array(*(F.xxhash64(*(part[k] for k in c)) for c in chosen))).alias("combination", "bits"))
    a, b = (each.select("combination", "bits", F.col("fp").alias(f"fp_{s}")) for s in "ab")
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    pairs = a.join(b.hint("merge"), ["combination", "bits"]).where((F.col("fp_a") < F.col("fp_b")) & (F.bit_count(x) <= most))
    clean = F.array_compact(F.array(*(F.when(F.shiftrightunsigned(x, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) == 0, F.lit(k)) for k in range(len(edges) - 1))))
    own = F.element_at(F.array(*(F.array(*(F.lit(k) for k in c)) for c in chosen)), F.col("combination") + 1)
    return pairs.where(F.slice(clean, 1, len(chosen[0])) == own).select("fp_a", "fp_b", F.bit_count(x).alias("distance"))


def classes(prints: DataFrame, key: str) -> DataFrame:
    """(key, fp, class_id, copies): documents with one fingerprint share a class, named by its smallest key."""
    own = prints.groupBy("fp").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return prints.join(own, "fp").select(key, "fp", "class_id", "copies")


def links(prints: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, class_id, copies, links): per document its class and how many other fingerprints lie within `most` bits."""
    prints = materialize(prints, "prints")  # read three times
    pairs = near_pairs(prints, key, most)
    each = pairs.select(F.explode(F.array("fp_a", "fp_b")).alias("fp"))  # a union would find the pairs twice
    both = each.groupBy("fp").agg(F.count("*").alias("links"))
    return classes(prints, key).join(both, "fp", "left").select(key, "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
