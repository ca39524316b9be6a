"""Records that differ in formatting only, collapsed by rolling hashes of their folded letters and digits.

A lookup table skips every other character and folds letter case while whole batches stream through into rolling
polynomial hashes: a sign's weight is a power of how many signs come before it, a skipped character adds nothing, so no
canonical string is ever made. Rows whose hashes agree are compared by two pointers that skip what does not count. A text
of several `label: value` fields also gets a key that does not depend on their order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm import codepoints as cp
from evidloom.operators.skew import hot_keys, hot_of, spread_join
from evidloom.session import materialize

SLICE = 1_500_000  # characters that are in work at once
SEPARATORS = [*map(ord, "|;\n\r"), 0x85, 0x2028, 0x2029]  # between fields: the bar, the semicolon and line breaks
COLONS = [ord(":"), 0xFF1A]
_SECOND = np.uint64(0x9FB21C651E98DF25)


class RollingHash:
    """Prefix sums over the code points of a batch, from which the hash of any span's folded signs is made."""

    def __init__(self, points: np.ndarray, factor: int = 1, shift: int = 0) -> None:
        tables = cp.folds()
        found = [t[points] for t in tables]
        self.before = np.zeros(len(points) + 1, np.int64)  # signs before each code point
        np.cumsum(sum((f > 0).astype(np.int64) for f in found), out=self.before[1:])
        up, self._down = cp.powers(int(self.before[-1]) + 2)
        weight = np.zeros(len(points), np.uint64)
        for k, f in enumerate(found):  # only a few characters fold to two or three signs
            has = np.flatnonzero(f)
            value = f[has] * np.uint32(factor) + np.uint32(shift)
            weight[has] += (value.astype(np.uint64) + np.uint64(1)) * up[self.before[has] + k]
        self._sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(weight, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (self.before[ends] - self.before[starts]).astype(np.uint64)
        return cp.mix((self._sums[ends] - self._sums[starts]) * self._down[self.before[starts]] + size)


def _pairs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per text: two hashes of its sequence, its length, and two of its fields with a flag whether it has several."""
    points, starts = cp.decode(texts)
    hashes = RollingHash(points), RollingHash(points, 2654435761, 12345)
    before = hashes[0].before
    n = len(texts)
    sequence = [h.of(starts[:-1], starts[1:]) for h in hashes]
    # parts between separators; a part is a field if a colon stands in it after a label
    edge = np.zeros(len(points) + 1, bool)
    edge[starts] = True
    breaks = np.flatnonzero(np.isin(points, SEPARATORS))
    edge[breaks] = True
    a = np.flatnonzero(edge[: len(points)])
    z = np.append(a[1:], len(points))[: len(a)]
    owner = np.searchsorted(starts, a, side="right") - 1
    full = before[z] > before[a]
    a, z, owner = a[full], z[full], owner[full]
    colons = np.flatnonzero(np.isin(points, COLONS))
    k = np.searchsorted(colons, a)
    colon = np.append(colons, len(points))[k]
    is_field = (colon < z) & (before[np.minimum(colon, len(points))] > before[a])
    mid = np.where(is_field, colon, a)
    parts, fields = np.bincount(owner, minlength=n), np.bincount(owner, weights=is_field, minlength=n)
    several = (parts > 1) & (parts == fields)
    sums = []
    for own in hashes:
        h = cp.mix(own.of(a, mid) * _SECOND + own.of(mid, z))
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, h)
        sums.append(cp.mix(total + parts.astype(np.uint64)))
    return (*sequence, before[starts[1:]] - before[starts[:-1]], *sums, several)


def _binary(a: np.ndarray, b: np.ndarray) -> pa.Array:
    raw = np.stack([a.byteswap(), b.byteswap()], 1).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(raw)]).cast(pa.binary())


def keyed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, sequence, fields): 128-bit keys; fields is null unless the text has several `label: value` fields.
    Texts without any letter or digit, and nulls, are left out."""
    source = rows.select(key, text).where(F.col(text).isNotNull())
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
                s1, s2, size, f1, f2, several = _pairs(texts[i:j])
                keep = pa.array(size > 0)
                fields = pc.if_else(pa.array(several), _binary(f1, f2), pa.scalar(None, pa.binary()))
                out = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), _binary(s1, s2), fields], names=[key, text, "sequence", "fields"])
                yield out.filter(keep)

    return source.mapInArrow(run, f"`{key}` {kind}, `{text}` string, sequence binary, fields binary")


_SOLID = re.compile(r"[^\W_]+")


@lru_cache(1)
def _odd() -> dict[int, str]:
    """Code points outside of ASCII that fold to something else, with what they fold to."""
    one, two, three = cp.folds()
    changed = np.flatnonzero((one > 0) & ((one != np.arange(len(one))) | (two > 0)))
    return {c: "".join(chr(x) for x in (one[c], two[c], three[c]) if x) for c in changed.tolist()}


def _fold(piece: str) -> str:
    """Letters and digits, folded as the tables of codepoints.folds() have it."""
    return piece.lower() if piece.isascii() else piece.translate(_odd())


def same_sequence(a: str, b: str) -> bool:
    """Whether the letters and digits of two texts are the same sequence: two pointers walk over both, from one run of
    letters and digits to the next, and compare what is under them; nothing longer than a run is ever folded."""
    if a == b:
        return True
    left, right = _SOLID.finditer(a), _SOLID.finditer(b)
    x = y = ""
    while True:
        if not x and (m := next(left, None)):
            x = _fold(m[0])
        if not y and (m := next(right, None)):
            y = _fold(m[0])
        if not x or not y:
            return x == y
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return False
        x, y = x[n:], y[n:]


def _fields(text: str) -> list[tuple[str, str]] | None:
    """The canonical fields of one text, for the comparison of two texts whose fields are ordered differently."""
    parts = "".join("\n" if ord(c) in SEPARATORS else ":" if ord(c) in COLONS else c for c in text).split("\n")

    def solid(s: str) -> str:
        return "".join(_fold(m[0]) for m in _SOLID.finditer(s))

    out = []
    for part in parts:
        if solid(part):
            label, colon, value = part.partition(":")
            if not colon or not solid(label):
                return None
            out.append((solid(label), solid(value)))
    return sorted(out) if len(out) > 1 else None


def same_text(a: list[str], b: list[str]) -> np.ndarray:
    """Whether the texts of each pair are the same but for formatting and the order of their fields."""
    same = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        same[k] = same_sequence(x, y) or ((fields := _fields(x)) is not None and fields == _fields(y))
    return same


def _components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node of each node's component, given (u, v). Large and small stars in turn, each of which
    halves what is left, so the number of rounds grows with the logarithm of a component's size."""

    def heads(links: DataFrame, least: DataFrame) -> DataFrame:
        return spread_join(links, least, ["u"], ["v"], hot_keys(links, ["u"]))

    def fingerprint(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    links, known = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"), None
    while (now := fingerprint(links)) != known:
        known = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(heads(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = heads(large, down).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        links = materialize(small.where("u <> v").distinct(), "links")
    return links.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "node")


def _groups(sequences: DataFrame, keys: DataFrame) -> DataFrame:
    """(sequence, first, n, gid): sequences that share a key of fields, however indirectly, have one gid."""
    if sequences.where("low <> high").isEmpty():
        return sequences.select("sequence", "first", "n", F.coalesce("low", "sequence").alias("gid"))
    # some sequence of letters was divided into fields in several ways
    divided = keys.where("fields is not null").select(F.col("sequence").alias("u"), F.col("fields").alias("v")).distinct()
    tagged = _components(divided.select(F.concat(F.lit("s").cast("binary"), "u").alias("u"), F.concat(F.lit("f").cast("binary"), "v").alias("v")))
    mine = tagged.where(F.substring("node", 1, 1) == F.lit("s").cast("binary")).select(F.expr("substring(node, 2)").alias("sequence"), F.col("least").alias("gid"))
    return sequences.join(mine, "sequence", "left").select("sequence", "first", "n", F.coalesce("gid", "sequence").alias("gid"))


def duplicates(rows: DataFrame, key: str = "load_seq", text: str = "original_question", least: int | None = None) -> DataFrame:
    """(key, first, copies): for every row with a letter or digit, the smallest key of its group and the group's size.

    Two texts are in a group if their letters and digits, case-folded, are the same sequence, or if both consist of the
    same `label: value` fields (two or more, between `|`, `;` or line breaks) in any order. Each row is compared with the
    first of its sequence, and for each way in which a sequence is divided into fields one row with the first of these fields. Null texts, and texts with
    no letter or digit, ask nothing and do not appear. Keys must be unique. Rows that share both hashes without being
    the same, if ever, are regrouped by an exact digest.

    Counting combines before its shuffle, sequences and not rows are grouped further, and the rows of a question that very
    many repeat (`least` and more) are dealt to several tasks.
    """
    hot = {} if least is None else {"least": least}
    kind = rows.schema[key].dataType.simpleString()
    keys = materialize(keyed(rows, key, text), "question-keys")
    sequences = materialize(keys.groupBy("sequence").agg(F.min(key).alias("first"), F.count("*").alias("n"), F.min("fields").alias("low"), F.max("fields").alias("high")), "question-sequences")
    groups = _groups(sequences, keys)
    totals = groups.groupBy("gid").agg(F.min("first").alias("head"), F.sum("n").alias("copies"), F.count("*").alias("parts"))
    groups = materialize(spread_join(groups, totals, ["gid"], ["sequence"], hot_of(totals, ["gid"], "parts", **hot)), "question-groups")
    on, frequent = ["sequence"], hot_of(sequences, ["sequence"], **hot)
    own = keys.select(key, F.col(text).alias("text"))
    like = own.select(F.col(key).alias("first"), F.col("text").alias("like"))
    several = sequences.where("n > 1").select("sequence", "first").join(like, "first").select("sequence", "like")
    copies = spread_join(keys.select(key, "sequence", F.col(text).alias("text")), several, on, [key], frequent).select(key, "text", "like")
    # of each sequence with certain fields, one row is compared with the first row that has these fields
    ways = materialize(keys.where("fields is not null").groupBy("fields", "sequence").agg(F.min(key).alias(key)), "question-ways")
    tops = ways.groupBy("fields").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    other = spread_join(ways, tops, ["fields"], [key], hot_of(tops, ["fields"], **hot)).where(F.col(key) != F.col("first")).select(key, "first")
    ordered = spread_join(other, like, ["first"], [key], hot_keys(other, ["first"], **hot)).join(own, key).select(key, "text", "like")

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0]).filter(pa.array(~same_text(b.column(1).to_pylist(), b.column(2).to_pylist())))

    odd = materialize(copies.unionByName(ordered).mapInArrow(differing, f"`{key}` {kind}"), "question-odd")
    placed = spread_join(keys.select(key, "sequence"), groups.select("sequence", F.col("head").alias("first"), "copies"), on, [key], frequent).select(key, "first", "copies")
    return placed if odd.isEmpty() else _regrouped(placed, placed.join(odd, key, "left_semi").select("first").distinct(), keys, key, text)


def _regrouped(placed: DataFrame, bad: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """The groups in which a comparison failed, by an exact digest of each row instead; all others as they are."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact = [hashlib.sha256(repr(_fields(t) or "".join(_fold(m[0]) for m in _SOLID.finditer(t))).encode("utf-8", "surrogatepass")).digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, pa.binary())], names=[key, "exact"])

    rows = placed.join(bad, "first", "left_semi").select(key)
    exact = keys.join(rows, key, "left_semi").select(key, text).mapInArrow(digest, f"`{key}` {placed.schema[key].dataType.simpleString()}, exact binary")
    own = exact.groupBy("exact").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    return placed.join(bad, "first", "left_anti").select(key, "first", "copies").unionByName(exact.join(own, "exact").select(key, "first", "copies"))


def collapse(rows: DataFrame, key: str = "load_seq", text: str = "original_question") -> DataFrame:
    """One row per question: (key, text, copies) of its first row."""
    heads = duplicates(rows, key, text).where(F.col(key) == F.col("first")).select(key, "copies")
    return rows.select(key, text).join(heads, key)
