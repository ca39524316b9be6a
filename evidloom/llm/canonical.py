"""Freely typed values mapped to the entries of a reference list, by a trie searched with a Levenshtein automaton.

The trie holds every path by which an entry may be meant: its value, its labels, its aliases, and their
transliterations. The automaton's state is a band of edit distances, as wide as the most edits allow; a branch of the
trie is left as soon as its smallest distance exceeds what the paths below it allow. All entries within distance come
out; one of them is then chosen. A long list is searched in blocks of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.operators.skew import hot_keys, spread_join
from evidloom.session import materialize

UNMATCHED = "unmatched"
BLOCK_PATHS = 50_000  # labels and aliases in one trie: some 100 MB in a worker at most
_TRANSLITERATED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
_JOINTS = re.compile("[\\s_\\-\u2010-\u2015\u200b\ufeff]+")


def allowed(length: int) -> int:
    """Edits that a path of this length forgives: none below 3 letters, 1 up to 5, 2 up to 8, then 3."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 9 else 3


def fold(text: str) -> str:
    """Case, width and accents of composition aside, with one blank for each joint."""
    return _JOINTS.sub(" ", unicodedata.normalize("NFKC", text).casefold()).strip()


def readings(raw: str) -> list[str]:
    """What a typed value may say, from most to least literal: as it stands, without signs around it, without a label in
    front, without a remark behind."""
    whole = fold(raw)
    out = [whole]

    def add(s: str) -> None:
        s = re.sub(r"^\W+|\W+$", "", s)
        if s and s not in out:
            out.append(s)

    add(whole)
    core = re.sub(r"^\W+", "", whole)
    unlabelled = re.sub(r"^[^\W\d_]{2,12} ?[:=]\s*", "", core)
    add(unlabelled)
    add(re.split(r"[,;/(\[|]| [?!–-]", unlabelled, maxsplit=1)[0])
    return out


@dataclass(slots=True)
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    ends: list[tuple[str, str]] = field(default_factory=list)  # (entry, path)
    reach: int = 0  # the most edits that any path below allows


class Trie:
    def __init__(self) -> None:
        self.root = Node()
        self.longest = 0

    def add(self, entry: str, path: str) -> None:
        limit = allowed(len(path))
        self.longest = max(self.longest, len(path))
        node = self.root
        node.reach = max(node.reach, limit)
        for c in path:
            node = node.next.setdefault(c, Node())
            node.reach = max(node.reach, limit)
        if (entry, path) not in node.ends:
            node.ends.append((entry, path))

    def search(self, text: str) -> list[tuple[int, str, str]]:
        """(distance, entry, path) of every path within what its length allows; a swap of neighbours is one edit.

        A row holds the distances of a prefix of length i to the prefixes of the text of lengths i - k to i + k, k being
        the most edits that any path allows; all others are larger than k.
        """
        k, n, found = self.root.reach, len(text), []
        if n > self.longest + k:
            return found
        far = k + 1
        start = [far] * k + [min(j, far) if j <= n else far for j in range(k + 1)] + [far]
        stack: list[tuple[Node, str, int, list[int], list[int] | None, str]] = [(m, c, 1, start, None, "") for c, m in self.root.next.items()]
        while stack:
            node, c, i, above, two_above, last = stack.pop()
            row, left, low = [], far, far
            for b in range(2 * k + 1):
                j = i + b - k
                if j < 0 or j > n:
                    d = far
                elif j == 0:
                    d = i
                else:
                    t = text[j - 1]
                    d = above[b] if t == c else above[b] + 1
                    if above[b + 1] < d:
                        d = above[b + 1] + 1
                    if left < d:
                        d = left + 1
                    if two_above is not None and j > 1 and last == t and c == text[j - 2] and two_above[b] < d:
                        d = two_above[b] + 1
                row.append(d)
                left = d
                if d < low:
                    low = d
            row.append(far)
            end = n - i + k
            if node.ends and 0 <= end <= 2 * k and row[end] <= node.reach:
                found += [(row[end], entry, path) for entry, path in node.ends if row[end] <= allowed(len(path))]
            if min(low, min(above)) <= node.reach:
                stack += [(m, x, i + 1, row, above, c) for x, m in node.next.items()]
        return found


def build_trie(entries: Iterable[tuple[str, Iterable[str | None]]]) -> Trie:
    """A trie of (canonical value, its labels), each also transliterated."""
    trie = Trie()
    for value, labels in entries:
        for label in (value, *labels):
            if label and label.strip():
                path = fold(label)
                trie.add(value, path)
                trie.add(value, path.translate(_TRANSLITERATED))
    return trie


Found = list[tuple[int, str, str]]  # (distance, entry, path)


def candidates(trie: Trie, raw: str) -> Iterator[tuple[int, Found]]:
    """(number of the reading, all entries within distance) of the readings that have any."""
    for k, reading in enumerate(readings(raw)):
        if got := trie.search(reading):
            yield k, got


def choose(found: Found) -> tuple[str, int | None]:
    """(entry or `unmatched`, distance): the nearest entry; if two are equally near, the one whose path differs less for
    its length; a full tie is unmatched."""
    best: dict[str, tuple[int, float]] = {}
    for d, entry, path in found:
        score = (d, d / len(path))
        if entry not in best or score < best[entry]:
            best[entry] = score
    ranked = sorted(best.items(), key=lambda e: e[1])
    if not ranked or len(ranked) > 1 and ranked[0][1] == ranked[1][1]:
        return UNMATCHED, None
    return ranked[0][0], ranked[0][1][0]


def match(trie: Trie, raw: str) -> tuple[str, int | None]:
    """choose() among the entries of the most literal reading that has any."""
    return choose(next((f for _, f in candidates(trie, raw)), []))


def _blocks(reference: DataFrame, aliases: DataFrame | None, most: int) -> Iterator[Trie]:
    """The paths in tries of at most `most` labels; entries come to the driver one after the other, never all at once."""
    value = reference.columns[0]
    rows = reference.select(value, F.array(*(F.col(c) for c in reference.columns)).alias("labels"))
    if aliases is not None:
        rows = rows.unionByName(aliases.select(F.col(aliases.columns[0]).alias(value), F.array(aliases.columns[1]).alias("labels")))
    block: list[tuple[str, list[str]]] = []
    for r in rows.where(F.col(value).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) * len(reference.columns) >= most:
            yield build_trie(block)
            block = []
    yield build_trie(block)


_CANDIDATES = "array<struct<distance:int,entry:string,path:string>>"
_CANDIDATES_TYPE = pa.list_(pa.struct([("distance", pa.int32()), ("entry", pa.string()), ("path", pa.string())]))


def _as_structs(found: Found) -> list[dict]:
    return [{"distance": d, "entry": e, "path": p} for d, e, p in sorted(set(found))]


def _result(found: list[Found]) -> list[pa.Array]:
    chosen = [choose(f) for f in found]
    return [pa.array([c[0] for c in chosen], pa.string()), pa.array([c[1] for c in chosen], pa.int32()), pa.array([_as_structs(f) for f in found], _CANDIDATES_TYPE)]


def map_values(rows: DataFrame, column: str, reference: DataFrame, keep: list[str], aliases: DataFrame | None = None, block_paths: int = BLOCK_PATHS) -> DataFrame:
    """(keep..., column, canon_value, distance, candidates) of every row whose value is not null or blank.

    reference: (canon_value, label...) rows of one list; aliases: (canon_value, alias) rows, more paths to the same
    entries, not matched literally only but with the same tolerance. candidates are all entries within distance of the
    most literal reading that has any, nearest first; canon_value is the one chosen, or `unmatched`.

    Values are looked up once for each distinct one of a batch, so no shuffle is needed and a value that a third of the
    rows share costs nothing. A list of more than `block_paths` labels is searched in blocks: the distinct values pass
    once for each block, whose trie is then released, and the rows get the merged result by a join in which frequent
    values are dealt to several tasks. With an empty reference everything is unmatched. Columns not named are ignored.
    """
    kept = rows.select(*keep, column).where(F.col(column).rlike(r"(?U)[^\s\x{200B}\x{FEFF}]"))
    blocks = _blocks(reference, aliases, block_paths)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _map_batches(kept, column, keep, first)
    values = materialize(kept.select(F.col(column).alias("value")).distinct(), "typed-values")
    found = reduce(DataFrame.unionByName, (_search_block(values, trie) for trie in chain((first, second), blocks)))
    per_reading = found.groupBy("value", "reading").agg(F.collect_list(F.struct("distance", "entry", "path")).alias("found"))
    best = per_reading.groupBy("value").agg(F.min_by("found", "reading").alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[(c["distance"], c["entry"], c["path"]) for c in f] for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *_result(got)], names=["value", "canon_value", "distance", "candidates"])

    chosen = best.mapInArrow(run, f"value string, canon_value string, distance int, candidates {_CANDIDATES}").withColumnRenamed("value", column)
    joined = spread_join(kept, chosen, [column], keep, hot_keys(kept, [column]), "left")
    return joined.select(*keep, column, F.coalesce("canon_value", F.lit(UNMATCHED)).alias("canon_value"), "distance", F.coalesce("candidates", F.array().cast(_CANDIDATES)).alias("candidates"))


def _search_block(values: DataFrame, trie: Trie) -> DataFrame:
    """(value, reading, distance, entry, path) of all readings in one block, written to shared storage."""
    shared = values.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(v, k, *f) for v in b.column(0).to_pylist() for k, found in candidates(shared.value, v) for f in found]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), *(pa.array(c, pa.string()) for c in columns[3:])], names=["value", "reading", "distance", "entry", "path"])

    got = materialize(values.mapInArrow(run, "value string, reading int, distance int, entry string, path string"), "typed-found")
    shared.destroy()
    return got


def _map_batches(kept: DataFrame, column: str, keep: list[str], trie: Trie) -> DataFrame:
    shared = kept.sparkSession.sparkContext.broadcast(trie)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    names = [*keep, column, "canon_value", "distance", "candidates"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Found] = {}
        for b in batches:
            coded = pc.dictionary_encode(b.column(b.num_columns - 1))
            if len(memo) > 200_000:
                memo.clear()
            got = [memo[v] if v in memo else memo.setdefault(v, next((f for _, f in candidates(shared.value, v)), [])) for v in coded.dictionary.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(a.take(coded.indices) for a in _result(got))], names=names)

    return kept.mapInArrow(run, f"{schema}, canon_value string, distance int, candidates {_CANDIDATES}")
