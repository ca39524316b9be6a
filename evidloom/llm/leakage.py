"""Held-out test items in a corpus, by a generalised suffix automaton over the items' words.

The automaton and its word list are built on the driver from one block of items at a time, so what is broadcast is
bounded by `block_words`, not by the number or the length of items: a longer item is cut into overlapping sections. With
several blocks each one's result is written to shared storage and its automaton released before the next is made, as a
stated query set is searched in blocks. Documents stream past: their words are looked up for whole slices
at once, and the automaton runs over those stretches in which enough successive words occur in the items at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidloom.functions.text import bind
from evidloom.llm import codepoints as cp
from evidloom.session import materialize

SLICE = 1_500_000  # characters that are in work at once
BLOCK_WORDS = 400_000  # words of test items in one automaton: some 150 MB in a worker at most


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Case-folded words, the longest runs of letters and digits: hash, text, and start and end in the joined texts;
    and the folded code points."""
    points, starts = cp.decode(texts)
    one, two, three = cp.folds()
    folded = one[points]
    wordy = np.zeros(len(points) + 2, bool)
    wordy[1:-1] = folded > 0
    inner = starts[1:-1]
    opens = wordy[1:-1] & ~wordy[:-2]
    closes = wordy[1:-1] & ~wordy[2:]
    inner = inner[(inner > 0) & (inner < len(points))]
    opens[inner] |= folded[inner] > 0
    closes[inner - 1] |= folded[inner - 1] > 0
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    symbols = folded.astype(np.uint64) + (two[points].astype(np.uint64) << np.uint64(21)) + (three[points].astype(np.uint64) << np.uint64(42))
    many = np.flatnonzero(two[points])
    if len(many):  # characters that fold to several are written out, so that words compare by their folded signs
        width = np.ones(len(points), np.int64)
        width[many] += 1 + (three[points[many]] > 0)
        to = np.cumsum(width) - width
        symbols = np.zeros(int(width.sum()), np.uint64)
        symbols[to] = folded
        symbols[to[many] + 1] = two[points[many]]
        third = many[three[points[many]] > 0]
        symbols[to[third] + 2] = three[points[third]]
        lo = to[begin]
        hi = (to + width)[end - 1] if len(end) else end
    else:
        lo, hi = begin, end
    keys = cp.span_hash(cp.prefix_hash(symbols), lo, hi)
    return keys, np.searchsorted(starts, begin, side="right") - 1, begin, end, starts


@dataclass
class SuffixAutomaton:
    """Accepts every run of successive words of every item; knows which items hold each run of `least` words."""

    least: int
    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    items: dict[int, list[int]] = field(default_factory=dict)

    def _state(self, size: int, go: dict[int, int], link: int) -> int:
        self.go.append(go), self.size.append(size), self.link.append(link)
        return len(self.go) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for its strings of length size[p] + 1 and less."""
        copy = self._state(self.size[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if (q := self.go[last].get(word)) is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
                continue
            new = self._state(self.size[last] + 1, {}, 0)
            p = last
            while p >= 0 and word not in self.go[p]:
                self.go[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.go[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            last = new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The longest run of item words that ends with this word."""
        while state and word not in self.go[state]:
            state = self.link[state]
            matched = self.size[state]
        nxt = self.go[state].get(word)
        return (nxt, matched + 1) if nxt is not None else (0, 0)

    def holder(self, state: int) -> int:
        """The state of the last `least` words of a run that is at least as long."""
        while self.size[self.link[state]] >= self.least:
            state = self.link[state]
        return state

    def own(self, item: int, sequence: list[int]) -> None:
        """Note the item at each of its runs of `least` words; to be called when all items are added."""
        state = matched = 0
        for word in sequence:
            state, matched = self.step(state, matched, word)
            if matched >= self.least:
                held = self.items.setdefault(self.holder(state), [])
                if not held or held[-1] != item:
                    held.append(item)


@dataclass
class Matcher:
    automaton: SuffixAutomaton
    keys: np.ndarray  # sorted word hashes; the place is the word's number

    @classmethod
    def build(cls, items: list[tuple[int, str]], least: int) -> Matcher:
        keys, owner, *_ = words([t for _, t in items])
        distinct = np.unique(keys)
        numbers = np.searchsorted(distinct, keys)
        edges = np.searchsorted(owner, np.arange(len(items) + 1))
        automaton = SuffixAutomaton(least)
        sequences = [(item, numbers[a:b].tolist()) for (item, _), a, b in zip(items, edges[:-1], edges[1:], strict=True)]
        for _, sequence in sequences:
            automaton.add(sequence)
        for item, sequence in sequences:
            automaton.own(item, sequence)
        return cls(automaton, distinct)

    def spans(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, words matched, start, end, number of its first word) of every longest stretch of a text that
        stands in an item."""
        least, auto = self.automaton.least, self.automaton
        keys, owner, begin, end, starts = words(texts)
        if len(keys) < least or not len(self.keys):
            return
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[place] == keys
        breaks = np.ones(len(keys) + 1, bool)
        breaks[1:-1] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(breaks)
        stretch = np.flatnonzero(known[at[:-1]] & (np.diff(at) >= least))
        for a, b in zip(at[stretch].tolist(), at[stretch + 1].tolist(), strict=True):
            state = matched = 0
            open_: dict[int, tuple[int, int]] = {}  # item -> first and last word of the span that is growing
            doc, zero = int(owner[a]), int(starts[owner[a]])
            nought = int(np.searchsorted(owner, doc))
            done: list[tuple[int, int, int]] = []
            for k, word in enumerate(place[a:b].tolist(), a):
                state, matched = auto.step(state, matched, word)
                hit = auto.items.get(auto.holder(state), ()) if matched >= least else ()
                for item in [i for i in open_ if i not in hit]:
                    done.append((item, *open_.pop(item)))
                for item in hit:
                    open_[item] = (open_[item][0] if item in open_ else k - least + 1, k)
            done += [(i, *s) for i, s in open_.items()]
            for item, first, last in done:
                yield doc, item, last - first + 1, int(begin[first]) - zero, int(end[last]) - zero, first - nought


def _sections(item: int, text: str, most: int, least: int) -> Iterator[tuple[int, str, int]]:
    """(item, text, words) of an item in sections of at most `most` words, each of which repeats the last `least` - 1 words
    of the one before, so that every run of `least` words lies in one section."""
    _, _, begin, end, _ = words([text])
    n = len(begin)
    if n <= most:
        yield item, text, n
        return
    for first in range(0, n - least + 1, most - least + 1):
        last = min(first + most, n) - 1
        yield item, text[begin[first] : end[last]], last - first + 1
        if last == n - 1:
            return


def _blocks(items: DataFrame, item_key: str, text: str, block_words: int, least: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks, and whether one of a block's items is cut; they come to the driver one after the other, never
    all at once."""
    block, total, cut = [], 0, False
    for item, t in items.select(item_key, text).where(F.col(text).isNotNull() & F.col(item_key).isNotNull()).toLocalIterator():
        for k, (_, section, n) in enumerate(_sections(item, t, max(block_words, 2 * least), least)):
            if block and total + n > block_words:
                yield block, cut
                block, total, cut = [], 0, k > 0
            block.append((item, section))
            total += n
            cut = cut or k > 0
    if block:
        yield block, cut


def _merged(spans: DataFrame, key: str, item_key: str, least: int) -> DataFrame:
    """Spans of one document and item whose runs of `least` words follow one another as one span."""
    by = Window.partitionBy(key, item_key).orderBy("first", "words")
    until = F.max(F.col("first") + F.col("words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    edge = F.coalesce(F.col("first") > until - least + 1, F.lit(True)).cast("int")
    marked = spans.withColumn("_edge", edge).withColumn("_run", F.sum("_edge").over(by))
    last = F.max(F.col("first") + F.col("words"))
    return marked.groupBy(key, item_key, "_run").agg((last - F.min("first")).cast("int").alias("words"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first")).drop("_run")


def leaked_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = 12, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item_key, words, start, end): each stretch of a document, in code points, in which at least `least`
    successive words are successive words of an item, letter case and signs between words aside.

    A stretch is joined from overlapping matches of one item. Null and empty texts and items give none, nor do items of
    fewer words; repeated items each count. The corpus is passed once for each block of items. No items: no rows.
    """
    spark = docs.sparkSession
    item_type = to_arrow_type(items.schema[item_key].dataType)
    names = [key, item_key, "words", "start", "end", "first"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, words int, start int, end int, first int"
    rows = docs.where(F.col(text).isNotNull()).select(key, text)

    def search(block: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(Matcher.build(block, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).to_pylist()
                for i, j in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
                    got = list(shared.value.spans(texts[i:j]))
                    columns = list(zip(*got, strict=True)) if got else [()] * 6
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + d for d in columns[0]], pa.int64())), pa.array(columns[1], item_type), *(pa.array(c, pa.int32()) for c in columns[2:])], names=names)

        return rows.mapInArrow(run, schema), shared

    found, sections, waiting = [], False, None
    for block, cut in _blocks(items, item_key, text, block_words, least):
        if waiting:
            part, shared = search(waiting)
            found.append(materialize(part, "leaked-spans"))
            shared.destroy()
        waiting, sections = block, sections or cut
    if waiting is None:
        return spark.createDataFrame([], schema).drop("first")
    part, shared = search(waiting)
    if found:  # the last of several blocks is released like the others
        found.append(materialize(part, "leaked-spans"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, found) if found else part
    return (_merged(every, key, item_key, least) if sections else every).select(*names[:5])


def remove_leaks(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 16, coverage: float = 0.05) -> DataFrame:
    """(key, text, removed): documents without leaked spans of more than `longest` words, or without any of their leaked
    spans where these make up more than `coverage` of the text. Other documents come out as they are.

    What leaked is the union of a document's spans: a passage that several items hold counts once. key must be unique. A
    span is replaced by one blank.
    """
    kind = "array<struct<start:int,end:int,words:int>>"
    per_doc = spans.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end", "words"))).alias("_spans"))

    def union(found: Column) -> Column:
        """(until, total) of sorted spans."""
        return F.aggregate(
            found,
            F.struct(F.lit(0).alias("until"), F.lit(0).alias("total")),
            lambda acc, s: F.struct(F.greatest(acc["until"], s["end"]).alias("until"), (acc["total"] + F.greatest(s["end"] - F.greatest(s["start"], acc["until"]), F.lit(0))).alias("total")),
        )

    joined = docs.select(key, text).join(per_doc.withColumn("_chars", union(F.col("_spans"))["total"]), key, "left")
    out = F.filter("_spans", lambda s: (s["words"] > longest) | (F.col("_chars") > coverage * F.char_length(text)))
    cut = F.aggregate(
        F.coalesce(out, F.array().cast(kind)),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("at"), F.lit(0).alias("gone")),
        lambda acc, s: F.struct(
            F.when(s["start"] > acc["at"], F.array_append(acc["done"], F.concat(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(" ")))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
            (acc["gone"] + F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))).alias("gone"),
        ),
    )
    rest = F.substring(F.col(text), F.col("_cut.at") + 1, F.char_length(text))
    return bind(joined, "_cut", cut).select(key, F.concat(F.array_join("_cut.done", ""), rest).alias(text), F.col("_cut.gone").alias("removed"))
