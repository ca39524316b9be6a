"""Token ids of a public byte-level BPE vocabulary, by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is a token as a whole, for all
pre-tokens of a slice of the corpus at once. Tier two: the distinct rest goes through merges taken from a heap over a
linked list of bytes. Pre-tokens are cut by comparing character classes of neighbours, which gives the same pieces as
the vocabulary's pattern.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidloom.llm import codepoints as cp

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE = 1_500_000  # characters that are in work at once
MEMO = 1 << 17  # distinct misses that a worker remembers; long numbers, which hardly recur, are not among them


@dataclass
class PerfectHash:
    """A minimal perfect hash of n 64-bit keys onto 0..n-1 by hash and displace: keys fall into buckets; a bucket of
    several keys stores a seed that sends all of them to free slots, a bucket of one key stores its slot."""

    seeds: np.ndarray  # per bucket: the seed, or -1 - slot
    size: int

    @staticmethod
    def _slots(keys: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
        return (cp.mix(keys ^ (seeds.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        size = len(keys)
        if len(np.unique(keys)) != size:
            raise ValueError("two vocabulary entries have the same 64-bit hash")
        buckets = max(1, size // 4)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=buckets)
        begin = np.cumsum(counts) - counts
        free = np.ones(size, bool)
        seeds = np.zeros(buckets, np.int64)
        left = None
        for b in np.argsort(-counts, kind="stable").tolist():
            n = int(counts[b])
            if n == 0:
                break
            own = keys[order[begin[b] : begin[b] + n]]
            if n == 1:
                left = iter(np.flatnonzero(free).tolist()) if left is None else left
                seeds[b] = -1 - next(left)
                continue
            base, step = 1, 64
            while True:
                tries = np.arange(base, base + step)
                slots = cls._slots(own[None, :], tries[:, None], size)
                good = free[slots].all(1)
                for t in np.flatnonzero(good).tolist():
                    if len(set(slots[t].tolist())) == n:
                        seeds[b], free[slots[t]] = tries[t], False
                        break
                else:
                    base, step = base + step, min(step * 4, 1 << 14)
                    continue
                break
        return cls(seeds, size)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; a key that was not built in gets an arbitrary one."""
        seeds = self.seeds[(keys % np.uint64(len(self.seeds))).astype(np.int64)]
        return np.where(seeds < 0, -1 - seeds, self._slots(keys, np.maximum(seeds, 0), self.size))


@dataclass
class Vocabulary:
    """Everything the workers need; some 2 MB for 50,000 tokens, whatever the corpus."""

    ranks: dict[bytes, int]
    hash: PerfectHash
    keys: np.ndarray  # by slot: 64-bit hash, id, and the place of the code points of the token
    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    points: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        texts, ids = [], []
        for token, rank in ranks.items():
            try:
                texts.append(token.decode("utf-8"))
                ids.append(rank)
            except UnicodeDecodeError:
                pass  # a part of a character is never a pre-token
        points, starts = cp.decode(texts)
        keys = cp.span_hash(cp.prefix_hash(points), starts[:-1], starts[1:])
        perfect = PerfectHash.build(keys)
        slot = perfect.slots(keys)
        place = np.empty(len(keys), np.int64)
        place[slot] = np.arange(len(keys))
        return cls(ranks, perfect, keys[place], np.array(ids, np.int32)[place], starts[:-1][place], np.diff(starts)[place], points)


def pretoken_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: runs of letters, of numbers or of other signs, each with one leading blank; white space
    before that; and the contractions 's 't 'm 'd 're 've 'll."""
    n = len(points)
    kind = cp.classes()[points]
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    new |= first
    joint = np.flatnonzero(new[1:n] & ~first[1:n] & (kind[1:] != cp.SPACE) & (kind[:-1] == cp.SPACE)) + 1
    new[joint - 1] = True
    new[joint[points[joint - 1] == 0x20]] = False
    quote = np.flatnonzero((points[: max(0, n - 1)] == 0x27) & new[: max(0, n - 1)])
    quote = quote[~first[quote + 1] & (kind[quote + 1] == cp.LETTER)]
    if len(quote):
        padded = np.append(points, np.zeros(2, np.uint32))
        a, b = padded[quote + 1], padded[quote + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        inside = ~first[np.minimum(quote + 2, n)]
        long = inside & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for which, length in ((short, 2), (long, 3)):
            at = quote[which]
            new[at + 1] = False
            new[np.minimum(at + length, n)] = True
    return np.flatnonzero(new[:n])


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, the leftmost among equals, is merged until none is left."""
    n = len(token)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 where none starts
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r << 32) | i for i in range(n - 1) if (r := get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        item = pop(heap)
        i, rank = item & 0xFFFFFFFF, item >> 32
        j = end[i]
        if not j or j >= n:
            continue
        stop = end[j]
        if get(token[i:stop]) != rank:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(token[i : end[stop]])) is not None:
                push(heap, (r << 32) | i)
        if (p := before[i]) >= 0 and (r := get(token[p:stop])) is not None:
            push(heap, (r << 32) | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes slices of texts; remembers a bounded number of distinct misses."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo: dict[str, list[int]] = {}

    def _missed(self, token: str) -> list[int]:
        ids = self.memo.get(token)
        if ids is None:
            ids = merge_bytes(token.encode("utf-8", "surrogatepass"), self.v.ranks)
            if len(token) < 6 or not token[-1].isdigit():
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[token] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text start, with the end as the last entry."""
        v = self.v
        joined = "".join(texts)
        points, text_starts = cp.decode(texts)
        starts = pretoken_starts(points, text_starts)
        ends = np.append(starts[1:], len(points))[: len(starts)]
        keys = cp.span_hash(cp.prefix_hash(points), starts, ends)
        slot = v.hash.slots(keys)
        hit = (v.keys[slot] == keys) & (v.lengths[slot] == ends - starts)
        at = np.flatnonzero(hit)
        hit[at] = cp.equal_spans(points, starts[at], v.points, v.starts[slot[at]], v.lengths[slot[at]])
        counts = np.ones(len(starts), np.int64)
        miss = np.flatnonzero(~hit)
        _, some, which = np.unique(keys[miss], return_index=True, return_inverse=True)
        lead = miss[some]
        distinct = [self._missed(joined[a:b]) for a, b in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)]
        same = (ends - starts)[miss] == (ends - starts)[lead][which]
        same[same] = cp.equal_spans(points, starts[miss[same]], points, starts[lead[which[same]]], (ends - starts)[miss[same]])
        for k in np.flatnonzero(~same).tolist():  # two pre-tokens with one hash
            which[k] = len(distinct)
            distinct.append(self._missed(joined[starts[miss[k]] : ends[miss[k]]]))
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        counts[miss] = sizes[which]
        to = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=to[1:])
        out = np.empty(to[-1], np.int32)
        out[to[:-1][hit]] = v.ids[slot[hit]]
        if len(miss):
            pool = np.fromiter((i for ids in distinct for i in ids), np.int32, int(sizes.sum()))
            out[cp.spread(to[miss], sizes[which])] = pool[cp.spread((np.cumsum(sizes) - sizes)[which], sizes[which])]
        return out, to[np.searchsorted(starts, text_starts)]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; strings that look like one are ordinary text.

    vocabulary: path of a file of base64 tokens and ranks, read on the driver. Null and empty texts give an empty list;
    a text of any length is encoded whole; repeated rows and keys stay as they are; further columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
                ids, offsets = encoder.encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")
