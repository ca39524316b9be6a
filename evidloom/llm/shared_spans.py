"""Long exact spans that different documents share, by content-defined chunking with a gear rolling hash.

Cut points are local minima of the gear hash, so equal passages are cut alike wherever they stand. From each cut a
variable chunk runs to the first cut at least `reach` code points on; chunks overlap, and for the parameters below every
shared span of `least` code points holds a whole one. Chunks are deduplicated by digest; two documents become a
candidate where their common chunks begin, that is, where the chunk before differs; an exact comparison follows.

Digests that very many documents have are found first, by a sketch of fixed size; their rows are combined before any
shuffle and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.llm import codepoints as cp
from evidloom.llm import gear
from evidloom.operators.skew import HOT_ROWS, hot_of, hot_values, join_groups, spread_join
from evidloom.session import materialize

SLICE = 600_000  # characters that are in work at once
HOT = 64  # rows with one digest above which documents are matched by their spans before they meet
PART = 1000  # rows of a hot span that one task pairs with all others


def geometry(least: int) -> tuple[int, int, int]:
    """(window of the cut points, reach of a chunk, largest distance from a shared span's start to its first chunk).

    In a shared span that starts at a, hashes agree from a + WINDOW - 1 on and the first full window of them gives a cut
    p <= a + WINDOW - 1 + window - 1. The chunk's end q < p + reach + window is a cut in both documents if the windows
    around it end in the span: q + window - 1 < a + least. Hence reach <= least - WINDOW - 3 * window + 3. The window is
    the largest for which a chunk is no shorter than it.
    """
    window = max(2, (least - gear.WINDOW) // 4)
    lead = gear.WINDOW - 1 + window - 1
    reach = least - 1 - lead - 2 * (window - 1)
    if reach < window:
        raise ValueError(f"spans of {least} code points are too short to hold a chunk")
    return window, reach, lead


def _chunks(texts: list[str], ids: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, ...]:
    """Digest, key of the chunk before, document and position of each chunk."""
    points, starts = cp.decode(texts)
    cuts = gear.landmarks(points, starts, window)
    nxt = np.searchsorted(cuts, cuts + reach)
    closed = nxt < len(cuts)
    cuts_from, cuts_to = cuts[closed], cuts[nxt[closed]]
    owner = np.searchsorted(starts, cuts_from, side="right") - 1
    inside = cuts_to < starts[owner + 1]
    cuts_from, cuts_to, owner = cuts_from[inside], cuts_to[inside], owner[inside]
    digest = cp.span_hash(cp.prefix_hash(points), cuts_from, cuts_to)
    before = cp.mix(ids[owner].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))  # no chunk before: as unlike all others
    if len(cuts_from) > 1:
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        gap = (cuts_from[follows] - cuts_from[follows - 1]).astype(np.uint64)
        before[follows] = cp.mix(digest[follows - 1] + gap * np.uint64(0xD1342543DE82EF95))
    return digest.view(np.int64), before.view(np.int64), ids[owner], (cuts_from - starts[owner]).astype(np.int32)


def chunk_table(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(digest, before, doc, pos) of all chunks of all texts of at least `least` code points."""
    window, reach, _ = geometry(least)
    rows = docs.where(F.char_length(text) >= least).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i, j in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _chunks(texts[i:j], ids[i:j], window, reach)], names=["digest", "before", "doc", "pos"])

    return rows.mapInArrow(run, "digest long, before long, doc long, pos int")


def branch_points(docs: DataFrame, key: str, text: str, least: int, hot: int = HOT_ROWS) -> DataFrame:
    """The chunks (digest, before, n, doc, pos) where a common passage of several documents begins, with up to `least`
    code points to the left and right of pos. Written to shared storage. hot: chunks of one digest from which on it is
    not gathered in one task."""
    chunks = chunk_table(docs, key, text, least)
    stats = {"lo": F.min("before"), "hi": F.max("before"), "n": F.count("*"), "_a": F.min("doc"), "_z": F.max("doc"), "_p": F.max("pos")}
    found = join_groups(chunks, ["digest"], hot_values(chunks, "digest", hot), F.expr("lo <> hi and _a <> _z and _p is not null"), **stats)
    points = materialize(found.select("digest", "before", "n", "doc", "pos"), "branch-points")
    p = F.col("pos")
    left = F.substring(F.col("text"), F.greatest(p - least, F.lit(0)) + 1, F.least(p, F.lit(least)))
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return materialize(points.join(source, "doc").select("digest", "before", "n", "doc", "pos", left.alias("left"), F.substring(F.col("text"), p + 1, F.lit(least)).alias("right")), "branch-contexts")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        la, ra, lb, rb = (b.column(k).to_pylist() for k in range(4, 8))
        left = [_common(x[::-1], y[::-1]) for x, y in zip(la, lb, strict=True)]
        right = [_common(x, y) for x, y in zip(ra, rb, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["doc_a", "pos_a", "doc_b", "pos_b", "left", "right"])


def _side(points: DataFrame, s: str) -> DataFrame:
    return points.select("digest", *(F.col(c).alias(f"{c}_{s}") for c in ("before", "doc", "pos", "left", "right")))


def _aligned(points: DataFrame) -> DataFrame:
    """Pairs of branch points with one digest and different chunks before, with what their texts have in common."""
    pairs = _side(points, "a").join(_side(points, "b"), "digest").where("doc_a < doc_b and before_a <> before_b")
    return pairs.select("doc_a", "pos_a", "doc_b", "pos_b", "left_a", "right_a", "left_b", "right_b").mapInArrow(_measure, "doc_a long, pos_a int, doc_b long, pos_b int, left int, right int")


def _grams(points: DataFrame, least: int, lead: int) -> DataFrame:
    """For digests of many chunks: every span of exactly `least` code points that starts up to `lead` before pos, by a
    128-bit hash, with the sign before it (a text's start counts as unlike all others) and its distance from pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, places, left, right = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, j in cp.slices(np.fromiter((len(x) + len(y) for x, y in zip(left, right, strict=True)), np.int64, len(docs)), SLICE // 8):
                joined = [x[-lead - 1 :] + y for x, y in zip(left[i:j], right[i:j], strict=True)]
                points_, starts = cp.decode(joined)
                pos = np.fromiter((min(len(x), lead + 1) for x in left[i:j]), np.int64, j - i)
                size = np.diff(starts)
                first = np.maximum(pos - lead, 0)
                count = np.maximum(np.minimum(pos, size - least) - first + 1, 0)
                at = cp.spread(starts[:-1] + first, count)
                row = np.repeat(np.arange(j - i), count)
                sums = cp.prefix_hash(points_)
                again = cp.prefix_hash(points_ * np.uint32(2654435761))
                own = docs[i:j][row]
                sign = points_[np.maximum(at - 1, 0)].astype(np.int64)
                sign = np.where(at == starts[:-1][row], -1 - own, sign)
                back = (pos[row] - (at - starts[:-1][row])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(cp.span_hash(x, at, at + least).view(np.int64)) for x in (sums, again)), pa.array(sign), pa.array(own), pa.array(places[i:j][row]), pa.array(back)],
                    names=["h1", "h2", "sign", "doc", "pos", "back"],
                )

    return points.select("doc", "pos", "left", "right").mapInArrow(run, "h1 long, h2 long, sign long, doc long, pos int, back int")


def _hot_pairs(points: DataFrame, least: int, lead: int, hot: int) -> DataFrame:
    """Pairs from digests of many chunks: only documents with an equal span meet, at the leftmost such span.

    The hash decides which spans may be equal; the spans themselves are then part of the join. One side of a span that
    many documents hold is dealt to several tasks, PART rows to each.
    """
    places = ["doc", "pos"]
    each = _grams(points.dropDuplicates(places), least, lead).groupBy("h1", "h2", "sign", "doc").agg(F.min(F.struct(*places[1:], "back")).alias("_at"))
    grams = materialize(each.select("h1", "h2", "sign", "doc", "_at.pos", "_at.back"), "hot-spans")
    split = materialize(grams.groupBy("h1", "h2").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h1", "h2", "n"), "hot-splits")
    kept = spread_join(grams, split, ["h1", "h2"], places, hot_of(split, ["h1", "h2"], "n", hot))
    near = points.dropDuplicates(places).select(*places, "left", "right")
    span = F.concat(F.right("left", F.col("back")), F.substring("right", F.lit(1), F.lit(least) - F.col("back")))
    kept = materialize(kept.join(near, places).select("h1", "h2", "sign", "doc", F.ceil(F.col("n") / PART).alias("parts"), span.alias("span")), "hot-equal")
    a = kept.withColumn("part", F.pmod(F.xxhash64("doc"), "parts"))
    b = kept.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    on = ["h1", "h2", "part", "span"]
    sides = [x.select(*on, F.col("sign").alias(f"sign_{s}"), F.col("doc").alias(f"doc_{s}")) for x, s in ((a, "a"), (b, "b"))]
    return sides[0].join(sides[1], on).where("doc_a < doc_b and sign_a <> sign_b").select("doc_a", "doc_b")


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 300, many: int = HOT, hot: int = HOT_ROWS) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of documents with at least `least` code points in common, verbatim.

    Null, empty and shorter texts share nothing. Keys are whole numbers and unique; a repeated key is taken as one
    document. Digests of more than `many` chunks are not paired directly: there, equal spans of `least` code points are
    sought by hash and compared themselves, so that only documents which do share a span ever meet. Digests and spans
    of more than `hot` rows are dealt to several tasks. Other columns are ignored. Rows grow with the square of the
    documents that share one passage; shared_links() and shared_passages() do not.
    """
    _, _, lead = geometry(least)
    points = branch_points(docs, key, text, least, hot)
    found = _aligned(points.where(F.col("n") <= many)).where(F.col("left") + F.col("right") >= least).select("doc_a", "doc_b")
    dense = points.where(F.col("n") > many)
    if not dense.isEmpty():
        found = found.unionByName(_hot_pairs(dense, least, lead, hot))
    return found.distinct().select(F.col("doc_a").alias(f"{key}_a"), F.col("doc_b").alias(f"{key}_b"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, copies) of every document: the smallest key with the same text, and how many have it. A null text
    is a class of its own for each document."""
    digest = F.coalesce(F.sha2(text, 256), F.concat(F.lit("null "), F.col(key).cast("string")))
    marked = docs.select(key, digest.alias("_digest"))
    heads = materialize(marked.groupBy("_digest").agg(F.min(key).alias("class_id"), F.count("*").alias("copies")), "text-classes")
    return spread_join(marked, heads, ["_digest"], [key], hot_of(heads, ["_digest"], "copies")).select(key, "class_id", "copies")


def shared_links(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 300) -> DataFrame:
    """(key, class_id, copies, links): one row for each document. Documents with equal texts are one class; links is the
    number of other classes that share a span of `least` code points with it. Pairs are formed between the classes'
    first documents only."""
    member = materialize(classes(docs, key, text), "members")
    first = docs.select(key, text).join(member.where(F.col(key) == F.col("class_id")).select(key), key, "left_semi")
    pairs = materialize(shared_pairs(first, key, text, least), "class-pairs")
    ends = pairs.select(F.explode(F.array(f"{key}_a", f"{key}_b")).alias("class_id"))
    links = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    heads = member.where(F.col(key) == F.col("class_id")).select("class_id", "copies")
    counted = heads.join(links, "class_id", "left").select("class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return spread_join(member, counted, ["class_id"], [key], hot_of(heads, ["class_id"], "copies")).select(key, "class_id", "copies", "links")


def _span_hashes(docs: DataFrame, least: int, reach: int) -> DataFrame:
    """(h1, h2, doc, start): every span of `least` code points of a document that holds one of its shared chunks, given
    (doc, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                points, _ = cp.decode([text])
                pos = np.unique(np.array(places, np.int64))
                low, high = np.maximum(pos + reach - least, 0), np.minimum(pos, len(points) - least)
                starts = np.unique(cp.spread(low, np.maximum(high - low + 1, 0)))
                if not len(starts):
                    continue
                pair = [cp.span_hash(cp.prefix_hash(x), starts, starts + least).view(np.int64) for x in (points, points * np.uint32(2654435761))]
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.full(len(starts), doc, np.int64)), pa.array(starts.astype(np.int32))], names=["h1", "h2", "doc", "start"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, start int")


def _runs(hits: DataFrame) -> DataFrame:
    """(doc, first, last, other, shift): stretches of successive starts whose spans are those of one other document, `shift`
    code points further on there."""
    order = Window.partitionBy("doc").orderBy("start")
    shift = F.col("at") - F.col("start")
    goes_on = (F.col("start") - F.lag("start").over(order) == 1) & (F.col("other") == F.lag("other").over(order)) & (shift == F.lag(shift).over(order))
    marked = hits.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("shift", shift)
    numbered = marked.withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy("doc", "_run").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.first("other").alias("other"), F.first("shift").alias("shift")).drop("_run")


def _verified(runs: DataFrame, source: DataFrame, least: int, hot: int) -> DataFrame:
    """Runs with `same`: whether the text of each is that of the other document at its place."""

    def piece(at: str, shift: Column | None = None) -> Column:
        start = F.col("first") if shift is None else F.col("first") + shift
        return F.substring(F.col(at), start + 1, F.col("last") - F.col("first") + least)

    counts = runs.groupBy("other").agg(F.count("*").alias("n"))
    theirs = spread_join(runs, source.select(F.col("doc").alias("other"), F.col("text").alias("_b")), ["other"], ["doc", "first"], hot_of(counts, ["other"], "n", hot))
    cut = theirs.select(*runs.columns, piece("_b", F.col("shift")).alias("_b"))
    return cut.join(source, "doc").select(*runs.columns, (piece("text") == F.col("_b")).alias("same"))


def shared_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 300, hot: int = HOT_ROWS) -> DataFrame:
    """(key, start, end): the longest stretches of each document in which every span of `least` code points also stands
    in another document. No pairs are formed, so a passage that a third of the documents share costs what it measures.

    Chunks that several documents have mark where to look; there, spans are matched by a 128-bit hash with the first
    document that holds them, and successive spans are then compared with it verbatim, run by run. Should spans with one
    hash ever differ, all spans with such a hash are grouped by their text. Null, empty and shorter texts have no
    passage; keys are unique whole numbers. Digests and spans of more than `hot` rows stay where they are.
    """
    _, reach, _ = geometry(least)
    chunks = chunk_table(docs, key, text, least).select("digest", "doc", "pos")
    common = join_groups(chunks, ["digest"], hot_values(chunks, "digest", hot), F.expr("lo <> hi and _p is not null"), lo=F.min("doc"), hi=F.max("doc"), _p=F.max("pos"))
    places = materialize(common.groupBy("doc").agg(F.collect_set("pos").alias("places")), "shared-places")
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    spans = _span_hashes(places.join(source, "doc").select("doc", "text", "places"), least, reach)
    matched = join_groups(spans, ["h1", "h2"], hot_values(spans, "h1", hot), F.expr("lo <> hi"), lo=F.min("doc"), hi=F.max("doc"), head=F.min(F.struct("doc", "start")))
    hits = matched.select("doc", "start", F.col("head.doc").alias("other"), F.col("head.start").alias("at"), "h1", "h2")
    runs = materialize(_runs(hits), "shared-runs")
    checked = materialize(_verified(runs.where("doc <> other"), source, least, hot), "shared-checked")
    sure = runs.where("doc = other").drop("shift", "other").unionByName(checked.where("same").drop("shift", "other", "same"))
    wrong = checked.where("not same")
    if not wrong.isEmpty():  # spans of one hash that differ: by their text instead
        starts = wrong.select("doc", F.explode(F.sequence("first", "last")).alias("start"))
        keys = hits.join(starts, ["doc", "start"], "left_semi").select("h1", "h2").distinct()
        odd = hits.join(keys, ["h1", "h2"], "left_semi").select("doc", "start").join(source, "doc").select("doc", "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(least)).alias("span"))
        equal = odd.join(odd.groupBy("span").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("span"), "span").select("doc", "start")
        plain = sure.select("doc", F.explode(F.sequence("first", "last")).alias("start")).join(odd.select("doc", "start"), ["doc", "start"], "left_anti")
        sure = plain.unionByName(equal).select("doc", F.col("start").alias("first"), F.col("start").alias("last"))
    order = Window.partitionBy("doc").orderBy("first")
    edge = F.coalesce(F.col("first") > F.lag("last").over(order) + 1, F.lit(True))
    joined = sure.withColumn("_run", F.sum(edge.cast("int")).over(order)).groupBy("doc", "_run").agg(F.min("first").alias("start"), (F.max("last") + least).alias("end"))
    return joined.select(F.col("doc").alias(key), "start", "end")


def shared_part(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 300) -> DataFrame:
    """Per document: n_chars, and shared_chars of them in passages that also stand in other documents; 0 where none."""
    spans = shared_passages(docs, key, text, least).select(F.col(key).alias("_doc"), "start", "end").groupBy("_doc").agg(F.collect_list(F.struct("start", "end")).alias("_s"))
    covered = F.aggregate(
        F.array_sort("_s"),
        F.struct(F.lit(0).alias("until"), F.lit(0).alias("total")),
        lambda acc, s: F.struct(F.greatest(acc["until"], s["end"]).alias("until"), (acc["total"] + F.greatest(s["end"] - F.greatest(s["start"], acc["until"]), F.lit(0))).alias("total")),
    )["total"]
    sizes = docs.select(F.col(key), F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"))
    return sizes.join(spans, sizes[key] == spans["_doc"], "left").select(key, "n_chars", F.coalesce(covered, F.lit(0)).alias("shared_chars"))
