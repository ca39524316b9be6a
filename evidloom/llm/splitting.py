"""Splitting oversized texts into overlapping pieces at natural boundaries, by content-defined chunking.

A piece ends near the landmark, the code point whose gear hash is smallest in the part of the text where the piece may
end; the cut then snaps to the nearest boundary of the best kind around it. Both depend on the text nearby only, so
after an edit the cuts beyond the next few landmarks are what they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm import codepoints as cp
from evidloom.llm import gear

# Kinds of boundary from best to worst; a cut goes where the match ends.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…]+[\"'”»)\]]*\s+|[。！？]")),
    ("word", re.compile(r"\s+|(?<=[、，；])")),
)


def _boundaries(text: str) -> list[np.ndarray]:
    return [np.fromiter((m.end() for m in pattern.finditer(text)), np.int64) for _, pattern in BOUNDARIES]


def _nearest(places: np.ndarray, at: int, low: int, high: int) -> int | None:
    """The place nearest to `at` within low..high."""
    k = int(np.searchsorted(places, at))
    near = [int(p) for p in places[max(0, k - 1) : k + 1] if low <= p <= high]
    return min(near, key=lambda p: abs(p - at)) if near else None


def _whole_signs(text: str, at: int, low: int, high: int) -> int:
    """The border of what is seen as one sign, a letter with its marks or a joined emoji, that is nearest to `at` within
    low..high; `at` itself if there is none."""
    base = max(0, low - 64)
    borders = [base + m.end() for m in regex.finditer(r"\X", text[base : min(len(text), high + 64)])]
    near = [b for b in borders if low <= b <= high]
    return min(near, key=lambda b: abs(b - at)) if near else at


def pieces(text: str, limit: int = 2400, overlap: int = 200, least: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of each piece; the last piece ends with `end`.

    Every piece has at most `limit` code points and all but the last at least `least` (by default half the limit). A
    piece starts `overlap` before the end of the one before, or at the word boundary up to a fifth of the overlap
    earlier. Where no boundary of any kind lies in reach, the cut is at the landmark, moved so that it does not divide a
    letter from its marks or a joined emoji; so is a start without a word boundary.
    """
    least = limit // 2 if least is None else least
    if not 0 <= overlap < least <= limit:
        raise ValueError("overlap must be less than the least size, and that no more than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    points, _ = cp.decode([text])
    hashes = gear.gear_hashes(points)
    places = _boundaries(text)
    out, start = [], 0
    while n - start > limit:
        low, high = start + least, start + limit
        landmark = low + int(np.argmin(hashes[low:high]))
        cut, kind = landmark, "none"
        for (name, _), found in zip(BOUNDARIES, places, strict=True):
            if (p := _nearest(found, landmark, low, high)) is not None:
                cut, kind = p, name
                break
        if kind == "none":
            cut = _whole_signs(text, landmark, low, high)
        out.append((start, cut, kind))
        back = places[3][np.searchsorted(places[3], cut - overlap, side="right") - 1] if len(places[3]) and places[3][0] <= cut - overlap else -1
        start = int(back) if cut - overlap - back <= overlap // 5 and cut - back < least else _whole_signs(text, cut - overlap, cut - overlap - overlap // 5, cut - overlap)
    return [*out, (start, n, "end")]


SLICE = 4_000_000  # characters of pieces that come out in one batch
PIECES = "piece_index int, start int, end int, cut string, piece string, chunk_id string, snippet_hash string"


def split_texts(docs: DataFrame, key: str = "doc_id", path: str = "source_path", text: str = "text", limit: int = 2400, overlap: int = 200) -> DataFrame:
    """The pieces of every text of more than `limit` code points: (key, path, piece_index, start, end, cut, piece,
    chunk_id, snippet_hash). Offsets count code points; cut is the kind of boundary at the end.

    snippet_hash is the SHA-256 of the piece; chunk_id is made of it and the piece's number among equal pieces of its
    document, so it survives edits elsewhere. Null, empty and shorter texts give no rows; a text of any length is split
    whole, in one task; repeated rows are split again; a null path stays null.
    """
    rows = docs.where(F.char_length(text) > limit).select(key, path, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows, size = [], [], 0

            def batch(b=b) -> pa.RecordBatch:
                columns = list(zip(*out, strict=True))
                take = pa.array(rows, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), *(pa.array(c, pa.int32()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                    names=[key, path, "piece_index", "start", "end", "cut", "piece", "chunk_id", "snippet_hash"],
                )

            for k, t in enumerate(b.column(2).to_pylist()):
                owner, seen = b.column(0)[k].as_py(), {}
                for i, (a, z, kind) in enumerate(pieces(t, limit, overlap)):
                    digest = hashlib.sha256(t[a:z].encode("utf-8", "surrogatepass")).hexdigest()
                    seen[digest] = seen.get(digest, -1) + 1
                    name = hashlib.sha256(f"{owner}\n{digest}\n{seen[digest]}".encode()).hexdigest()[:16]
                    out.append((i, a, z, kind, t[a:z], f"CHK-{name}", digest))
                    rows.append(k)
                    size += z - a
                if size > SLICE:
                    yield batch()
                    out.clear(), rows.clear()
                    size = 0
            if out:
                yield batch()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{path}` {kinds[path]}, {PIECES}")
