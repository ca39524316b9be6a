"""Loading raw comma-separated records: valid rows as typed columns, the others with a reason and its place.

The tokenizer is a finite-state machine over bytes. A batch of records is one byte stream; it is cut into chunks of
equal length regardless of record borders, each chunk is reduced to a transition map (start state -> end state), the
maps are composed from left to right to give every chunk its start state, and a second pass with known starts labels
each byte. All steps work on whole columns of bytes at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.operators.skew import hot_keys, spread_join

# The columns of a review file, in order.
REVIEW_FIELDS = (
    "finding_id", "category", "control_area", "document", "evidence_level", "status", "finding",
    "recommended_manual_check", "source_reference", "review_status", "review_note", "reviewer", "reviewed_at",
)

MOST_STATUSES = 10_000  # values that are broadcast

START, BARE, QUOTED, CLOSED, BROKEN = range(5)  # states: at a field's start, in a bare field, in quotes, after a quote in quotes, after an error
QUOTE, COMMA, END, OTHER = range(4)  # classes of bytes; END separates records and is no byte of theirs
_T = np.empty((4, 5), np.uint8)
_T[QUOTE] = [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN]
_T[COMMA] = [START, START, QUOTED, START, BROKEN]
_T[OTHER] = [BARE, BARE, QUOTED, BROKEN, BROKEN]
_T[END] = [START] * 5


def state_before(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """The state in which the machine meets each symbol, starting in START."""
    n = len(classes)
    if n == 0:
        return np.empty(0, np.uint8)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.broadcast_to(np.arange(5, dtype=np.uint8), (rows, 5)).copy()
    for symbols in grid:
        maps = _T[symbols[:, None], maps]
    starts = np.empty(rows, np.uint8)
    state = START
    for k, m in enumerate(maps.tolist()):
        starts[k] = state
        state = m[state]
    out = np.empty((chunk, rows), np.uint8)
    for k, symbols in enumerate(grid):
        out[k] = starts
        starts = _T[symbols, starts]
    return out.T.reshape(-1)[:n]


def tokenize(records: Sequence[bytes], fields: int) -> tuple[list[list[str] | None], list[str | None], list[int | None]]:
    """Fields, reason and byte offset of each record; reason is None, `quoting` or `column_count`."""
    lengths = np.fromiter(map(len, records), np.int64, len(records))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    stream = np.frombuffer(b"\0".join(records) + b"\0", np.uint8) if len(records) else np.empty(0, np.uint8)
    classes = np.full(len(stream), OTHER, np.uint8)
    classes[stream == ord('"')] = QUOTE
    classes[stream == ord(",")] = COMMA
    classes[ends] = END
    before = state_before(classes)
    wrong = ((classes == QUOTE) & (before == BARE)) | ((classes == OTHER) & (before == CLOSED)) | ((classes == END) & (before == QUOTED))
    at = np.flatnonzero(wrong)
    owner = np.searchsorted(ends, at)
    first_error = np.full(len(records), -1, np.int64)
    first_error[owner[::-1]] = at[::-1]
    cut = (classes == COMMA) & ((before == START) | (before == BARE) | (before == CLOSED))
    cuts = np.flatnonzero(cut)
    lo, hi = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
    out_fields: list[list[str] | None] = []
    reasons: list[str | None] = []
    offsets: list[int | None] = []
    cuts_list = cuts.tolist()
    for raw, a, e, i, j in zip(records, starts.tolist(), first_error.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if e >= 0:
            out_fields.append(None), reasons.append("quoting"), offsets.append(e - a)
            continue
        if j - i + 1 != fields:
            over = cuts_list[i + fields - 1] - a if j - i + 1 > fields else len(raw)
            out_fields.append(None), reasons.append("column_count"), offsets.append(over)
            continue
        edges = [-1, *(c - a for c in cuts_list[i:j]), len(raw)]
        row = []
        for x, y in zip(edges, edges[1:], strict=False):
            piece = raw[x + 1 : y]
            row.append((piece[1:-1].replace(b'""', b'"') if piece[:1] == b'"' else piece).decode("utf-8", "replace"))
        out_fields.append(row), reasons.append(None), offsets.append(None)
    return out_fields, reasons, offsets


def _valid_timestamp(v: Column) -> Column:
    """Empty, an existing date, or that with Thh:mm:ss and Z or an offset of less than a day."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9]))?\z"
    return (v == "") | (v.rlike(shape) & F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd").isNotNull())


def parse_records(lines: DataFrame, raw: str, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` columns, one string column per field, `reason` and `error_offset` (bytes) for every row of `lines`.

    reason is null for a loadable row, else `quoting` or `column_count`; then the fields are null. A null record has no
    field at all and gets `column_count`; an empty one has a single empty field. Bytes that are not UTF-8, which a string
    column should not hold, become the replacement character. Other columns of `lines` are ignored,
    so clashing names do no harm.
    """
    kept = lines.select(*keep, F.col(raw).cast("binary").alias("_raw"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), *(f"`{f}` string" for f in fields), "reason string", "error_offset int"])
    names, width = [*keep, *fields, "reason", "error_offset"], len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = b.column(b.num_columns - 1).to_pylist()
            rows, reasons, offsets = tokenize([r or b"" for r in records], width)
            for k, r in enumerate(records):
                if r is None:
                    rows[k], reasons[k], offsets[k] = None, "column_count", 0
            columns = [pa.array([r[i] if r else None for r in rows], pa.string()) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns, pa.array(reasons, pa.string()), pa.array(offsets, pa.int32())], names=names)

    return kept.mapInArrow(run, schema)


def load_review_lines(lines: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows of review files (line_no, batch_name, raw_line) as columns, with the first reason why a row is invalid.

    statuses: one column with the allowed values of review_status; up to MOST_STATUSES of them are broadcast, a longer list
    is joined with frequent values dealt to several tasks. Reasons, in this order: `quoting`,
    `column_count`, `finding_id`, `review_status`, `reviewed_at`. Repeated lines stay repeated.
    """
    parsed = parse_records(lines, "raw_line", REVIEW_FIELDS, ["line_no", "batch_name"])
    allowed = statuses.select(F.col(statuses.columns[0]).alias("_allowed")).where("_allowed is not null").distinct()
    if allowed.limit(MOST_STATUSES + 1).count() <= MOST_STATUSES:
        joined = parsed.join(F.broadcast(allowed), F.col("review_status") == F.col("_allowed"), "left")
    else:
        named = allowed.select(F.col("_allowed").alias("review_status"), "_allowed")
        joined = spread_join(parsed, named, ["review_status"], ["line_no"], hot_keys(parsed, ["review_status"]), "left").select(*parsed.columns, "_allowed")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~F.col("finding_id").rlike(r"^F-[0-9a-f]{12}\z"), "finding_id")
        .when((F.col("review_status") != "") & F.col("_allowed").isNull(), "review_status")
        .when(~_valid_timestamp(F.col("reviewed_at")), "reviewed_at")
    )
    return joined.withColumn("reason", reason).drop("_allowed")
