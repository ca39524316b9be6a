"""Evidence from documents: keyword hits with places, citations, windows and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import terms as TM
from evidloom.functions import text as TX


def keyword_hits(df: DataFrame, key: str, text: str, keywords: list[str] | tuple[str, ...]) -> DataFrame:
    """(key, pos, keyword) of every whole-word match of any keyword, letter case aside; matches do not overlap and the
    longest keyword wins. Positions are 0-based code points. Null and empty texts have none."""
    pattern = TM.alternation(keywords)
    found = df.where(F.col(text).rlike(pattern)).select(key, F.explode(TM.occurrences(F.col(text), pattern)).alias("_h"))
    return found.select(key, F.col("_h.pos").alias("pos"), F.col("_h.match").alias("keyword"))


def requirement_of(keyword: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """The category of a matched keyword, or an id made of the keyword itself."""
    pairs = [x for category, words in categories.items() for word in words for x in (F.lit(word.strip().lower()), F.lit(category))]
    mapped = F.try_element_at(F.map_from_arrays(F.array(*pairs[0::2]), F.array(*pairs[1::2])), F.lower(F.trim(keyword))) if pairs else F.lit(None)
    return F.coalesce(mapped, TX.slug_id(keyword))


def _first_category(categories: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """A keyword that stands in several categories belongs to the last of them, as in a map built in order."""
    owner = {w.strip().lower(): c for c, words in categories.items() for w in words}
    return {c: tuple(w for w in words if owner[w.strip().lower()] == c) for c, words in categories.items()}


def evidence_rows(df: DataFrame, key: str, text: str, categories: dict[str, tuple[str, ...]], radius: int = 300) -> DataFrame:
    """(key, pos, keyword, category, passage, evidence_no): each keyword hit with its surroundings, numbered in text order.

    The passage is what stands within `radius` characters of the hit. One row in, any number out; a third of all hits
    in one document is still one document's window.
    """
    single = _first_category(categories)
    words = [w for ws in single.values() for w in ws]
    pattern = TM.alternation(words)
    rows = df.where(F.col(text).rlike(pattern)).select(key, F.explode(TM.contexts(F.col(text), pattern, radius)).alias("_h"))
    hit = rows.select(key, F.col("_h.pos").alias("pos"), F.col("_h.match").alias("keyword"), TX.single_line(F.concat("_h.before", "_h.after")).alias("passage"))
    numbered = hit.where(F.col("passage") != "").withColumn("evidence_no", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    return numbered.withColumn("category", requirement_of(F.col("keyword"), single))


def dedupe_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """The first row of each document, category and passage (letter case aside), combined before the shuffle."""
    first = evidence.groupBy(key, "category", F.sha2(TX.casefold(F.col("passage")), 256).alias("_same")).agg(F.min_by(F.struct(*evidence.columns), "pos").alias("_first"))
    return first.select("_first.*")


def windows(df: DataFrame, key: str, text: str, size: int = 65_536, radius: int = 300, overlap: int | None = None) -> DataFrame:
    """(key, window_index, start, end, core_end, is_tail): overlapping windows over a text.

    Windows of `size` step by size - overlap; the rest of up to size + step characters is one tail window. A hit belongs
    to the window whose [start, core_end) holds it, so no hit counts twice. The overlap is at least 512 and enough for
    a passage of `radius` on both sides.
    """
    lap = overlap if overlap is not None else max(512, 2 * radius + 64)
    step = size - lap
    if step <= 0:
        raise ValueError("the window must be larger than the overlap")
    n = F.char_length(text)
    full = F.greatest(F.ceil((n - F.lit(size + step)) / F.lit(float(step))), F.lit(0)).cast("int")
    index = F.sequence(F.lit(0), full)
    rows = df.where(n > 0).select(key, n.alias("_n"), full.alias("_full"), F.explode(index).alias("window_index"))
    start = F.col("window_index") * step
    tail = F.col("window_index") == F.col("_full")
    end = F.when(tail, F.col("_n")).otherwise(start + size)
    return rows.select(key, "window_index", start.alias("start"), end.alias("end"), F.when(tail, F.col("_n")).otherwise(end - lap).alias("core_end"), tail.alias("is_tail"))


def owned(hits: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Hits with the window that owns them."""
    return hits.join(spans, key).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("core_end")))


def chunks(df: DataFrame, key: str, text: str, size: int = 900, overlap: int = 120, with_text: bool = True) -> DataFrame:
    """(key, chunk_index, start_char, end_char, snippet_hash[, chunk_text]) over the text with white space collapsed.

    Offsets are those of the untrimmed chunk; the hash is of the trimmed one. Empty texts have no chunk.
    """
    if size <= overlap:
        raise ValueError("size must be greater than overlap")
    step = size - overlap
    flat = df.select(key, TX.collapse(F.col(text)).alias("_t")).where(F.char_length("_t") > 0)
    n = F.char_length("_t")
    last = (F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(float(step))) * step).cast("int")
    rows = flat.select(key, "_t", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("_i", "start_char"))
    piece = F.trim(F.substring(F.col("_t"), F.col("start_char") + 1, F.lit(size)))
    out = rows.select(key, (F.col("_i") + 1).alias("chunk_index"), "start_char", F.least(F.col("start_char") + size, F.char_length("_t")).alias("end_char"), piece.alias("chunk_text"))
    out = out.where(F.col("chunk_text") != "").withColumn("snippet_hash", F.sha2("chunk_text", 256))
    return out if with_text else out.drop("chunk_text")


def locator_problem(text: Column, start: Column, end: Column, quote: Column, quote_hash: Column, source_type: Column, page: Column, actual_page: Column, table_position: Column) -> Column:
    """What is wrong with a quote's locator, the first that applies, or null: span, quote, page (only of a PDF, where it must
    be right and not be left out if known), table (only of CSV and XLSX), hash."""
    pdf = F.coalesce(source_type == "pdf", F.lit(False))
    span = F.coalesce((F.char_length(quote) > 0) & (start >= 0) & (end > start) & (end <= F.char_length(text)), F.lit(False))
    wrong_page = F.when(page.isNotNull(), ~(pdf & page.eqNullSafe(actual_page))).otherwise(actual_page.isNotNull() & pdf)
    return (
        F.when(~span, "span").when(F.substring(text, start + 1, end - start) != quote, "quote").when(wrong_page, "page")
        .when(table_position.isNotNull() & ~F.coalesce(source_type.isin("csv", "xlsx"), F.lit(False)), "table").when(~(F.sha2(quote, 256)).eqNullSafe(quote_hash), "hash")
    )


def locator_ok(text: Column, start: Column, end: Column, quote: Column, quote_hash: Column) -> Column:
    """Whether a quote stands at its place and has its hash."""
    return (F.substring(text, start + 1, end - start) == quote) & (F.sha2(quote, 256) == quote_hash)
