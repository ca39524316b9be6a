"""Tests and counts of terms in text, and the places of keywords."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_hits(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """How many of the terms occur as substrings: a flat sum, which stays in generated code."""
    return reduce(lambda a, b: a + b, (text.contains(t).cast("int") for t in terms), F.lit(0))


def any_hit(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms), F.lit(False))


def hits(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms that occur, in the order given."""
    return F.array_compact(F.array(*(F.when(text.contains(t), F.lit(t)) for t in terms))) if terms else F.array().cast("array<string>")


def families(text: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """The names of the lists of which any term occurs, in their order."""
    return F.array_compact(F.array(*(F.when(any_hit(text, terms), F.lit(name)) for name, terms in lists.items())))


def escape(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", term)


def alternation(terms: list[str] | tuple[str, ...], bounded: bool = True) -> str:
    """One case-insensitive pattern for all terms, longer ones first; `bounded` to whole words."""
    if not terms:
        raise ValueError("at least one keyword is needed")
    ordered = sorted({t for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    inner = "|".join(escape(t) for t in ordered)
    return rf"(?iU)\b({inner})\b" if bounded else f"(?iU)({inner})"


_BLOCK = 64  # entries of an array that are walked through in one go


def _scan(steps: Column, n: Column, start: Column, kind: str, state: Callable[[Column, Column], Column], item: Callable[[Column, Column], Column]) -> Column:
    """An array of `kind` with one item for each of n steps, made of the step and the state before it; `state` makes the next
    state. As an array that grows is copied at each step, it is made in blocks of _BLOCK items, so that the work hardly
    grows faster than the number of steps."""

    def inner(before: Column, block: Column) -> Column:
        empty = F.struct(before.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, empty, lambda acc, x: F.struct(state(acc["state"], x).alias("state"), F.array_append(acc["out"], item(acc["state"], x)).alias("out")))

    def outer(acc: Column, block: Column) -> Column:
        after = F.aggregate(block, acc["state"], state)
        return F.struct(after.alias("state"), F.array_append(acc["out"], inner(acc["state"], block)["out"]).alias("out"))

    def walk(bound: Column) -> Column:
        k = F.size(bound)
        blocks = F.transform(F.when(k > 0, F.sequence(F.lit(1), k, F.lit(_BLOCK))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(bound, i, F.lit(_BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer)["out"])

    # the steps are an argument of a function here, so that they are made once and not once for each block
    return F.transform(F.array(F.when(n > 0, steps)), lambda bound: F.when(bound.isNull(), F.array().cast(f"array<{kind}>")).otherwise(walk(bound)))[0]


def _pieces(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """(matches, gaps around them, number of matches)."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return found, F.split(text, pattern, -1), F.greatest(F.size(found), F.lit(0))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<pos int, match string>>: every match of a pattern with one group around the whole, from left to
    right, at its 0-based place in code points. Built from the matches and the gaps between them, without Python."""
    found, gaps, n = _pieces(text, pattern)
    steps = F.zip_with(F.slice(gaps, 1, n), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("match"), F.char_length(m).alias("length")))
    return _scan(steps, n, F.lit(0), "struct<pos:int,match:string>", lambda at, x: at + x["gap"] + x["length"], lambda at, x: F.struct((at + x["gap"]).alias("pos"), x["match"].alias("match")))


def contexts(text: Column, pattern: str, radius: int) -> Column:
    """array<struct<pos int, match string, before string, after string>>: occurrences() with up to `radius` code points to the
    left of each match, and as many from its start to the right. Both are handed on from match to match, so that no
    match has to look for its place in the text from the start."""
    found, gaps, n = _pieces(text, pattern)
    r = F.lit(radius)
    left = F.zip_with(F.slice(gaps, 1, n), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.right(g, r).alias("end"), m.alias("match"), F.char_length(m).alias("length")))

    def before(state: Column, x: Column) -> Column:
        return F.right(F.concat(state["tail"], x["end"]), r)

    places = _scan(
        left, n, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), "struct<pos:int,match:string,before:string>",
        lambda s, x: F.struct((s["at"] + x["gap"] + x["length"]).alias("at"), F.right(F.concat(before(s, x), x["match"]), r).alias("tail")),
        lambda s, x: F.struct((s["at"] + x["gap"]).alias("pos"), x["match"].alias("match"), before(s, x).alias("before")),
    )
    right = F.reverse(F.zip_with(found, F.slice(gaps, 2, n), lambda m, g: F.concat(m, F.left(g, r))))
    whole = F.reverse(F.zip_with(found, F.slice(gaps, 2, n), lambda m, g: F.char_length(m) + F.char_length(g)))
    steps = F.zip_with(right, whole, lambda t, k: F.struct(t.alias("text"), k.alias("length")))

    def after(head: Column, x: Column) -> Column:
        return F.when(x["length"] >= radius, F.left(x["text"], r)).otherwise(F.left(F.concat(x["text"], head), r))

    following = F.reverse(_scan(steps, n, F.lit(""), "string", after, after))
    return F.zip_with(places, following, lambda p, a: F.struct(p["pos"].alias("pos"), p["match"].alias("match"), p["before"].alias("before"), a.alias("after")))
