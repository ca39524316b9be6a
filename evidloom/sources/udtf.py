"""Plug-in point for evaluators of text windows: a table function with state, in the shape Spark gives one."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


@F.udtf(returnType="pos int, term string")
class TermFinder:
    """Places of whole words in a text; remembers what it gave out, so that a term's hit at one place comes once even if
    windows of one key overlap; windows of one key come one after the other. A model of an evaluator: eval() sees each window, terminate() adds one row for each term, at place -1,
    as a summary of what was found."""

    def __init__(self) -> None:
        self.key: object = None
        self.terms: set[str] = set()
        self.given: set[tuple[int, str]] = set()

    def eval(self, key: str, text: str, offset: int, terms: str):
        if key != self.key:
            self.key, self.given = key, set()
        pattern = re.compile(r"\b(" + "|".join(re.escape(t) for t in sorted(terms.split("|"), key=len, reverse=True)) + r")\b", re.I)
        for m in pattern.finditer(text or ""):
            hit = (offset + m.start(), m[0].lower())
            if hit not in self.given:
                self.given.add(hit)
                self.terms.add(hit[1])
                yield hit

    def terminate(self):
        for term in sorted(self.terms):
            yield -1, term
