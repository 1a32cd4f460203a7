"""Highlighted snippets of result rows (after the limit, so few rows reach Python)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import CJK_CLASS, TOKEN_PATTERN

# Window, its part before the hit, how far an edge looks for a separator, marks.
WINDOW, BEFORE, LOOK = 80, 40, 20
OPEN, CLOSE = "【", "】"

_RUNS = re.compile(TOKEN_PATTERN)
_TOKEN_CHAR = re.compile(f"[a-z0-9{CJK_CLASS}]")


def _fold(text: str) -> str:
    """Lower case, one character for one."""
    return "".join(c.lower() if len(c.lower()) == 1 else ("i" if c == "İ" else c) for c in text)


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, sorted."""
    found = set()
    for m in _RUNS.finditer(_fold(query)):
        run = m[0]
        found.update([run] if run[0].isascii() or len(run) == 1 else (run[i : i + 2] for i in range(len(run) - 1)))
    return sorted(found)


def _hits(folded: str, terms: list[str]) -> list[tuple[int, int]]:
    """Places of the terms, overlapping or touching ones joined."""
    known, places = set(terms), []
    for m in _RUNS.finditer(folded):
        a, b = m.span()
        if folded[a].isascii() or b - a == 1:
            places += [(a, b)] if m[0] in known else []
        else:
            places += [(i, i + 2) for i in range(a, b - 1) if folded[i : i + 2] in known]
    joined: list[tuple[int, int]] = []
    for a, b in places:
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def _separators(body: str, a: int, b: int) -> list[int]:
    """Places in a..b that hold no token character; case counts here as it stands in the body."""
    return [i for i in range(a, b) if not _TOKEN_CHAR.match(body[i])]


def snippet(body: str | None, query: str) -> str:
    """Up to 80 characters around the first hit, hits marked; the start of the body if there is none."""
    if not body:
        return ""
    hits = _hits(_fold(body), query_terms(query))
    if not hits:
        return body[:WINDOW]
    first_a, first_b = hits[0]
    start = max(0, first_a - BEFORE)
    if start:
        found = _separators(body, start, min(start + LOOK, first_a))
        start = found[0] + 1 if found else start
    end = min(len(body), max(start + WINDOW, first_b))
    if end < len(body):
        found = _separators(body, max(start, end - LOOK), end)
        end = max(first_b, found[-1] + 1 if found else end)
    out, at = [], start
    for a, b in hits:
        a, b = max(a, start), min(b, end)
        if a < b:
            out += (body[at:a], OPEN, body[a:b], CLOSE)
            at = b
    return "".join(out) + body[at:end]


def snippet_column(body: Column | str, query: str) -> Column:
    @F.pandas_udf("string")
    def cut(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: snippet(b, query))

    return cut(body)
