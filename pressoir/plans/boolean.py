"""The earlier query grammar: parentheses, "et" before "ou", "pas", zones and date comparisons, as one nested condition."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ir import period_end, period_start


@dataclass(frozen=True)
class Node:
    """An operator ('et', 'ou', 'pas') with children, or a leaf (field, comparison, value)."""

    kind: str
    children: tuple[Node, ...] = ()
    field: str = "texte"
    comparison: str = "="
    value: str = ""


_token = re.compile(r'\(|\)|"[^"]*"|(?:<=|>=|=|:)|[^\s()":=<>]+')
_compare = {"avant": "<=", "jusqu'à": "<=", "jusqu'au": "<=", "depuis": ">=", "après": ">=", "dès": ">="}
_fields = {"titre", "texte", "legendes", "rubrique", "date"}


def parse(text: str) -> Node:
    """The tree of an expression; ValueError where it is malformed. Leaves: word, zone:word, rubrique=word, date>=2012-05, depuis 2012."""
    items = _token.findall(text.replace("’", "'"))
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def take() -> str:
        nonlocal at
        if at >= len(items):
            raise ValueError("the expression ends too soon")
        at += 1
        return items[at - 1]

    def either() -> Node:
        parts = [both()]
        while (peek() or "").lower() == "ou":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("ou", tuple(parts))

    def both() -> Node:
        parts = [one()]
        while peek() is not None and peek() != ")" and peek().lower() != "ou":
            if peek().lower() == "et":
                take()
            parts.append(one())
        return parts[0] if len(parts) == 1 else Node("et", tuple(parts))

    def one() -> Node:
        t = take()
        low = t.lower()
        if t == "(":
            inner = either()
            if take() != ")":
                raise ValueError("a parenthesis is not closed")
            return inner
        if low in ("pas", "non", "sauf"):
            return Node("pas", (one(),))
        if low in _compare:
            return Node("feuille", field="date", comparison=_compare[low], value=take())
        if low in _fields and peek() in ("=", ":", "<=", ">="):
            sign = take()
            return Node("feuille", field=low, comparison="=" if sign == ":" else sign, value=take().strip('"').lower())
        if t in (")", "=", ":", "<=", ">="):
            raise ValueError(f"{t} is out of place")
        return Node("feuille", value=t.strip('"').lower())

    tree = either()
    if at < len(items):
        raise ValueError(f"{items[at]} is out of place")
    return tree


def condition(node: Node) -> Column:
    """The tree as one condition over (titre, texte, legendes, rubrique, date); nulls fail a leaf and pass its negation."""
    if node.kind == "pas":
        return ~condition(node.children[0])
    if node.kind in ("et", "ou"):
        out = condition(node.children[0])
        for c in node.children[1:]:
            out = out & condition(c) if node.kind == "et" else out | condition(c)
        return out
    if node.field == "date":
        start, end = (F.lit(f(node.value).isoformat(" ")).cast("timestamp") for f in (period_start, period_end))
        test = {"=": F.col("date").between(start, end), "<=": F.col("date") <= end, ">=": F.col("date") >= start}[node.comparison]
    elif node.field == "rubrique":
        test = F.contains(F.lower("rubrique"), F.lit(node.value))
    else:
        words = node.value.split()
        test = F.size(F.array_intersect(tokens(F.coalesce(node.field, F.lit(""))), F.array(*map(F.lit, words)))) == len(set(words))
    return F.coalesce(test, F.lit(False))
