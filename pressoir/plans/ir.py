"""The structured query, its periods and how date conditions fold into bounds."""

from __future__ import annotations

import calendar
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta


@dataclass(frozen=True)
class StructuredQuery:
    """What a question asks for. Operators are 'AND', 'OR' or None; bounds are naive UTC times; periods are 'YYYY', 'YYYY-MM', 'YYYY-MM-DD' or two days joined by '/'."""

    raw_query: str = ""
    content_terms: tuple[str, ...] = ()
    content_operator: str | None = None
    title_terms: tuple[str, ...] = ()
    title_operator: str | None = None
    rubric_terms: tuple[str, ...] = ()
    rubric_operator: str | None = None
    negated_content_terms: tuple[str, ...] = ()
    negated_rubric_terms: tuple[str, ...] = ()
    date_start: datetime | None = None
    date_end: datetime | None = None
    excluded_periods: tuple[str, ...] = ()
    has_image: bool = False
    target: str = "articles"

    def apply(self, f: Callable[[str], str], fields: tuple[str, ...] = ("content_terms", "title_terms", "negated_content_terms")) -> StructuredQuery:
        """The query with ``f`` mapped over lists of terms."""
        return replace(self, **{n: tuple(f(t) for t in getattr(self, n)) for n in fields})


def period_start(period: str) -> datetime:
    return datetime(*(int(x) for x in [*period.split("-"), "1", "1"][:3]))


def period_end(period: str) -> datetime:
    """Last microsecond of a day, month or year."""
    parts = [int(x) for x in period.split("-")]
    y, m = parts[0], parts[1] if len(parts) > 1 else 12
    d = parts[2] if len(parts) > 2 else calendar.monthrange(y, m)[1]
    return datetime(y, m, d) + timedelta(days=1) - timedelta(microseconds=1)


def period_bounds(period: str) -> tuple[datetime, datetime] | None:
    """First and last instant of a period; None where it cannot be read."""
    try:
        a, _, b = period.partition("/")
        return period_start(a), period_end(b or a)
    except (ValueError, IndexError):
        return None


@dataclass
class Bounds:
    start: datetime | None = None
    end: datetime | None = None
    excluded: list[str] = field(default_factory=list)


def fold_dates(conditions: list[dict]) -> Bounds:
    """Bounds of several conditions: they intersect. A month excluded without a year is excluded in every year between known bounds, else ignored.

    'after' is inclusive; 'before' ends a microsecond earlier.
    """
    starts: list[datetime] = []
    ends: list[datetime] = []
    months: list[int] = []
    out = Bounds()
    for c in conditions:
        kind = c.get("type")
        if kind == "exact_date":
            starts.append(period_start(c["date"]))
            ends.append(period_end(c["date"]))
        elif kind == "year":
            starts.append(period_start(str(c["year"])))
            ends.append(period_end(str(c["year"])))
        elif kind == "month_year":
            p = f"{c['year']:04d}-{c['month']:02d}"
            starts.append(period_start(p))
            ends.append(period_end(p))
        elif kind in ("range", "year_range"):
            starts.append(period_start(str(c["from"])))
            ends.append(period_end(str(c["to"])))
        elif kind == "after":
            starts.append(period_start(c["date"]))
        elif kind == "after_year":
            starts.append(period_start(str(c["year"])))
        elif kind == "before":
            ends.append(period_start(c["date"]) - timedelta(microseconds=1))
        elif kind == "before_year":
            ends.append(period_end(str(c["year"] - 1)))
        if "exclude_month" in c:
            months.append(c["exclude_month"])
        if "exclude_period" in c:
            out.excluded.append(c["exclude_period"])
    out.start, out.end = max(starts, default=None), min(ends, default=None)
    if out.start and out.end:
        out.excluded += [f"{y:04d}-{m:02d}" for m in months for y in range(out.start.year, out.end.year + 1)]
    out.excluded = list(dict.fromkeys(out.excluded))
    return out


def structured(parsed: dict) -> StructuredQuery:
    """The query of a parser's dictionary."""
    b = fold_dates(parsed.get("date_conditions") or [])
    return StructuredQuery(
        raw_query=parsed.get("raw_query", ""), content_terms=tuple(parsed.get("content_terms") or ()), content_operator=parsed.get("content_operator"), title_terms=tuple(parsed.get("title_terms") or ()), title_operator=parsed.get("title_operator"),
        rubric_terms=tuple(parsed.get("rubric_terms") or ()), rubric_operator=parsed.get("rubric_operator"), negated_content_terms=tuple(parsed.get("negated_content_terms") or ()), negated_rubric_terms=tuple(parsed.get("negated_rubric_terms") or ()),
        date_start=b.start, date_end=b.end, excluded_periods=tuple(b.excluded), has_image=bool(parsed.get("has_image")), target="rubriques" if parsed.get("return_fields") == ["rubric"] else "articles",
    )
