"""Structured queries to DataFrame plans: semi- and anti-joins on postings, predicates on columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_accents
from ..operators.postings import matching
from .ir import StructuredQuery, period_bounds


def any_rubric(terms: tuple[str, ...], operator: str | None = "OR", folded: bool = False) -> Column:
    """Whether the rubric holds any or all of the terms as substrings, whatever the case; ``folded`` ignores accents too. Null for a null rubric."""
    column = fold_accents("rubrique") if folded else F.lower("rubrique")
    tests = [F.contains(column, fold_accents(F.lit(t)) if folded else F.lit(t.lower())) for t in terms]
    return reduce(and_ if operator == "AND" else or_, tests)


def predicates(query: StructuredQuery, folded: bool = False) -> list[Column]:
    """The criteria on a document's own columns. Null dates and rubrics fail bounds and wanted rubrics, and pass exclusions."""
    out: list[Column] = []
    if query.rubric_terms:
        out.append(any_rubric(query.rubric_terms, query.rubric_operator or "OR", folded))
    if query.negated_rubric_terms:
        out.append(F.coalesce(~any_rubric(query.negated_rubric_terms, "OR", folded), F.lit(True)))
    if query.has_image:
        out.append(F.coalesce(F.exists("images", lambda x: F.coalesce(x["url"] != "", F.lit(False))), F.lit(False)))
    if query.date_start:
        out.append(F.col("date") >= F.lit(query.date_start.isoformat(" ")).cast("timestamp"))
    if query.date_end:
        out.append(F.col("date") <= F.lit(query.date_end.isoformat(" ")).cast("timestamp"))
    for bounds in map(period_bounds, query.excluded_periods):
        if bounds:
            a, b = (F.lit(x.isoformat(" ")).cast("timestamp") for x in bounds)
            out.append(F.coalesce(~F.col("date").between(a, b), F.lit(True)))
    return out


def resolve(index: DataFrame, names: tuple[str, ...]) -> str:
    """The first of the names that is a zone of the index, else the last; a name without rows gives no documents."""
    return next((n for n in names[:-1] if index.where(F.col("zone") == n).limit(1).count()), names[-1])


def select(docs: DataFrame, index: DataFrame, query: StructuredQuery, strict: bool = False, folded: bool = False, content: tuple[str, ...] = ("texte",), title: tuple[str, ...] = ("titre",)) -> DataFrame:
    """The documents that meet all criteria.

    ``index`` has (zone, token, fichier); ``content`` and ``title`` name the zones for either field, with others to fall back on. Text and title terms are semi-joins, negated expressions anti-joins; all else filters the documents below them.
    """
    for p in predicates(query, folded):
        docs = docs.where(p)
    body = resolve(index, content) if query.content_terms or query.negated_content_terms else ""
    if query.content_terms:
        docs = docs.join(matching(index, list(query.content_terms), query.content_operator or "AND", body, strict), "fichier", "left_semi")
    if query.title_terms:
        docs = docs.join(matching(index, list(query.title_terms), query.title_operator or "AND", resolve(index, title), strict), "fichier", "left_semi")
    for expression in query.negated_content_terms:
        docs = docs.join(matching(index, expression.lower().split(), "AND", body), "fichier", "left_anti")
    return docs


def rubrics(docs: DataFrame) -> DataFrame:
    """(rubrique): the distinct non-empty rubrics."""
    return docs.where(F.col("rubrique") != "").select("rubrique").distinct()


def search(docs: DataFrame, index: DataFrame, query: StructuredQuery, strict: bool = False, folded: bool = False) -> DataFrame:
    """Articles, newest first with undated ones last and ties by fichier, or the rubrics of the articles found, in order."""
    found = select(docs, index, query, strict, folded)
    if query.target == "rubriques":
        return rubrics(found).orderBy("rubrique")
    return found.orderBy(F.col("date").desc_nulls_last(), "fichier")
