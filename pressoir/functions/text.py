"""Text functions as Column expressions: tokens, standardisation, substitution, highlighting, dates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits and underscores, in any script.
TOKEN = r"[\p{L}\p{N}_]+"
RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """The tokens in lower case, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))


def standardize(c: Column | str, hyphens: bool = False, inert_apostrophe: bool = False, curly: bool = False) -> Column:
    """Stripped, lower case, apostrophes as blanks, punctuation dropped.

    ``hyphens`` makes hyphens blanks too; ``inert_apostrophe`` drops punctuation first, so that words around an
    apostrophe are glued; ``curly`` treats the typographic apostrophe like the plain one.
    """
    out = F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))
    if curly:
        out = F.translate(out, "’‘", "''")
    if hyphens:
        out = F.translate(out, "-", " ")
    if not inert_apostrophe:
        out = F.translate(out, "'", " ")
    return F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", "")


def substitute(c: Column | str, table: Column) -> Column:
    """Whole words replaced by a map column's values, whatever their case; what stands between words is untouched."""
    runs = F.regexp_extract_all(_col(c), F.lit(RUNS), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), x)), "")


def fold_accents(c: Column | str) -> Column:
    """Lower case without the accents of French."""
    return F.translate(F.lower(_col(c)), "àâäáãçéèêëîïíìôöóòõùûüúÿñ’‘‛", "aaaaaceeeeiiiiooooouuuuyn'''")


def normalize_signs(c: Column | str) -> Column:
    """Typographic apostrophes and quotation marks made plain."""
    return F.translate(_col(c), "’‘‛«»“”", "'''\"\"\"\"")


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix."""
    a, b = _col(a), _col(b)
    least = F.least(F.length(a), F.length(b))
    steps = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def prefix_score(a: Column | str, b: Column | str, least: int = 3, gap: int = 4) -> Column:
    """floor(100 * common prefix / longer length); 0 for words shorter than ``least`` or too far apart in length."""
    a, b = _col(a), _col(b)
    la, lb = F.length(a), F.length(b)
    score = F.floor(common_prefix(a, b) * 100 / F.greatest(la, lb))
    return F.when((la < least) | (lb < least) | (F.abs(la - lb) > gap), F.lit(0).cast("long")).otherwise(score)


def any_term(terms: list[str]) -> str:
    """A pattern of any of the terms as they stand; the longest first."""
    return "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def highlight(c: Column | str, terms: list[str]) -> Column:
    """Every occurrence of a term in ``**``, whatever its case; no terms, no change."""
    terms = [t for t in terms if t]
    return F.regexp_replace(_col(c), f"(?iu)({any_term(terms)})", r"**$1**") if terms else _col(c)


def word_count(c: Column | str, terms: list[str]) -> Column:
    """How many tokens equal one of the one-word terms."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms]) if terms else F.array().cast("array<string>")
    return F.size(F.filter(tokens(c), lambda x: F.array_contains(wanted, x)))


def document_id(c: Column | str) -> Column:
    """Blanks as underscores, commas as semicolons: an id that fits a list of ``id:count`` pairs."""
    return F.translate(_col(c), " ,", "_;")


def slash_date(c: Column | str) -> Column:
    """dd/mm/yyyy as a date, null where it is none."""
    return F.when(is_slash_date(c), F.try_to_timestamp(_col(c), F.lit("dd/MM/yyyy")).cast("date"))


def is_slash_date(c: Column | str) -> Column:
    return _col(c).rlike(r"^\d{2}/\d{2}/\d{4}$")


def display_date(c: Column | str) -> Column:
    return F.date_format(_col(c), "dd MMMM yyyy")


def period_end(c: Column | str, unit: str) -> Column:
    """Last microsecond of the day, month or year that a timestamp begins."""
    start = F.date_trunc(unit, _col(c))
    step = {"day": "1 day", "month": "1 month", "year": "1 year"}[unit]
    return start + F.expr(f"interval {step}") - F.expr("interval 1 microsecond")


def apply_filter(docs, attributes: list[str], f: Callable[[Column], Column]):
    """The documents with ``f`` applied to text columns; ``images.x`` addresses a field of every image.

    Columns that are not text are left alone.
    """
    types = dict(docs.dtypes)
    for name in attributes:
        head, _, field = name.partition(".")
        if field and types.get(head, "").startswith("array<struct<"):
            docs = docs.withColumn(head, _map_field(head, field, f))
        elif types.get(name) == "string":
            docs = docs.withColumn(name, f(F.col(name)))
    return docs


def _map_field(head: str, field: str, f: Callable[[Column], Column]) -> Column:
    return F.transform(head, lambda x: x.withField(field, f(x[field])))
