"""Term lists: containment tests, ordered hits and ordered label rules.

A term list is a plain Python list (a parameter or a lexicon constant).  It
reaches the plan as one constant array, so a test is one lambda over that array
inside a projection: no join, no shuffle, and no code that grows with the list.
The size is known where the plan is built; ``check_terms`` refuses lists that
would bloat the plan, and ``operators.search.term_hits`` joins on pieces instead.

The text of every test should be a plain column (see ``columns.let``), because
it is read once per term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col

MAX_LITERAL_TERMS = 1000
MARK = "\x1f"
Rules = Sequence[tuple[str, Sequence[str]]]


def check_terms(terms: Sequence[str]) -> Sequence[str]:
    if len(terms) > MAX_LITERAL_TERMS:
        raise ValueError(f"{len(terms)} terms are too many for a constant; use operators.search.term_hits")
    return terms


def constant(values: Sequence[str]) -> Column:
    """A constant array of strings; folded to a literal when the plan is optimized."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(MARK.join(values)), MARK)


def contains_any(text: Column | str, terms: Sequence[str]) -> Column:
    """True if any term occurs; a null text holds no term."""
    text = as_col(text)
    if not terms:
        return F.lit(False)
    if len(terms) == 1:
        return F.coalesce(F.contains(text, F.lit(terms[0])), F.lit(False))
    return F.coalesce(F.exists(constant(check_terms(terms)), lambda t: F.contains(text, t)), F.lit(False))


def hits(text: Column | str, terms: Sequence[str]) -> Column:
    """The terms that occur, in list order, each once."""
    text = as_col(text)
    return F.filter(constant(list(dict.fromkeys(check_terms(terms)))), lambda t: F.contains(text, t))


def count_hits(text: Column | str, terms: Sequence[str]) -> Column:
    return F.size(hits(text, terms))


def compact(values: Sequence[Column]) -> Column:
    """Array of the non-null values, in order."""
    if not values:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*values))


def _labelled(text: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Labels of the (label, term) pairs whose term occurs, in pair order."""
    text = as_col(text)
    check_terms([t for _, t in pairs])
    table = F.arrays_zip(constant([n for n, _ in pairs]).alias("label"), constant([t for _, t in pairs]).alias("term"))
    return F.transform(F.filter(table, lambda p: F.contains(text, p["term"])), lambda p: p["label"])


def labels(text: Column | str, rules: Rules) -> Column:
    """Every label with at least one term in the text, in rule order."""
    return F.array_distinct(_labelled(text, [(label, term) for label, terms in rules for term in terms]))


def first_label(text: Column | str, rules: Rules) -> Column:
    """Label of the first rule that matches, else null."""
    pairs = [(label, term) for label, terms in rules for term in terms]
    if not pairs:
        return F.lit(None).cast("string")
    return F.get(_labelled(text, pairs), F.lit(0))


def longest_label(text: Column | str, rules: Rules) -> Column:
    """Label whose matched term is longest; ties go to the earlier rule."""
    flat = [(term, label, order) for order, (label, terms) in enumerate(rules) for term in terms]
    flat.sort(key=lambda row: (-len(row[0]), row[2]))
    if not flat:
        return F.lit(None).cast("string")
    return F.get(_labelled(text, [(label, term) for term, label, _ in flat]), F.lit(0))


def any_of(values: Column, text: Column) -> Column:
    """True if any array element is a non-blank part of the text."""
    return F.coalesce(F.exists(values, lambda v: (v != "") & F.contains(text, v)), F.lit(False))


def holds(text: Column, value: Column) -> Column:
    """True if ``value`` is non-blank and part of ``text``; nulls give false."""
    return F.coalesce((value != "") & F.contains(text, value), F.lit(False))


def lower_list(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
