"""Completeness of a report and the summaries written from its fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.functions.text import (
    blank_to_null,
    empty_to_null,
    extract_title,
    first_chars,
    sentences,
    strip,
)


def is_missing(value: Column) -> Column:
    """Null, or fewer than five characters once stripped."""
    return F.coalesce(F.length(strip(value)) < 5, F.lit(True))


def missing_fields(fields: Mapping[str, Column]) -> Column:
    """Names of the required fields that are missing, in the fixed order."""
    names = [F.when(is_missing(fields[f]), F.lit(f)) for f, _, _ in fv.REQUIRED_FIELDS]
    return F.array_compact(F.array(*names))


def missing_details(fields: Mapping[str, Column]) -> Column:
    """As :func:`missing_fields`, each with its label and a suggestion."""
    rows = [
        F.when(
            is_missing(fields[f]),
            F.struct(
                F.lit(f).alias("field"),
                F.lit(label).alias("label"),
                F.lit(suggestion).alias("suggestion"),
            ),
        )
        for f, label, suggestion in fv.REQUIRED_FIELDS
    ]
    return F.array_compact(F.array(*rows))


def present_fields(missing: Column) -> Column:
    """The required fields that are not in ``missing``."""
    return F.array_except(F.array(*[F.lit(f) for f, _, _ in fv.REQUIRED_FIELDS]), missing)


def _labelled(label: str, value: Column, n: int) -> Column:
    return F.concat(F.lit(label), first_chars(empty_to_null(value), n))


def _or_else(parts: list[Column], separator: str, fallback: Column) -> Column:
    return F.coalesce(empty_to_null(F.concat_ws(separator, *parts)), fallback)


def stored_summary(
    title: Column,
    severity: Column,
    description: Column,
    steps: Column,
    expected: Column,
    actual: Column,
) -> Column:
    """Summary of a stored report: title, severity, first long sentence and sections."""
    sentence = F.get(sentences(description, 20), F.lit(0))
    title = F.when(title != fv.UNTITLED, empty_to_null(title))
    parts = [
        F.concat(F.lit("**"), title, F.lit("**")),
        F.concat(F.lit("Severity: "), F.when(severity != "nan", empty_to_null(severity))),
        F.concat(first_chars(sentence, 200), F.lit(".")),
        _labelled("Steps: ", steps, 150),
        _labelled("Expected: ", expected, 100),
        _labelled("Actual: ", actual, 100),
    ]
    return _or_else(parts, " | ", F.lit("No summary available"))


def query_summary(
    title: Column,
    description: Column,
    best_id: Column,
    best_title: Column,
    best_score: Column,
) -> Column:
    """Summary of an incoming report, naming its best match when that scores above 0.5."""
    sentence = F.get(sentences(description, 15), F.lit(0))
    similar = F.concat(
        F.lit("(Similar to "), best_id, F.lit(": "), first_chars(best_title, 80), F.lit(")")
    )
    parts = [
        empty_to_null(title),
        F.concat(sentence, F.lit(".")),
        F.when(best_score > fv.POSSIBLE_DUPLICATE_THRESHOLD, similar),
    ]
    fallback = F.lit("Insufficient information for summary generation.")
    return _or_else(parts, " ", fallback)


def enhanced_title(title: Column, description: Column) -> Column:
    """Title of at least five characters or an extracted one, marked once as enhanced."""
    chosen = F.when(is_missing(title), extract_title(description)).otherwise(title)
    marked = F.concat(F.lit("[ENHANCED] "), chosen)
    return F.when(chosen.startswith("[ENHANCED]"), chosen).otherwise(marked)


def enhanced_summary(
    description: Column,
    steps: Column,
    actual: Column,
    expected: Column,
    environment: Column,
) -> Column:
    """Two sentences of the description and the labelled sections, else the description."""
    pieces = F.slice(sentences(description, 15), 1, 2)
    lead = empty_to_null(F.array_join(F.transform(pieces, lambda s: F.concat(s, F.lit("."))), " | "))
    parts = [
        lead,
        _labelled("Steps to reproduce: ", steps, 200),
        _labelled("Actual behavior: ", actual, 150),
        _labelled("Expected behavior: ", expected, 150),
        _labelled("Environment: ", environment, 100),
    ]
    return _or_else(parts, " | ", F.coalesce(first_chars(description, 300), F.lit("")))


def rejection_reasons(rules: Mapping[str, Column]) -> Column:
    """Reasons whose condition holds, in the order given; empty means accepted."""
    reasons = [F.when(broken, F.lit(reason)) for reason, broken in rules.items()]
    return F.array_compact(F.array(*reasons))


def form_errors(title: Column, description: Column) -> Column:
    """One message per required form field that is blank."""
    return rejection_reasons(
        {
            "Title is required": blank_to_null(title).isNull(),
            "Description is required": blank_to_null(description).isNull(),
        }
    )


def shorter_than(text: Column, n: int) -> Column:
    """True when the stripped text has fewer than ``n`` characters or is null."""
    return F.coalesce(F.length(strip(text)) < n, F.lit(True))
