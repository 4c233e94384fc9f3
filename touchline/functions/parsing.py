"""Lenient parsing and small text helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPACT_TS = "yyyyMMdd'T'HHmmss'Z'"


def to_double_or_null(text: Column) -> Column:
    """A number written as text; empty text is null."""
    return F.nullif(text, F.lit("")).cast("double")


def parse_ts(text: Column, fmt: str | None = None) -> Column:
    """ISO (default) or patterned UTC text; null where it does not parse."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def compact_ts(ts: Column) -> Column:
    return F.date_format(ts, COMPACT_TS)


def fixture_is_played(confirmed: Column, provisional: Column) -> Column:
    return F.coalesce(confirmed, F.lit(False)) | F.coalesce(provisional, F.lit(False))


def map_codes(code: Column, mapping: Mapping) -> Column:
    """Label of a code; null for an unknown code."""
    chain = None
    for key, label in mapping.items():
        hit = code == F.lit(key)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain


def join_distinct(column: Column, separator: str = " & ") -> Column:
    """Aggregate: the distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def sorted_distinct(column: Column) -> Column:
    return F.array_sort(F.collect_set(column))
