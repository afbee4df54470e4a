"""String operators: positions count characters from 0; null in, null out unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concatenate(*parts: Column) -> Column:
    """Null if any part is."""
    return F.concat(*parts)


def combine(parts: Column, separator: Column | str = "") -> Column:
    """Nulls are skipped; nothing left, or a null separator, gives null."""
    sep = F.lit(separator) if isinstance(separator, str) else separator
    some = F.filter(parts, lambda x: x.isNotNull())
    rest = F.slice(some, 2, F.greatest(F.size(some) - 1, F.lit(0)))
    joined = F.aggregate(rest, F.get(some, F.lit(0)), lambda acc, x: F.concat(acc, sep, x))
    return F.when((F.size(some) > 0) & sep.isNotNull(), joined)


def split(text: Column, separator: Column) -> Column:
    """At a literal separator, empty parts stay; a null separator gives the whole text."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(separator, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(separator.isNull() & text.isNotNull(), F.array(text)).otherwise(F.split(text, quoted, -1))


def split_on_matches(text: Column, pattern: Column) -> Column:
    return F.split(text, pattern, -1)


def length(text: Column) -> Column:
    return F.length(text)


def upper(text: Column) -> Column:
    return F.upper(text)


def lower(text: Column) -> Column:
    return F.lower(text)


def indexer(text: Column, i: Column) -> Column:
    """The character at ``i``; null outside."""
    return F.when((i >= 0) & (i < F.length(text)), F.substring(text, i + 1, F.lit(1)))


def position_of(pattern: Column, text: Column) -> Column:
    """-1 if absent."""
    return F.instr(text, pattern) - 1


def last_position_of(pattern: Column, text: Column) -> Column:
    back = F.instr(F.reverse(text), F.reverse(pattern))
    return F.when(back == 0, -1).otherwise(F.length(text) - F.length(pattern) - (back - 1))


def substring(text: Column, start: Column, size: Column | None = None) -> Column:
    """Null if ``start`` is outside or ``size`` negative; a null size means up to the end."""
    inside = (start >= 0) & (start < F.length(text))
    if size is None:
        return F.when(inside, F.substring(text, start + 1, F.length(text)))
    return F.when(inside & (F.coalesce(size, F.lit(0)) >= 0), F.substring(text, start + 1, F.coalesce(size, F.length(text))))


def starts_with(text: Column, prefix: Column) -> Column:
    return F.startswith(text, prefix)


def ends_with(text: Column, suffix: Column) -> Column:
    return F.endswith(text, suffix)


def matches(text: Column, pattern: Column) -> Column:
    """Whether the pattern is found anywhere in the text."""
    return F.regexp_like(text, pattern)


def replace_matches(text: Column, pattern: Column, substitution: Column) -> Column:
    """All matches; $1 is a group, \\$ a dollar."""
    return F.regexp_replace(text, pattern, substitution)
