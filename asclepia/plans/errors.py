"""The errors that users of the language see, each with a code of its range: CQL0001 syntax, CQL0100 meaning, CQL0200 evaluation,
CQL0300 data model, CQL0400 files and settings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class QueryError(Exception):
    """Any error of the language; ``code`` is CQL and four digits."""

    first = 0

    def __init__(self, message: str, number: int = 0) -> None:
        super().__init__(message)
        self.code = f"CQL{self.first + number:04d}"

    def __str__(self) -> str:
        return f"{self.code}: {self.args[0]}"


class SyntaxProblem(QueryError, ValueError):
    """Text that isn't of the language, with the place. 1: an unexpected character, 2: an unexpected word or end."""

    def __init__(self, message: str, number: int = 2) -> None:
        super().__init__(message, number)


class CompileError(QueryError, ValueError):
    """An expression that has no meaning. 100: other, 101: an unknown name, 102: an unknown function or overload, 103: types that don't fit,
    104: a cycle, 105: a literal out of range, 106: an ambiguous call."""

    first = 100


class EvaluationError(QueryError, ArithmeticError):
    """Data for which an expression has no value. 200: other, 201: out of range, 202: division by zero, 203: text that doesn't convert, 204: no such date or time,
    205: units that differ, 206: an invalid interval, 207: a message of severity error."""

    first = 200


class ModelError(QueryError, KeyError):
    """300: other, 301: an unknown type, 302: an unknown element, 303: no catalog."""

    first = 300


class SettingError(QueryError, OSError):
    """400: other, 401: no file for a library, 402: a parameter that isn't name=value."""

    first = 400


#: What Spark says, and the number within CQL0200.
_CONDITIONS = (
    (r"units (differ|that can't)", 5), (r"invalid interval", 6), (r"^\[?USER_RAISED_EXCEPTION\]?.*message: ", 7), (r"DATETIME_FIELD_OUT_OF_BOUNDS|(year|time|offset) out of range|year \d+ is out of range|first (date|time)|last (date|time)", 4),
    (r"DIVIDE_BY_ZERO", 2), (r"OVERFLOW|OUT_OF_RANGE|overflow", 1), (r"CAST_INVALID_INPUT|CONVERSION_INVALID_INPUT|not a ratio", 3),
)


@contextmanager
def evaluating() -> Iterator[None]:
    """Spark's errors, and those of Python's own values, as :class:`EvaluationError`."""
    try:
        yield
    except QueryError:
        raise
    except (PySparkException, ArithmeticError, ValueError) as e:
        text = str(e)
        number = next((n for pattern, n in _CONDITIONS if re.search(pattern, text)), 0)
        raise EvaluationError(text.split("\n")[0] or type(e).__name__, number) from e
