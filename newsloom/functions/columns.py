"""Small Column idioms shared by the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain Column would be copied into every place (and every lambda iteration)
    that mentions it; binding it as a lambda variable keeps it computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def nested(replacements: list[tuple[str, str]], value: Column) -> Column:
    for old, new in replacements:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def pin(value: Column) -> Column:
    """The same value, computed exactly where it is projected.

    An inferred or pushed-down filter would otherwise inline a costly expression
    once per mention. The partition id is never negative, so the branch is always
    taken, but it makes the column nondeterministic to the optimizer.
    """
    return F.when(F.spark_partition_id() >= 0, value)


MARK = "\x01"


def groups(value: Column, pattern: str, count: int) -> Column:
    """All capture groups of one whole-value match as an array, in a single pass of the regex."""
    return F.split(F.regexp_replace(value, pattern, MARK.join(f"${i}" for i in range(1, count + 1))), MARK, -1)
