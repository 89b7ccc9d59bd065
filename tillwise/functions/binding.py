"""Naming intermediate values inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body in which a value is computed once, however often the body names it.

    A column that is named several times is otherwise computed several times, as branches of a
    condition share nothing. Bodies stay out of generated stages, which also keeps wide
    projections of parsers below the size of method that the JVM still compiles.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body: Callable[..., Column], **values: Column) -> Column:
    """As :func:`let` with several named values, passed to the body by name."""
    held = F.struct(*[value.alias(name) for name, value in values.items()])
    return let(held, lambda s: body(**{name: s[name] for name in values}))
