"""Functions that can fail come in two forms: ``f`` raises, ``try_f`` gives NULL. A NULL argument gives NULL in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def num(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strict(ok: Column, value: Column, message: Column | str) -> Column:
    """``value`` where ``ok``, NULL where ``ok`` is NULL, else an error. The error stands in a branch, where no optimizer rule evaluates it early."""
    return F.when(ok.isNull(), F.lit(None)).when(ok, value).otherwise(F.raise_error(message))


def both(rule: Callable[..., tuple[Column, Column, Column | str]], name: str) -> tuple[Callable[..., Column], Callable[..., Column]]:
    """The raising and the NULL-giving function of a rule that gives condition, value and message."""

    def f(*args, **kw):
        return strict(*rule(*args, **kw))

    def try_f(*args, **kw):
        ok, value, _ = rule(*args, **kw)
        return F.when(ok, value)

    f.__name__, try_f.__name__ = name, "try_" + name
    f.__doc__ = rule.__doc__
    try_f.__doc__ = (rule.__doc__ or "") + " NULL where it would raise."
    return f, try_f


def within(index: Column, size: Column | int, length: Column) -> Column:
    """0 <= index, 0 <= size, index + size <= length, in 64 bits."""
    i, n = index.cast("bigint"), num(size).cast("bigint")
    return (i >= 0) & (n >= 0) & (i + n <= length)


OUT_OF_BOUNDS = "index out of bounds"


def require(ok: Column, value: Column, message: Column | str) -> Column:
    """A precondition: ``value`` where ``ok`` holds, else an error with the message."""
    return strict(ok, value, message)


def try_require(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


MAX_CELL = 2**31 - 1 - 8


def check_size(n: Column) -> Column:
    """``n`` bytes, if one binary cell can hold them, else an error."""
    return strict((n >= 0) & (n <= MAX_CELL), n, F.concat(F.lit("cell too large: "), n.cast("string")))
