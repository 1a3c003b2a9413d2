"""The registry of scalar functions. A name stands for a function of columns, or a plain function with a result type."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Expr, Native, Opaque

FUNCTIONS: dict[str, Callable[..., Column]] = {}
_plain: dict[str, tuple[Callable, str]] = {}


def function(name: str, to_column: Callable[..., Column] | None = None, returns: str | None = None):
    """Register a function of columns, or, with returns, a plain one that runs as a user function unless to_column is
    given."""

    def add(fn):
        if to_column is not None or returns is None:
            FUNCTIONS[name] = to_column or fn
        else:
            _plain[name] = (fn, returns)
        return fn

    return add


def call(name: str | Callable, *args: Any) -> Expr:
    """A call in a row function or rule. A callable is taken as a function of columns."""
    if callable(name):
        return Native(name, *args)
    if name in FUNCTIONS:
        return Native(FUNCTIONS[name], *args)
    fn, returns = _plain[name]
    return Opaque(fn, returns, *args)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


FUNCTIONS |= {
    # numbers
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: a.cast("double") / b,
    "div": lambda a, b: F.when((a < 0) != (b < 0), -F.floor(F.abs(a) / F.abs(b))).otherwise(F.floor(F.abs(a) / F.abs(b))).cast("long"),
    "rem": lambda a, b: a % b,
    "abs": F.abs,
    "negate": lambda a: -a,
    "round": lambda a: F.round(a, 0).cast("long"),
    "trunc": lambda a: a.cast("long"),
    "floor": lambda a: F.floor(a).cast("long"),
    "ceil": lambda a: F.ceil(a).cast("long"),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    # tests
    "is_nil": lambda a: a.isNull(),
    "equal": lambda a, b: a == b,
    "compare": lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0),
    # strings
    "concat": lambda *c: F.concat(*map(_text, c)),
    "join": lambda *c: F.concat(*map(_text, c)),
    "to_string": _text,
    "byte_size": F.octet_length,
    "length": F.length,
    "starts_with": lambda a, b: a.startswith(b),
    "trim": F.trim,
    "upcase": F.upper,
    "downcase": F.lower,
    # lists and maps
    "hd": lambda a: F.get(a, F.lit(0)),
    "tl": lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))),
    "size": F.size,
    "elem": lambda a, i: F.get(a, i),
    "member": lambda a, x: F.coalesce(F.array_contains(a, x), F.lit(False)),
    "map_size": F.size,
    # dates and times
    "date_add": lambda d, n: F.date_add(d, n.cast("int")),
    "date_range": lambda a, b: F.sequence(a, b),
    "day_of_week": lambda d: F.weekday(d) + 1,
    "diff_hours": lambda a, b: F.timestamp_diff("HOUR", b, a),
    "diff_days": lambda a, b: F.datediff(a, b),
    "shift_days": lambda t, n: t + F.make_dt_interval(n.cast("int")),
    "to_date": lambda t: t.cast("date"),
    "year": F.year,
    "month": F.month,
}
