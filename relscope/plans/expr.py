"""Expressions that row functions record.

A row function gets a reference to a row (``o``) and returns an expression (``o.customer.nation.n_name == "X"``).
Nothing is evaluated in Python; plans/lower.py turns expressions into columns and joins.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_vars = itertools.count()


def new_var() -> int:
    return next(_vars)


class Expr:
    __hash__ = object.__hash__

    def __eq__(self, other):  # type: ignore[override]
        return Op("==", self, wrap(other))

    def __ne__(self, other):  # type: ignore[override]
        return Op("not", Op("==", self, wrap(other)))

    def __lt__(self, other):
        return Op("<", self, wrap(other))

    def __le__(self, other):
        return Op("<=", self, wrap(other))

    def __gt__(self, other):
        return Op(">", self, wrap(other))

    def __ge__(self, other):
        return Op(">=", self, wrap(other))

    before, after = __lt__, __gt__

    def __and__(self, other):
        return Op("and", self, wrap(other))

    def __rand__(self, other):
        return Op("and", wrap(other), self)

    def __or__(self, other):
        return Op("or", self, wrap(other))

    def __ror__(self, other):
        return Op("or", wrap(other), self)

    def __invert__(self):
        return Op("not", self)

    def __add__(self, other):
        return Op("+", self, wrap(other))

    def __radd__(self, other):
        return Op("+", wrap(other), self)

    def __sub__(self, other):
        return Op("-", self, wrap(other))

    def __rsub__(self, other):
        return Op("-", wrap(other), self)

    def __mul__(self, other):
        return Op("*", self, wrap(other))

    __rmul__ = __mul__

    def __truediv__(self, other):
        return Op("/", self, wrap(other))

    def __mod__(self, other):
        return Op("%", self, wrap(other))

    def is_nil(self):
        return Op("==", self, Lit(None))

    def is_in(self, *values):
        """Equal to one of the values; None among them matches missing values."""
        given = [v for v in values if v is not None]
        found: Expr = Op("in", self, *map(wrap, given)) if given else Lit(False)
        return found | self.is_nil() if len(given) < len(values) else found

    def compare(self, other):
        """-1, 0 or 1, as comparing times does."""
        other = wrap(other)
        return case((Op("<", self, other), -1), (Op(">", self, other), 1), (Op("==", self, other), 0))

    def __bool__(self):
        raise TypeError("an expression has no truth value here; use & | ~ instead of and, or, not")


class Lit(Expr):
    def __init__(self, value: Any):
        self.value = value


class Op(Expr):
    def __init__(self, name: str, *args: Expr):
        self.name, self.args = name, args


class Native(Expr):
    """A function from columns to a column."""

    def __init__(self, fn: Callable[..., Column], *args: Any):
        self.fn, self.args = fn, tuple(map(wrap, args))


class Opaque(Expr):
    """A Python function of plain values: evaluated by a user function, never pushed down."""

    def __init__(self, fn: Callable, returns: str, *args: Any):
        self.fn, self.returns, self.args = fn, returns, tuple(map(wrap, args))


class Case(Expr):
    def __init__(self, branches: list[tuple[Expr, Expr]], default: Expr | None, strict: bool):
        self.branches, self.default, self.strict = branches, default, strict
        self.args = tuple(itertools.chain.from_iterable(branches)) + ((default,) if default is not None else ())


class Struct(Expr):
    def __init__(self, fields: dict[str, Any]):
        self.names, self.args = tuple(fields), tuple(map(wrap, fields.values()))


class Array(Expr):
    def __init__(self, *items: Any):
        self.args = tuple(map(wrap, items))


class Quantified(Expr):
    """any, all or count over an association's rows (a Ref) or over a scope."""

    def __init__(self, kind: str, source: Any, filters: tuple[Callable, ...] = ()):
        self.kind, self.source, self.filters = kind, source, filters
        self.var = new_var()
        self.pred = conj([wrap(f(Ref(self.var))) for f in filters])


class Collected(Expr):
    """The rows of a has_many association as an ordered array of values, the first ``limit`` if that is given.

    order: functions of a row, each with whether it is descending; missing keys come last, ties are in key order.
    """

    def __init__(self, source: Any, filters: tuple[Callable, ...], mapper: Callable, order: Callable | Sequence[tuple[Callable, bool]] | None = None, limit: int | None = None):
        self.source = source
        self.var = new_var()
        row = Ref(self.var)
        self.pred = conj([wrap(f(row)) for f in filters])
        self.value = wrap(mapper(row))
        keys = [(order, False)] if callable(order) else order or ()
        self.order = [(wrap(key(row)), desc) for key, desc in keys]
        self.limit = limit


class Scalar(Expr):
    """An aggregate of a whole scope, as a value of one row."""

    def __init__(self, frame):
        self.frame = frame


class Many:
    """A has_many association being filtered; ends in any, all, count, map or to_list."""

    def __init__(self, source: Any, filters: tuple[Callable, ...] = ()):
        self.source, self.filters = source, filters

    def filter(self, fn: Callable) -> Many:
        return Many(self.source, (*self.filters, fn))

    def reject(self, fn: Callable) -> Many:
        return self.filter(lambda r: ~truthy(wrap(fn(r))))

    def any(self, fn: Callable | None = None) -> Quantified:
        return Quantified("any", self.source, (*self.filters, *([fn] if fn else [])))

    def all(self, fn: Callable) -> Expr:
        """No row for which fn is false; rows where it is unknown do not count against it."""
        return Op("not", Quantified("any", self.source, (*self.filters, lambda r: Op("not", truthy(wrap(fn(r)))))))

    def count(self, fn: Callable | None = None) -> Quantified:
        return Quantified("count", self.source, (*self.filters, *([fn] if fn else [])))

    def map(self, fn: Callable, order: Callable | None = None) -> Collected:
        return Collected(self.source, self.filters, fn, order)


class Ref(Expr):
    """A field or association of a row, by path."""

    def __init__(self, var: int, path: tuple[str, ...] = ()):
        self.__dict__.update(var=var, path=path)

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("__"):
            raise AttributeError(name)
        return Ref(self.var, (*self.path, name))

    def __getitem__(self, name: str) -> Ref:
        return Ref(self.var, (*self.path, name))

    def filter(self, fn):
        return Many(self).filter(fn)

    def reject(self, fn):
        return Many(self).reject(fn)

    def any(self, fn=None):
        return Many(self).any(fn)

    def all(self, fn):
        return Many(self).all(fn)

    def count(self, fn=None):
        return Many(self).count(fn)

    def map(self, fn, order=None):
        return Many(self).map(fn, order)


class Truthy(Expr):
    """A value as a condition: booleans as they are, other values if they are there."""

    def __init__(self, arg: Expr):
        self.args = (arg,)


def truthy(e: Expr) -> Expr:
    return e if isinstance(e, (Op, Quantified, Truthy)) else Truthy(e)


def both(a, b) -> Expr:
    """a && b: both are there and not false."""
    return Op("and", truthy(wrap(a)), truthy(wrap(b)))


def either(a, b) -> Expr:
    """a || b as a condition."""
    return Op("or", truthy(wrap(a)), truthy(wrap(b)))


def case(*branches: tuple[Any, Any], default: Any = None, strict: bool = False) -> Case:
    """The value of the first branch whose condition holds; without one the default, or an error if strict."""
    return Case([(truthy(wrap(c)), wrap(v)) for c, v in branches], None if strict else wrap(default), strict)


def match(subject: Any, *clauses: tuple[Any, Any], default: Any = None, strict: bool = False) -> Case:
    """case by pattern: a pattern is a literal, None, a dict of patterns by field, a function of the subject, or _."""
    subject = wrap(subject)
    return case(*((_pattern(subject, p), v(subject) if callable(v) else v) for p, v in clauses), default=default, strict=strict)


ANY = object()


def _pattern(subject: Expr, pattern: Any) -> Expr:
    if pattern is ANY:
        return Lit(True)
    if callable(pattern) and not isinstance(pattern, Expr):
        return truthy(wrap(pattern(subject)))
    if isinstance(pattern, dict):
        return conj([_pattern(subject[k], p) for k, p in pattern.items()])
    return Op("==", subject, wrap(pattern))


def concat(*parts: Any) -> Native:
    """Interpolation: a missing part counts as ''."""
    return Native(lambda *c: F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in c)), *parts)


def opaque(fn: Callable, returns: str = "boolean") -> Callable[..., Opaque]:
    """Wrap a plain Python function for use in row functions; it becomes a user function over its arguments."""
    return lambda *args: Opaque(fn, returns, *args)


def native(fn: Callable[..., Column]) -> Callable[..., Native]:
    """Wrap a function of columns for use in row functions."""
    return lambda *args: Native(fn, *args)


def wrap(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, Many):
        return x.map(lambda r: r)
    if isinstance(x, dict):
        return Struct(x)
    if isinstance(x, (list, tuple)):
        return Array(*x)
    return Lit(x)


def conj(parts: list[Expr]) -> Expr:
    out: Expr | None = None
    for p in parts:
        out = truthy(p) if out is None else Op("and", out, truthy(p))
    return Lit(True) if out is None else out


def conjuncts(e: Expr) -> Iterator[Expr]:
    if isinstance(e, Op) and e.name == "and":
        for x in e.args:
            yield from conjuncts(x)
    elif not (isinstance(e, Lit) and e.value is True):
        yield e


def parts(e: Expr) -> Iterator[Expr]:
    """The expression and all below it, those of nested row functions included."""
    yield e
    below = list(getattr(e, "args", ()) or ()) if not isinstance(e, Ref) else []
    if isinstance(e, Quantified):
        below += [e.pred, *([e.source] if isinstance(e.source, Ref) else [])]
    if isinstance(e, Collected):
        below += [e.pred, e.value, e.source, *(key for key, _ in e.order)]
    for x in below:
        yield from parts(x)


def refs(e: Expr) -> list[Ref]:
    return [x for x in parts(e) if isinstance(x, Ref)]


def opaque_in(e: Expr) -> bool:
    return any(isinstance(x, Opaque) for x in parts(e))
