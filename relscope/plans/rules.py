"""Rules: derived values by ordered conditions, the first match wins.

Conditions are data: {"field": value} (all keys), [c1, c2] (any), ("not", c), ("all", [..]), ("gt", v) and its kin,
"name" (name is true), {"assoc": {...}} (of a :many association: any row), ("all?", c), ("ref", path), ("args", c),
("fields", c), ("bind", name[, c]). Values are data too: ("ref", path), ("call", fn, *args), ("map", path, ...),
("filter", path, c), ("count", path, c), ("count_while", path, c), ("first"/"one"/"lookup", ...), ("bound", name), dicts
and lists of values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RulesNotFoundError, TranslationError
from ..functions import call
from ..operators import arr
from ..sources.catalog import Catalog
from .expr import Case, Collected, Expr, Lit, Many, Native, Op, Ref, Struct, conj, truthy, wrap
from .scope import Scope

COMPARISONS = {
    "<": ("<", "lt", "less_than", "before"),
    "<=": ("<=", "lte", "less_than_or_equal", "on_or_before", "at_or_before"),
    ">=": (">=", "gte", "greater_than_or_equal", "on_or_after", "at_or_after"),
    ">": (">", "gt", "greater_than", "after"),
}
_operator = {name: op for op, names in COMPARISONS.items() for name in names}
_registry: dict[str, Rules] = {}


def order_keys(order: Any) -> list[tuple[Callable, bool]]:
    """Functions of a row, each with whether it is descending, of a field, ("asc" | "desc", field) or a list of these."""
    if order is None:
        return []
    if isinstance(order, list):
        return [k for o in order for k in order_keys(o)]
    way, field = order if isinstance(order, tuple) else ("asc", order)
    if way not in ("asc", "desc"):
        raise TranslationError(f"no order: {order!r}")
    return [(lambda r: r[field], way == "desc")]


class Rules:
    """Ordered rules of one entity."""

    def __init__(self, entity: str, name: str | None = None):
        self.entity = entity
        self.rules: list[tuple[str, Any, Any]] = []
        self.aliases: dict[str, Any] = {}
        self.groups: dict[str, tuple[str, ...]] = {}
        if name:
            _registry[name] = self

    def infer(self, when: Any = None, **values: Any) -> Rules:
        """Each key gets its value where the condition holds (always, without one) and no earlier rule matched."""
        when = self._expand(when)
        for key, value in values.items():
            for k in self.groups.get(key, (key,)):
                self.rules.append((k, when, value))
        return self

    def alias(self, **conditions: Any) -> Rules:
        """Names for conditions, in later rules; None removes one."""
        for name, c in conditions.items():
            if c is None:
                self.aliases.pop(name, None)
            else:
                self.aliases[name] = self._expand(c)
        return self

    def group(self, **names: Sequence[str]) -> Rules:
        self.groups |= {k: tuple(v) for k, v in names.items()}
        return self

    def include(self, other: Rules | str, only: Iterable[str] | None = None, exclude: Iterable[str] = ()) -> Rules:
        other = find(other)
        self.rules += [r for r in other.rules if (only is None or r[0] in set(only)) and r[0] not in set(exclude)]
        return self

    def _expand(self, c: Any) -> Any:
        if isinstance(c, str) and c in self.aliases:
            return self.aliases[c]
        if isinstance(c, dict):
            out: list = []
            for k, v in c.items():
                for name in self.groups.get(k, (k,)):
                    out.append(self.aliases[name] if name in self.aliases and v is True else ("not", self.aliases[name]) if name in self.aliases and v is False else {name: v})
            return out[0] if len(out) == 1 else ("all", out)
        if isinstance(c, list):
            return [self._expand(x) for x in c]
        if isinstance(c, tuple) and c and c[0] in ("not", "all"):
            return (c[0], self._expand(c[1]) if c[0] == "not" else [self._expand(x) for x in c[1]])
        return c

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(r[0] for r in self.rules))


def find(rules: Rules | str) -> Rules:
    if isinstance(rules, Rules):
        return rules
    if rules not in _registry:
        raise RulesNotFoundError(rules)
    return _registry[rules]


class Inference:
    """Evaluate rules for a scope. extra rules come before the entity's own; args are plain values."""

    def __init__(self, catalog: Catalog, *rules: Rules | str, args: dict[str, Any] | None = None, extra: Sequence[Rules | str] = ()):
        self.catalog, self.args = catalog, args or {}
        self.by: dict[str, dict[str, list[tuple[Any, Any]]]] = {}
        self._open: list[tuple[str, str]] = []
        for r in [*map(find, extra), *map(find, rules)]:
            for key, when, value in r.rules:
                self.by.setdefault(r.entity, {}).setdefault(key, []).append((when, value))
        self.derived = {e: {k: (lambda row, e=e, k=k: self.predicate(e, k, row)) for k in keys} for e, keys in self.by.items()}

    # -- verbs ---------------------------------------------------------------------------------------------------

    def scope(self, source: str | Scope) -> Scope:
        s = self.catalog.scope(source) if isinstance(source, str) else source
        return s._with(s.ctx.copy(derived=self.derived, one_join="left"))

    def load(self, source: str | Scope, *names: str, **values: Any) -> DataFrame:
        """The key, the predicates named, and values by name, of each row."""
        s = self.scope(source)
        row = Ref(s.var)
        key = {k: Ref(s.var, ("fields", k)) for k in self.catalog.entities[s.entity].key}
        columns = {n: self.value(s.entity, ("ref", [n]), row, {}) for n in names} | {n: self.value(s.entity, v, row, {}) for n, v in values.items()}
        return s.map(**key, **columns)

    def put(self, source: str | Scope, *names: str) -> DataFrame:
        """All columns and the struct ``inferred`` of the predicates."""
        s = self.scope(source)
        row = Ref(s.var)
        return s.with_columns(inferred=Struct({n: self.value(s.entity, ("ref", [n]), row, {}) for n in names}))

    def select(self, source: str | Scope, values: Any) -> DataFrame:
        """A dict of values by name, as columns; or one value (a predicate's name, a path, any value) as ``value``."""
        s = self.scope(source)
        row = Ref(s.var)
        named = values if isinstance(values, dict) else {"value": ("ref", [values]) if isinstance(values, str) else values}
        return s.map(**{n: self.value(s.entity, ("ref", [v]) if isinstance(v, str) else v, row, {}) for n, v in named.items()})

    def filter(self, source: str | Scope, condition: Any) -> Scope:
        s = self.scope(source)
        return s if condition is True else s.filter(self.condition(s.entity, condition, Ref(s.var), {}))

    query_all = filter

    def reject(self, source: str | Scope, condition: Any) -> Scope:
        s = self.scope(source)
        return s.reject(self.condition(s.entity, condition, Ref(s.var), {}))

    def query_one(self, source: str | Scope, condition: Any) -> DataFrame:
        return self.filter(source, condition).one()

    # -- predicates ----------------------------------------------------------------------------------------------

    def predicate(self, entity: str, name: str, row: Ref) -> Expr:
        if (entity, name) in self._open:
            raise TranslationError(f"{entity}.{name} refers to itself: {' -> '.join(n for _, n in self._open)} -> {name}")
        self._open.append((entity, name))
        try:
            branches = []
            for when, value in self.by[entity][name]:
                binds: dict[str, Expr] = {}
                cond = self.condition(entity, when, row, binds) if when is not None else Lit(True)
                branches.append((truthy(cond), self.value(entity, value, row, binds)))
            return Case(branches, Lit(None), False)
        finally:
            self._open.pop()

    def field(self, entity: str, row: Ref, name: str) -> Expr:
        # predicates unfold here, not in the lowering, so that circles are found
        if name in self.by.get(entity, {}):
            return self.predicate(entity, name, row)
        return row[name]

    # -- conditions ----------------------------------------------------------------------------------------------

    def condition(self, entity: str, c: Any, row: Ref, binds: dict[str, Expr]) -> Expr:
        """A condition on the row itself."""
        if c is None or c is True:
            return Lit(True)
        if isinstance(c, (bool, Expr)):
            return wrap(c)
        if isinstance(c, str):
            return Op("==", self.field(entity, row, c), Lit(True))
        if isinstance(c, list):
            return self._any([self.condition(entity, x, row, binds) for x in c])
        if isinstance(c, dict):
            return conj([self.key(entity, k, v, row, binds) for k, v in c.items()])
        op, *rest = c
        if op == "not":
            return Op("not", self.condition(entity, rest[0], row, binds))
        if op == "all":
            return conj([self.condition(entity, x, row, binds) for x in rest[0]])
        if op == "args":
            return Lit(self.plain(rest[0], self.args))
        if op == "fields":
            return self.condition(entity, rest[0], row["fields"], binds)
        if op == "bind":
            binds.setdefault(rest[0], row)
            return self.condition(entity, rest[1], row, binds) if len(rest) > 1 else Lit(True)
        if op == "call":
            return truthy(self.value(entity, c, row, binds))
        raise TranslationError(f"no condition: {c!r}")

    def key(self, entity: str, k: Any, v: Any, row: Ref, binds: dict[str, Expr]) -> Expr:
        if k == "args":
            return Lit(self.plain(v, self.args))
        if k == "fields":
            return conj([self.test(entity, row["fields"][n], x, row, binds) for n, x in v.items()])
        if isinstance(k, tuple) and k[0] == "ref":
            return self.test(entity, self.value(entity, k, row, binds), v, row, binds)
        assoc = self.catalog.assoc(entity, k)
        if assoc is None or k in self.by.get(entity, {}):
            return self.test(entity, self.field(entity, row, k), v, row, binds)
        if assoc.kind in ("one", "has_one"):
            if v is None or (isinstance(v, tuple) and v and v[0] == "not" and v[1] is None):
                missing = row[k].is_nil()
                return missing if v is None else Op("not", missing)
            return self.condition(assoc.target, v, row[k], binds) if isinstance(v, (dict, list, tuple, str)) else row[k] == v
        many = Many(row[k])
        if isinstance(v, tuple) and v and v[0] == "all?":
            return many.all(lambda r: self.condition(assoc.target, v[1], r, {}))
        if isinstance(v, tuple) and v and v[0] == "not":
            return Op("not", many.any(lambda r: self.condition(assoc.target, v[1], r, {})))
        if isinstance(v, tuple) and v and v[0] == "bind":
            inner = v[2] if len(v) > 2 else True
            rows = Collected(row[k], (lambda r: self.condition(assoc.target, inner, r, {}),), lambda r: r)
            binds.setdefault(v[1], Native(lambda a: F.get(a, F.lit(0)), rows))
            return many.any(lambda r: self.condition(assoc.target, inner, r, {}))
        return many.any(lambda r: self.condition(assoc.target, v, r, {}))

    def test(self, entity: str, x: Expr, v: Any, row: Ref, binds: dict[str, Expr]) -> Expr:
        """A condition on a value."""
        if isinstance(v, list):
            plain = [y for y in v if not isinstance(y, (tuple, list, dict))]
            some = [x.is_in(*plain)] if plain else []
            return self._any(some + [self.test(entity, x, y, row, binds) for y in v if isinstance(y, (tuple, list, dict))])
        if isinstance(v, dict):
            return conj([self.test(entity, Native(lambda s, k=k: s[k], x), y, row, binds) for k, y in v.items()])
        if isinstance(v, tuple):
            op, *rest = v
            if op == "not":
                return Op("not", self.test(entity, x, rest[0], row, binds))
            if op == "all":
                return conj([self.test(entity, x, y, row, binds) for y in rest[0]])
            if op == "bind":
                binds.setdefault(rest[0], x)
                return self.test(entity, x, rest[1], row, binds) if len(rest) > 1 else Lit(True)
            if op in _operator:
                return Op(_operator[op], x, self.value(entity, rest[0], row, binds))
            if op in ("ref", "call", "bound"):
                return Op("==", x, self.value(entity, v, row, binds))
            raise TranslationError(f"no condition: {v!r}")
        return Op("==", x, wrap(v))  # an expression or a literal

    @staticmethod
    def _any(parts: list[Expr]) -> Expr:
        if not parts:
            return Lit(False)
        out = truthy(parts[0])
        for p in parts[1:]:
            out = Op("or", out, truthy(p))
        return out

    def plain(self, c: Any, given: Any) -> bool:
        """A condition on the arguments, decided here."""
        if isinstance(c, dict):
            return all(self.plain(v, given.get(k) if isinstance(given, dict) else getattr(given, k, None)) for k, v in c.items())
        if isinstance(c, list):
            return any(self.plain(x, given) for x in c)
        if isinstance(c, tuple):
            op, *rest = c
            if op == "not":
                return not self.plain(rest[0], given)
            if op == "all":
                return all(self.plain(x, given) for x in rest[0])
            if op in _operator:
                return given is not None and {"<": given < rest[0], "<=": given <= rest[0], ">": given > rest[0], ">=": given >= rest[0]}[_operator[op]]
        return given == c

    # -- values --------------------------------------------------------------------------------------------------

    def value(self, entity: str, v: Any, row: Ref, binds: dict[str, Expr]) -> Expr:
        if isinstance(v, dict):
            return Struct({k: self.value(entity, x, row, binds) for k, x in v.items()})
        if isinstance(v, list):
            return wrap([self.value(entity, x, row, binds) for x in v])
        if not isinstance(v, tuple):
            return wrap(v)
        op, *rest = v
        if op == "ref":
            return self.ref(entity, rest[0] if isinstance(rest[0], (list, tuple)) else [rest[0]], row)
        if op == "call":
            return call(rest[0], *(self.value(entity, x, row, binds) for x in rest[1:]))
        if op == "bound":
            if rest[0] in binds:
                bound = binds[rest[0]]
                for name in rest[1] if len(rest) > 1 and isinstance(rest[1], list) else ():
                    bound = bound[name] if isinstance(bound, Ref) else Native(lambda s, n=name: s[n], bound)
                return bound
            if len(rest) > 1 and not isinstance(rest[-1], list):
                return wrap(rest[-1])
            raise TranslationError(f"nothing is bound to {rest[0]}")
        if op in ("map", "filter", "count", "count_while"):
            many, target = self.many(entity, rest[0], row)
            if op == "map":
                cond, mapper = (rest[1], rest[2]) if len(rest) > 2 else (True, rest[1])
                if isinstance(cond, tuple) and cond and cond[0] == "bind":  # the element, by name
                    return Collected(many, (lambda r: self.condition(target, cond[2] if len(cond) > 2 else True, r, {}),), lambda r: self.value(entity, mapper, row, {**binds, cond[1]: r}))
                return Collected(many, (lambda r: self.condition(target, cond, r, {}),), lambda r: self.mapped(target, mapper, r))
            if op == "filter":
                return Collected(many, (lambda r: self.condition(target, rest[1], r, {}),), lambda r: r)
            if op == "count":
                return Many(many).count(lambda r: self.condition(target, rest[1], r, {}))
            flags = Collected(many, (), lambda r: Op("or", self.condition(target, rest[1], r, {}), Lit(False)) if len(rest) < 3 else Case([(self.condition(target, rest[2], r, {}), Lit(None))], self.condition(target, rest[1], r, {}), False))
            return Native(lambda a: arr.count_while(a, lambda x: x), flags)
        if op in ("first", "lookup", "one"):
            return self.lookup(entity, op, rest, row, binds)
        raise TranslationError(f"no value: {v!r}")

    def mapped(self, entity: str, mapper: Any, row: Ref) -> Expr:
        if callable(mapper):
            return wrap(mapper(row))
        return self.ref(entity, [mapper], row) if isinstance(mapper, str) else self.value(entity, mapper, row, {})

    def many(self, entity: str, path: Any, row: Ref) -> tuple[Ref, str]:
        path = path[1] if isinstance(path, tuple) and path[0] == "ref" else path
        path = [path] if isinstance(path, str) else list(path)
        for name in path[:-1]:
            row, entity = row[name], self.catalog.assoc(entity, name).target
        return row[path[-1]], self.catalog.assoc(entity, path[-1]).target

    def ref(self, entity: str, path: Sequence[Any], row: Ref) -> Expr:
        """A path: through associations (lists of values where one has many rows), predicates, a final dict or list of
        branches, "args" for the arguments, "fields" for stored values."""
        name, *rest = path
        if name == "args":
            given: Any = self.args
            for n in rest:
                given = given.get(n) if isinstance(given, dict) else getattr(given, n, None)
            return wrap(given)
        if isinstance(name, dict):
            return Struct({k: self.ref(entity, p if isinstance(p, (list, tuple)) else [p], row) for k, p in name.items()})
        if isinstance(name, (list, tuple)):
            return Struct({k: self.ref(entity, [k], row) for k in name})
        if name == "fields":
            return Ref(row.var, (*row.path, "fields", *rest))
        assoc = self.catalog.assoc(entity, name)
        if name in self.by.get(entity, {}):
            out = self.predicate(entity, name, row)
            for n in rest:
                out = Native(lambda s, n=n: s[n], out)
            return out
        if assoc is None or not rest:
            out = row[name]
            for n in rest:
                out = out[n]
            return out
        if assoc.kind in ("one", "has_one"):
            return self.ref(assoc.target, rest, row[name])
        return Collected(row[name], (), lambda r: self.ref(assoc.target, rest, r))

    def lookup(self, entity: str, op: str, rest: list, row: Ref, binds: dict[str, Expr]) -> Expr:
        """("first" | "lookup" | "one", target, {field: value}[, {"order_by": order, "limit": n}]): rows of another entity
        by values of this row; order as in order_keys, missing keys last, ties in key order."""
        target, conds, *more = rest
        options = more[0] if more else {}

        def matches(r: Ref) -> Expr:
            return conj([self.test(entity, r[k], self._outer(entity, v, row, binds), row, binds) for k, v in conds.items()])

        limit = {"first": 1, "one": 2}.get(op, options.get("limit"))
        rows = Collected(self.catalog.scope(target), (matches,), lambda r: r, order_keys(options.get("order_by")), limit)

        def pick(a):
            if op == "lookup":
                return a
            if op == "one":
                return F.when(F.size(a) > 1, F.raise_error(F.lit("several rows match a lookup of one"))).otherwise(F.get(a, F.lit(0)))
            return F.get(a, F.lit(0))

        return Native(pick, rows)

    def _outer(self, entity: str, v: Any, row: Ref, binds: dict[str, Expr]) -> Any:
        if isinstance(v, tuple) and v and v[0] in _operator:
            return (v[0], self.value(entity, v[1], row, binds))
        if isinstance(v, list):
            return [self._outer(entity, x, row, binds) for x in v]
        return self.value(entity, v, row, binds) if isinstance(v, tuple) and v[0] in ("ref", "call", "bound") else v
