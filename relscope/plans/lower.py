"""Lowering: expressions become columns, paths become joins (one for each distinct path), quantifiers become semi, anti
or grouped joins.

Quantifiers are never nested subqueries: rows of the outer frame are carried into the child frame where a condition
needs them, so a condition may refer to any enclosing row.
"""

from __future__ import annotations

import itertools
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotLoadedError, TranslationError, UnknownFieldError
from ..sources.catalog import Assoc, Catalog
from .expr import Array, Case, Collected, Expr, Lit, Native, Op, Opaque, Quantified, Ref, Scalar, Struct, Truthy, conjuncts, opaque_in, parts, refs, truthy

_names = itertools.count(1)


def fresh(stem: str) -> str:
    return f"__{stem}{next(_names)}_"


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns)) if prefix else df


@dataclass
class Context:
    """A frame, the rows that stand in it (variable -> entity and prefix of its columns), and paths joined so far."""

    catalog: Catalog
    df: DataFrame
    rows: dict[int, tuple[str, str]]
    joined: dict[tuple[int, tuple[str, ...]], tuple[str, str]] = field(default_factory=dict)
    one_join: str = "inner"
    may_join: bool = True
    derived: dict[str, dict[str, object]] = field(default_factory=dict)  # entity -> name -> function of a row
    missing: set[str] = field(default_factory=set)

    def copy(self, **changes) -> Context:
        return replace(self, rows=dict(self.rows), joined=dict(self.joined), **changes)

    # -- paths ---------------------------------------------------------------------------------------------------

    def at(self, var: int, path: tuple[str, ...]) -> tuple[str, str]:
        """Entity and prefix at the end of a path of :one associations, joined where needed."""
        if not path:
            return self.rows[var]
        if (var, path) in self.joined:
            return self.joined[var, path]
        entity, prefix = self.at(var, path[:-1])
        assoc = self.catalog.assoc(entity, path[-1])
        if assoc is None:
            self.catalog.check(entity, path[-1])
            raise UnknownFieldError(f"{entity}.{path[-1]} is a field, not an association")
        if assoc.kind not in ("one", "has_one"):
            raise UnknownFieldError(f"{entity}.{path[-1]} has many rows; use any, all, count or map")
        if not self.may_join:
            self.missing.add(".".join(path))
        new = fresh(path[-1])
        target = prefixed(self.catalog.frame(assoc.target), new)
        how = "left" if assoc.kind == "has_one" else self.one_join
        self.df = self.df.join(target, F.col(prefix + assoc.owner_key) == F.col(new + assoc.related_key), how)
        self.joined[var, path] = (assoc.target, new)
        return self.joined[var, path]

    def column(self, ref: Ref) -> Column:
        if not ref.path:
            entity, prefix = self.rows[ref.var]
            return F.struct(*(F.col(f"`{prefix}{c}`").alias(c) for c in self.catalog.fields(entity)))
        path, name = ref.path[:-1], ref.path[-1]
        if path and path[-1] == "fields":  # the stored value, where a derived one has the same name
            path = path[:-1]
            entity, prefix = self.at(ref.var, path)
            return F.col(f"`{prefix}{name}`")
        for k in range(len(path)):  # a field of a struct column
            entity, _ = self.at(ref.var, path[:k])
            if path[k] in self.catalog.fields(entity) and not self.catalog.assoc(entity, path[k]):
                col = self.column(Ref(ref.var, path[: k + 1]))
                for n in ref.path[k + 1 :]:
                    col = col.getField(n)
                return col
        entity, prefix = self.at(ref.var, path)
        rule = self.derived.get(entity, {}).get(name)
        if rule is not None:
            return self.value(rule(Ref(ref.var, path)))
        if name in self.catalog.fields(entity):
            return F.col(f"`{prefix}{name}`")
        assoc = self.catalog.assoc(entity, name)
        self.catalog.check(entity, name)
        if assoc.kind in ("one", "has_one"):
            target, new = self.at(ref.var, ref.path)
            there = F.col(new + assoc.related_key).isNotNull()
            return F.when(there, F.struct(*(F.col(f"`{new}{c}`").alias(c) for c in self.catalog.fields(target))))
        return self.value(Collected(ref, (), lambda r: r))

    def one_assoc(self, e: Expr) -> tuple[Assoc, str, str] | None:
        """The association that a reference ends in, with its owner's prefix and entity."""
        if not isinstance(e, Ref) or not e.path:
            return None
        try:
            entity, prefix = self.at(e.var, e.path[:-1])
        except UnknownFieldError:
            return None
        assoc = self.catalog.assoc(entity, e.path[-1])
        return (assoc, prefix, entity) if assoc and assoc.kind in ("one", "has_one") else None

    # -- values --------------------------------------------------------------------------------------------------

    def value(self, e: Expr) -> Column:
        if isinstance(e, Lit):
            return F.lit(e.value)
        if isinstance(e, Ref):
            return self.column(e)
        if isinstance(e, Struct):
            return F.struct(*(self.value(v).alias(n) for n, v in zip(e.names, e.args, strict=True)))
        if isinstance(e, Array):
            return F.array(*map(self.value, e.args))
        if isinstance(e, Native):
            return e.fn(*map(self.value, e.args))
        if isinstance(e, Opaque):
            warnings.warn(f"{getattr(e.fn, '__name__', e.fn)} is a plain Python function: it runs row by row", stacklevel=2)
            return F.udf(e.fn, e.returns, useArrow=True)(*map(self.value, e.args))
        if isinstance(e, Case):
            out = None
            for c, v in e.branches:
                cond, val = self.condition(c), self.value(v)
                out = F.when(cond, val) if out is None else out.when(cond, val)
            if e.strict:
                return out.otherwise(F.raise_error(F.lit("no branch matches")))
            rest = self.value(e.default)
            return rest if out is None else out.otherwise(rest)
        if isinstance(e, Scalar):
            name = fresh("scalar")
            self.df = self.df.crossJoin(F.broadcast(e.frame.toDF(name)))  # an aggregate: one row
            return F.col(name)
        if isinstance(e, Quantified):
            return self.quantified(e)
        if isinstance(e, Collected):
            return self.collected(e)
        if isinstance(e, Truthy):
            return self.condition(e)
        if isinstance(e, Op):
            if e.name in ("and", "or", "not", "==", "in", "<", "<=", ">", ">="):
                return self.condition(e)
            a, b = map(self.value, e.args)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[e.name]()
        raise TranslationError(f"no column form of {type(e).__name__}")

    # -- conditions ----------------------------------------------------------------------------------------------

    def condition(self, e: Expr) -> Column:
        if isinstance(e, Lit):
            return F.lit(bool(e.value) if e.value is not None else False)
        if isinstance(e, Truthy):
            return self.truth(e.args[0])
        if isinstance(e, Quantified):
            return self.quantified(e)
        if not isinstance(e, Op):
            return self.truth(e)
        if e.name == "and":
            return self.condition(truthy(e.args[0])) & self.condition(truthy(e.args[1]))
        if e.name == "or":
            return self.condition(truthy(e.args[0])) | self.condition(truthy(e.args[1]))
        if e.name == "not":
            return ~self.condition(truthy(e.args[0]))
        if e.name == "in":
            for x in e.args[1:]:
                self.check_enum(e.args[0], x)
            return self.value(e.args[0]).isin(*(x.value if isinstance(x, Lit) else self.value(x) for x in e.args[1:]))
        if e.name == "==":
            return self.equal(*e.args)
        if e.name in ("<", "<=", ">", ">="):
            a, b = map(self.value, e.args)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.name]
        return self.truth(e)

    def truth(self, e: Expr) -> Column:
        found = self.one_assoc(e)
        if found:
            assoc, prefix, _ = found
            if assoc.kind == "one":
                return F.col(prefix + assoc.owner_key).isNotNull()
            return self.column(e).isNotNull()
        col = self.value(e)
        kind = self.df.select(col.alias("x")).dtypes[0][1]
        return col == F.lit(True) if kind == "boolean" else F.lit(False) if kind == "void" else col.isNotNull()

    def equal(self, a: Expr, b: Expr) -> Column:
        if isinstance(a, Lit) and not isinstance(b, Lit):
            a, b = b, a
        found = self.one_assoc(a)
        if found and isinstance(b, (Lit, Struct)):
            assoc, prefix, _ = found
            if isinstance(b, Lit) and b.value is None:
                return ~self.truth(a)
            given = dict(zip(b.names, b.args, strict=True))[assoc.related_key] if isinstance(b, Struct) else b
            given = getattr(given.value, assoc.related_key, given.value) if isinstance(given, Lit) else self.value(given)
            if assoc.kind == "one":
                return F.col(prefix + assoc.owner_key) == given
            return self.column(a)[assoc.related_key] == given
        if isinstance(b, Lit) and b.value is None:
            return self.value(a).isNull()
        self.check_enum(a, b)
        return self.value(a) == self.value(b)

    def check_enum(self, a: Expr, b: Expr) -> None:
        if isinstance(a, Ref) and isinstance(b, Lit) and a.path:
            entity, _ = self.at(a.var, tuple(p for p in a.path[:-1] if p != "fields"))
            allowed = self.catalog.entities[entity].enums.get(a.path[-1])
            if allowed is not None and b.value not in allowed:
                raise ValueError(f"{b.value!r} is no value of {entity}.{a.path[-1]}: {', '.join(allowed)}")

    # -- has_many ------------------------------------------------------------------------------------------------

    def children(self, source, var: int) -> tuple[DataFrame, str, str, str | None, str | None]:
        """Child frame, its entity and prefix, the owner's column and the child's column that link them (or None)."""
        prefix = fresh("row")
        if not isinstance(source, Ref):
            return prefixed(source.df, prefix), source.entity, prefix, None, None
        entity, own = self.at(source.var, source.path[:-1])
        self.catalog.check(entity, source.path[-1])
        if not self.may_join:
            self.missing.add(".".join(source.path))
        assoc = self.catalog.assoc(entity, source.path[-1])
        if assoc is None:
            raise UnknownFieldError(f"{entity}.{source.path[-1]} is no association")
        df, link = related(self.catalog, entity, assoc)
        if assoc.kind in ("through", "m2m"):
            owner = self.catalog.entities[entity].key[0] if assoc.kind == "through" else assoc.owner_key
        else:
            owner = assoc.owner_key
        child = df.select(F.col(link).alias(prefix + "__link"), *(F.col(f"`{c}`").alias(prefix + c) for c in self.catalog.fields(assoc.target)))
        return child, assoc.target, prefix, own + owner, prefix + "__link"

    def key(self) -> list[str]:
        return [prefix + k for entity, prefix in self.rows.values() for k in self.catalog.entities[entity].key]

    def outer(self, e, var: int) -> bool:
        """Whether the row function refers to rows outside it."""
        inside = {var} | {x.var for x in parts(e) if isinstance(x, (Quantified, Collected))}
        return any(r.var not in inside for r in refs(e))

    def inner(self, child: DataFrame, entity: str, prefix: str, var: int) -> Context:
        return replace(self, df=child, rows={var: (entity, prefix)}, joined={})

    def beside(self, child: DataFrame, entity: str, prefix: str, var: int, owner: str | None, link: str | None, pred: Expr, once: bool = False) -> tuple[Context, list[Expr]]:
        """This frame joined with the child's rows: on the link, and on those conditions that need no further joins.
        once: rows of this frame that repeat a key count as one."""
        both = self.copy(df=self.df.dropDuplicates(self.key()) if once else self.df)
        both.rows[var] = (entity, prefix)
        on, rest = [], []
        for c in conjuncts(pred):
            plain = not any(isinstance(x, (Quantified, Collected, Scalar, Opaque)) for x in parts(c)) and all(both.plain(r) for r in refs(c))
            (on if plain else rest).append(c)
        cond = F.col(owner) == F.col(link) if owner else F.lit(True)
        for c in on:
            cond = cond & both.condition(c)
        if not owner and not any(isinstance(c, Op) and c.name == "==" for c in on):
            warnings.warn("no equality links these rows: all pairs are compared", stacklevel=2)
        both.df = both.df.join(child, cond, "inner")
        return both, rest

    def plain(self, r: Ref) -> bool:
        """A field that stands in the frame already."""
        path = r.path[:-1]
        return bool(r.path) and r.var in self.rows and (not path or (r.var, path) in self.joined) and r.path[-1] in self.catalog.fields(self.at(r.var, path)[0]) and r.path[-1] not in self.derived.get(self.at(r.var, path)[0], {})

    def quantified(self, q: Quantified) -> Column:
        child, entity, prefix, owner, link = self.children(q.source, q.var)
        n = fresh("n")
        if not self.outer(q.pred, q.var):
            inside = self.inner(child, entity, prefix, q.var)
            cond = inside.condition(q.pred)
            held = inside.df.where(cond)
            if owner is None:
                one = held.agg(F.count(F.lit(1)).alias(n))
                self.df = self.df.crossJoin(F.broadcast(one))
            else:
                held = held.groupBy(F.col(link).alias(n + "key")).agg(F.count(F.lit(1)).alias(n))
                self.df = self.df.join(held, F.col(owner) == F.col(n + "key"), "left")
        else:
            both, rest = self.beside(child, entity, prefix, q.var, owner, link, q.pred, once=q.kind == "count")
            cond = F.lit(True)
            for c in rest:
                cond = cond & both.condition(c)
            keys = self.key()
            held = both.df.where(cond).groupBy(*(F.col(k).alias(n + k) for k in keys)).agg(F.count(F.lit(1)).alias(n))
            on = F.lit(True)
            for k in keys:
                on = on & (F.col(k) == F.col(n + k))
            self.df = self.df.join(held, on, "left")
        count = F.coalesce(F.col(n), F.lit(0))
        return count if q.kind == "count" else count > 0

    def collected(self, c: Collected) -> Column:
        child, entity, prefix, owner, link = self.children(c.source, c.var)
        name = fresh("list")
        names = [prefix + k for k in self.catalog.entities[entity].order]
        if self.outer(c.pred, c.var) or self.outer(c.value, c.var) or owner is None:
            both, rest = self.beside(child, entity, prefix, c.var, owner, link, c.pred, once=True)
            keys = self.key()
        else:
            both, rest = self.inner(child, entity, prefix, c.var), list(conjuncts(c.pred))
            keys = [link]
        cond = F.lit(True)
        for x in rest:
            cond = cond & both.condition(x)
        value = both.value(c.value)
        rank = name + "rank"
        sort = [(key.desc_nulls_last if desc else key.asc_nulls_last)() for key, desc in ((both.value(k), desc) for k, desc in c.order)]
        held = both.df.where(cond)
        if c.order or c.limit is not None:  # with a limit, each key's rows are cut while they are sorted
            held = held.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort, *(F.asc_nulls_last(n) for n in names))))
            held = held if c.limit is None else held.where(F.col(rank) <= c.limit)
            place = F.col(rank)
        else:
            place = F.struct(*(x for n in names for x in (F.col(n).isNull().alias(n + "missing"), F.col(n))))
        held = held.groupBy(*(F.col(k).alias(name + k) for k in keys)).agg(F.sort_array(F.collect_list(F.struct(place.alias("__at"), value.alias("__v")))).alias(name))
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(owner if k == link else k) == F.col(name + k))
        self.df = self.df.join(held, on, "left")
        return F.coalesce(F.transform(F.col(name), lambda x: x["__v"]), F.array().cast(held.select(F.transform(name, lambda x: x["__v"]).alias("x")).schema["x"].dataType))

    # -- top-level filters ---------------------------------------------------------------------------------------

    def where(self, e: Expr, native_only: bool = False) -> Context:
        """Keep the rows for which e holds. Conjuncts go one by one: quantifiers as semi or anti joins, native ones
        before those that call Python."""
        out = self.copy()
        todo = list(conjuncts(truthy(e)))
        if native_only and any(map(opaque_in, todo)):
            raise TranslationError("the condition calls a plain Python function")
        for c in sorted(todo, key=opaque_in):
            negated = isinstance(c, Op) and c.name == "not"
            q = c.args[0] if negated else c
            if isinstance(q, Quantified) and q.kind == "any":
                out.semi(q, "left_anti" if negated else "left_semi")
            else:
                cond = out.condition(c)
                out.df = out.df.where(cond)
        if out.missing:
            raise NotLoadedError(out.missing)
        return out

    def semi(self, q: Quantified, how: str) -> None:
        child, entity, prefix, owner, link = self.children(q.source, q.var)
        if not self.outer(q.pred, q.var):
            inside = self.inner(child, entity, prefix, q.var)
            cond = inside.condition(q.pred)
            held = inside.df.where(cond)
            if owner is None:
                held = held.limit(1)
            self.df = self.df.join(held, F.col(owner) == F.col(link) if owner else F.lit(True), how)
            return
        both = self.copy()
        both.rows[q.var] = (entity, prefix)
        if all(both.plain(r) for r in refs(q.pred)) and not any(isinstance(x, (Quantified, Collected, Scalar, Opaque)) for x in parts(q.pred)):
            cond = both.condition(q.pred)
            self.df = self.df.join(child, (F.col(owner) == F.col(link)) & cond if owner else cond, how)
            return
        flag = self.quantified(q)
        self.df = self.df.where(~flag if how == "left_anti" else flag)


def related(catalog: Catalog, entity: str, assoc: Assoc) -> tuple[DataFrame, str]:
    """The rows of an association with the owner's key beside them: (frame, name of that key)."""
    target = catalog.frame(assoc.target)
    link = fresh("owner")
    if assoc.kind == "m2m":
        table, own, other = assoc.via
        pairs = catalog.frame(table).select(F.col(own).alias(link), F.col(other).alias(link + "to")).distinct()
        return pairs.join(target, F.col(link + "to") == F.col(assoc.related_key)).drop(link + "to"), link
    if assoc.kind == "through":
        key = catalog.entities[entity].key[0]
        df = catalog.frame(entity).select(F.col(key).alias(link), *catalog.fields(entity))
        at, many = entity, 0
        for step in assoc.via:
            a = catalog.assoc(at, step)
            new = fresh("via")
            many += a.kind == "many"
            nxt = prefixed(catalog.frame(a.target), new)
            df = df.join(nxt, F.col(a.owner_key) == F.col(new + a.related_key)).select(link, *(F.col(new + c).alias(c) for c in catalog.fields(a.target)))
            at = a.target
        return df.dropDuplicates([link, *catalog.entities[at].key]), link
    return target.withColumn(link, F.col(assoc.related_key)), link
