"""Scopes: lazy collections of an entity's rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyError, MultipleResultsError
from ..operators import seq
from ..sources.catalog import Catalog
from .expr import Expr, Op, Quantified, Ref, Scalar, Struct, conj, new_var, truthy, wrap
from .lower import Context


class Scope:
    """Rows of an entity, filtered and ordered by expressions. Nothing runs until the frame does."""

    def __init__(self, catalog: Catalog, entity: str, ctx: Context, var: int, order: Sequence[str] = ()):
        self.catalog, self.entity, self.ctx, self.var = catalog, entity, ctx, var
        self.order = tuple(order) or catalog.entities[entity].order

    @classmethod
    def of(cls, catalog: Catalog, entity: str) -> Scope:
        var = new_var()
        df = catalog.frame(entity)
        return cls(catalog, entity, Context(catalog, df, {var: (entity, "")}, one_join=catalog.one_join), var)

    @property
    def df(self) -> DataFrame:
        return self.ctx.df.select(*(F.col(f"`{c}`") for c in self.catalog.fields(self.entity)))

    def _with(self, ctx: Context) -> Scope:
        return Scope(self.catalog, self.entity, ctx, self.var, self.order)

    def row(self, fn: Any) -> Expr:
        """The expression of a row function, of a dict of conditions, or a constant."""
        if isinstance(fn, dict):
            return conj([Op("==", Ref(self.var, (k,)), wrap(v)) if not isinstance(v, (list, tuple)) else Ref(self.var, (k,)).is_in(*v) for k, v in fn.items()])
        return wrap(fn(Ref(self.var)) if callable(fn) and not isinstance(fn, Expr) else fn)

    # -- filters -------------------------------------------------------------------------------------------------

    def filter(self, fn: Any) -> Scope:
        return self._with(self.ctx.where(self.row(fn)))

    where = filter

    def reject(self, fn: Any) -> Scope:
        """Rows for which the condition does not hold; where it is unknown, a row stays."""
        ctx = self.ctx.copy()
        cond = ctx.condition(truthy(self.row(fn)))
        ctx.df = ctx.df.where(~F.coalesce(cond, F.lit(False)))
        return self._with(ctx)

    def partition(self, fn: Any) -> tuple[Scope, Scope]:
        return self.filter(fn), self.reject(fn)

    split_with = partition

    def pushed(self, fn: Any) -> Scope:
        """filter, but an error if a part has no native form."""
        return self._with(self.ctx.where(self.row(fn), native_only=True))

    def loaded_only(self, fn: Any) -> Scope:
        """filter, but an error that lists the associations it would join."""
        ctx = self.ctx.copy(may_join=False, missing=set())
        return self._with(ctx.where(self.row(fn)))

    # -- single rows and numbers ---------------------------------------------------------------------------------

    def find(self, fn: Any | None = None, default: dict | None = None) -> DataFrame:
        """The first row, in key order, for which fn holds: a frame of one row, of none, or of the default."""
        found = seq.take((self.filter(fn) if fn is not None else self).df, 1, self.order)
        if default is None:
            return found
        spare = self.catalog.spark.createDataFrame([tuple(default.get(c) for c in found.columns)], found.schema)
        return found.withColumn("__n", F.lit(0)).union(spare.withColumn("__n", F.lit(1))).orderBy("__n").limit(1).drop("__n")

    def one(self, fn: Any | None = None) -> DataFrame:
        """Exactly one row, or an error."""
        found = (self.filter(fn) if fn is not None else self).df.limit(2)
        n = found.count()
        if n == 0:
            raise EmptyError(f"no row of {self.entity}")
        if n > 1:
            raise MultipleResultsError(f"several rows of {self.entity}")
        return found

    def agg(self, **columns: Any) -> DataFrame:
        """Aggregates of values of rows: name=(function of a column, row function)."""
        ctx = self.ctx.copy()
        values = {n: f(ctx.value(self.row(v))) for n, (f, v) in columns.items()}
        return ctx.df.agg(*(c.alias(n) for n, c in values.items()))

    def count(self, fn: Any | None = None, name: str = "count") -> DataFrame:
        return (self.filter(fn) if fn is not None else self).df.agg(F.count(F.lit(1)).alias(name))

    def count_until(self, limit: int, fn: Any | None = None, name: str = "count") -> DataFrame:
        """The count, or limit if that is less: at most limit rows are counted."""
        return (self.filter(fn) if fn is not None else self).df.limit(limit).agg(F.count(F.lit(1)).alias(name))

    def any(self, fn: Any | None = None, name: str = "any") -> DataFrame:
        return (self.filter(fn) if fn is not None else self).df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))

    def all(self, fn: Any, name: str = "all") -> DataFrame:
        ctx = self.ctx.copy()
        cond = ctx.condition(truthy(self.row(fn)))
        return ctx.df.where(~F.coalesce(cond, F.lit(False))).limit(1).agg((F.count(F.lit(1)) == 0).alias(name))

    def total(self) -> Scalar:
        """The number of rows, as a value in row functions."""
        return Scalar(self.count())

    def scalar(self, f: Callable[[Column], Column], fn: Any) -> Scalar:
        """An aggregate of all rows, as a value in row functions."""
        return Scalar(self.agg(value=(f, fn)))

    def exists(self, fn: Callable) -> Quantified:
        """Whether a row of this scope satisfies fn, as a condition in another scope's row functions."""
        return Quantified("any", self, (fn,))

    # -- projection ----------------------------------------------------------------------------------------------

    def map(self, fn: Any | None = None, **columns: Any) -> DataFrame:
        """One row for each row: of the columns named, or of a row function's dict (or its value, as ``value``)."""
        ctx = self.ctx.copy(one_join="left")
        if fn is not None:
            e = self.row(fn)
            columns = dict(zip(e.names, e.args, strict=True)) if isinstance(e, Struct) else {"value": e}
        values = [ctx.value(self.row(v)).alias(n) for n, v in columns.items()]
        return ctx.df.select(*values)

    def with_columns(self, **columns: Any) -> DataFrame:
        ctx = self.ctx.copy(one_join="left")
        values = [ctx.value(self.row(v)).alias(n) for n, v in columns.items()]
        return ctx.df.select(*(c for c in self.catalog.fields(self.entity) if c not in columns), *values)

    def flat_map(self, fn: Any, name: str = "value") -> DataFrame:
        """The elements of each row's array."""
        return self.map(fn).select(F.explode("value").alias(name))

    # -- order ---------------------------------------------------------------------------------------------------

    def sort_by(self, fn: Any, desc: bool = False) -> DataFrame:
        """Stable: equal keys stay in key order; missing keys come last."""
        ctx = self.ctx.copy()
        key = ctx.value(self.row(fn))
        key = key.desc_nulls_last() if desc else key.asc_nulls_last()
        return ctx.df.orderBy(key, *(F.asc_nulls_last(c) for c in self.order)).select(*self.catalog.fields(self.entity))

    def take(self, n: int) -> DataFrame:
        return seq.take(self.df, n, self.order)

    # -- groups --------------------------------------------------------------------------------------------------

    def group_by(self, **keys: Any) -> Grouped:
        ctx = self.ctx.copy()
        values = {n: ctx.value(self.row(k)) for n, k in keys.items()}
        return Grouped(self, ctx, values)

    def frequencies_by(self, name: str = "count", **keys: Any) -> DataFrame:
        return self.group_by(**keys).agg(**{name: (lambda _: F.count(F.lit(1)), lambda r: 1)})

    # -- plans ---------------------------------------------------------------------------------------------------

    def to_sql(self) -> str:
        """Spark's plan of the scope."""
        return self.df._jdf.queryExecution().explainString(self.catalog.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class Grouped:
    def __init__(self, scope: Scope, ctx: Context, keys: dict[str, Column]):
        self.scope, self.ctx, self.keys = scope, ctx, keys

    def agg(self, **columns: Any) -> DataFrame:
        values = {n: f(self.ctx.value(self.scope.row(v))) for n, (f, v) in columns.items()}
        return self.ctx.df.groupBy(*(c.alias(n) for n, c in self.keys.items())).agg(*(c.alias(n) for n, c in values.items()))

    def to_lists(self, name: str, value: Any) -> DataFrame:
        """The values of each group in key order, as an array."""
        v = self.ctx.value(self.scope.row(value))
        return self.ctx.df.groupBy(*(c.alias(n) for n, c in self.keys.items())).agg(seq.values_in_order(v, self.scope.order).alias(name))
