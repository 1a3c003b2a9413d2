"""Keyed lookups: for all rows of a request frame at once, one plan whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(requests: DataFrame, rows: DataFrame, on: dict[str, str], where: Callable | None, null_keys: bool) -> tuple[DataFrame, list[str], Column]:
    """Row columns get the prefix r_; the condition: equal keys (null-safe if null_keys) and where(request, row)."""
    right = rows.select(*(F.col(c).alias("r_" + c) for c in rows.columns))
    cond = F.lit(True)
    for a, b in on.items():
        key = F.col("r_" + b)
        given = F.col(a).cast(rows.schema[b].dataType)
        cond = cond & (given.eqNullSafe(key) if null_keys else given == key)
    if where is not None:
        cond = cond & where(lambda c: F.col(c), lambda c: F.col("r_" + c))
    return right, ["r_" + c for c in rows.columns], cond


def query_all(requests: DataFrame, rows: DataFrame, on: dict[str, str], key: Sequence[str], order: Sequence, limit: int | None = None, offset: int = 0, where: Callable | None = None, null_keys: bool = False, keep_empty: bool = True) -> DataFrame:
    """Each request with its matching rows (prefix r_), in order; at most limit after offset for each request (rank).

    key identifies a request. order: names of row columns, or (name, "desc"); missing keys come last either way.
    Requests without rows stay with nulls.
    """
    right, names, cond = _joined(requests, rows, on, where, null_keys)
    found = requests.select(*dict.fromkeys([*key, *on, *requests.columns])).join(right, cond)
    keys = [o if isinstance(o, tuple) else (o, "asc") for o in order]
    columns = [F.desc_nulls_last("r_" + name) if way == "desc" else F.asc_nulls_last("r_" + name) for name, way in keys]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*columns)))
    if offset:
        found = found.where(F.col("rank") > offset)
    if limit is not None:
        found = found.where(F.col("rank") <= offset + limit)
    if not keep_empty:
        return found
    found = found.select(*(F.col(k).alias("__k" + k) for k in key), *names, "rank")
    back = F.lit(True)
    for k in key:
        back = back & F.col(k).eqNullSafe(F.col("__k" + k))
    return requests.join(found, back, "left").drop(*("__k" + k for k in key))


def query_first(requests: DataFrame, rows: DataFrame, on: dict[str, str], key: Sequence[str], order: Sequence, **options) -> DataFrame:
    return query_all(requests, rows, on, key, order, limit=1, **options).drop("rank")


def query_one(requests: DataFrame, rows: DataFrame, on: dict[str, str], key: Sequence[str], where: Callable | None = None, null_keys: bool = False) -> DataFrame:
    """Each request with its matching row; several matches are an error when the row is read."""
    right, names, cond = _joined(requests, rows, on, where, null_keys)
    found = requests.select(*key, *(c for c in requests.columns if c not in key)).join(right, cond)
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several rows match a lookup of one"))).otherwise(F.first(F.struct(*names)))
    held = found.groupBy(*(F.col(k).alias("__k" + k) for k in key)).agg(one.alias("__row"))
    back = F.lit(True)
    for k in key:
        back = back & F.col(k).eqNullSafe(F.col("__k" + k))
    return requests.join(held, back, "left").select(*requests.columns, "__row.*")


def count_by(requests: DataFrame, rows: DataFrame, on: dict[str, str], name: str = "count") -> DataFrame:
    """Each request with its number of matching rows, 0 without any. Only requested keys are counted."""
    keys = requests.select(*(F.col(a).alias(b) for a, b in on.items())).distinct()
    held = rows.join(keys, list(on.values()), "left_semi").groupBy(*(F.col(b).alias("__k" + a) for a, b in on.items())).agg(F.count(F.lit(1)).alias(name))
    cond = F.lit(True)
    for a in on:
        cond = cond & (F.col(a) == F.col("__k" + a))
    return requests.join(held, cond, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0))).drop(*("__k" + a for a in on))
