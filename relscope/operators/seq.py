"""Sequence operators on frames: rows in the order of the order columns, within each group of ``by`` or overall.

Order columns should make rows distinct. Without ``by``, the frame is sorted by ranges and written to the checkpoint
folder; what a range needs from those before it is one row for each range. No operator sorts a whole frame in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..errors import TranslationError
from . import arr

Cols = Sequence[str]
PART, POS, BITS = "__part", "__pos", 33


def _sorted(order: Cols, reverse: bool = False) -> list[Column]:
    """Sort columns: missing keys come last (reversed: first)."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    if reverse:
        return [k.desc_nulls_first() for k in keys]
    return [k.asc_nulls_last() if isinstance(c, str) else k for k, c in zip(keys, order, strict=True)]


def _key(order: Cols) -> Column:
    """One comparable value of the order columns, missing ones last."""
    return F.struct(*(x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"k{i}"))))


def values_in_order(value: Column, order: Cols) -> Column:
    """The values of a group in order, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(_key(order).alias("k"), value.alias("v")))), lambda x: x["v"])


def _window(order: Cols, by: Cols):
    return Window.partitionBy(*by).orderBy(*_sorted(order))


def _ranged(df: DataFrame, order: Cols) -> DataFrame:
    """The frame sorted by ranges, with the number of each row's range and its place in it. Written down, as a range
    partitioning samples its bounds anew each time it is planned."""
    at = F.monotonically_increasing_id()
    keys = _sorted(order)
    held = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at))
    return held.withColumn(PART, F.shiftright("__at", BITS).cast("int")).withColumn(POS, F.col("__at").bitwiseAND(F.lit((1 << BITS) - 1))).drop("__at")


def _before(rows: DataFrame, fold: Callable[[Column], Column], value: Column, combine: Callable[[Column], Column], name: str) -> DataFrame:
    """For each range that has rows: the fold of all ranges before it (null for the first). One row for each range."""
    parts = rows.groupBy(PART).agg(fold(value).alias("__one"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(PART, combine("__one").over(earlier).alias(name))


def number(df: DataFrame, order: Cols, by: Cols = (), name: str = "index", offset: int = 0) -> DataFrame:
    """with_index: rows numbered from offset."""
    if by:
        return df.withColumn(name, (F.row_number().over(_window(order, by)) - 1 + offset).cast("long"))
    rows = _ranged(df, order)
    starts = _before(rows, F.count, F.lit(1), F.sum, "__start")
    return rows.join(F.broadcast(starts), PART).withColumn(name, (F.coalesce("__start", F.lit(0)) + F.col(POS) + offset).cast("long")).drop(PART, POS, "__start")


with_index = number

#: Folds whose results of ranges can be put together: how, and by which aggregate.
JOINED = {F.sum: (F.sum, lambda a, b: a + b), F.count: (F.sum, lambda a, b: a + b), F.min: (F.min, F.least), F.max: (F.max, F.greatest)}


def scan(df: DataFrame, value: Column, order: Cols, by: Cols = (), fold: Callable[[Column], Column] = F.sum, name: str = "scan") -> DataFrame:
    """Running fold: sum, min, max, count; within groups also collect_list or any other aggregate."""
    if by:
        return df.withColumn(name, fold(value).over(_window(order, by).rowsBetween(Window.unboundedPreceding, 0)))
    if fold not in JOINED:
        raise TranslationError("a running fold without groups must be sum, count, min or max")
    combine, join = JOINED[fold]
    rows = _ranged(df.withColumn("__value", value), order)
    own = rows.withColumn("__own", fold("__value").over(Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)))
    both = own.join(F.broadcast(_before(rows, fold, F.col("__value"), combine, "__before")), PART)
    # a null is a fold over no values
    return both.withColumn(name, F.coalesce(join(F.col("__before"), F.col("__own")), "__own", "__before")).drop(PART, POS, "__value", "__own", "__before")


def _with_previous(df: DataFrame, previous: dict[str, Column], order: Cols, by: Cols) -> tuple[DataFrame, Column]:
    """The frame with the values that the given columns have in the row before, by new name, and whether there is one."""
    first = "__first"
    if by:
        w = _window(order, by)
        out = df.withColumn(first, F.row_number().over(w) == 1)
        for name, column in previous.items():
            out = out.withColumn("__own", column).withColumn(name, F.lag("__own").over(w)).drop("__own")
        return out, ~F.col(first)
    rows = _ranged(df.withColumn("__held", F.struct(*(c.alias(n) for n, c in previous.items()))), order)
    last = rows.groupBy(PART).agg(F.max_by("__held", POS).alias("__end"))
    ends = last.select(PART, F.lag("__end").over(Window.partitionBy(F.lit(0)).orderBy(PART)).alias("__carried"))
    inside = F.lag("__held").over(Window.partitionBy(PART).orderBy(POS))
    out = rows.withColumn("__inside", inside).join(F.broadcast(ends), PART)
    out = out.withColumn("__prev", F.when(F.col(POS) == 0, F.col("__carried")).otherwise(F.col("__inside")))
    out = out.select(*df.columns, *(F.col("__prev")[n].alias(n) for n in previous), (F.col("__prev").isNull()).alias(first))
    return out, ~F.col(first)


def scan_reduce(df: DataFrame, value: Column, merge: Callable[[Column, Column], Column], order: Cols, by: Cols, init: Column | None = None, name: str = "scan") -> DataFrame:
    """Running fold with any function of (accumulator, value); without init the first value begins."""
    w = _window(order, by).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(value).over(w)
    folded = F.aggregate("__seen", init, merge) if init is not None else F.aggregate(F.slice("__seen", 2, F.greatest(F.size("__seen") - 1, F.lit(0))), F.get("__seen", F.lit(0)), merge)
    return df.withColumn("__seen", seen).withColumn(name, folded).drop("__seen")


def product(df: DataFrame, value: Column, by: Cols = (), name: str = "product") -> DataFrame:
    """The product of each group's values as a double; null without any."""
    return df.groupBy(*by).agg(F.product(value).alias(name))


def _group_arrays(df: DataFrame, value: Column, order: Cols, by: Cols) -> DataFrame:
    return df.groupBy(*by).agg(values_in_order(value, order).alias("__values"))


def map_reduce(df: DataFrame, value: Column, init: Column, fn: Callable, merge: Callable, order: Cols, by: Cols, name: str = "value", rest: str = "acc") -> DataFrame:
    """Each group's values mapped by fn(value, accumulator) as an array, and its last accumulator; merge(value,
    accumulator) gives the next one. A group's values must fit one row."""
    return _two(arr.map_reduce, df, value, init, fn, merge, order, by, name, rest)


def flat_map_reduce(df: DataFrame, value: Column, init: Column, fn: Callable, merge: Callable, order: Cols, by: Cols, name: str = "value", rest: str = "acc") -> DataFrame:
    """As map_reduce, where fn gives an array; all of a group's stand in one array."""
    return _two(arr.flat_map_reduce, df, value, init, fn, merge, order, by, name, rest)


def _two(form: Callable, df, value, init, fn, merge, order, by, name, rest) -> DataFrame:
    out = _group_arrays(df, value, order, by).withColumn("__out", form(F.col("__values"), init, fn, merge))
    return out.select(*by, F.col("__out")["_1"].alias(name), F.col("__out")["_2"].alias(rest))


def chunk_while(df: DataFrame, value: Column, full: Callable[[Column], Column], order: Cols, by: Cols, name: str = "chunk", index: str = "index") -> DataFrame:
    """One row for each chunk of a group's values: its number and its array; a chunk ends after the value with which
    full(chunk so far) first holds. A group's values must fit one row."""
    out = _group_arrays(df, value, order, by).withColumn("__chunks", arr.chunk_while(F.col("__values"), full))
    return out.select(*by, F.posexplode("__chunks").alias(index, name))


def runs(df: DataFrame, key: Column, order: Cols, by: Cols = (), name: str = "run") -> DataFrame:
    """chunk_by: a run number from 0 that goes up where the key changes."""
    rows, follows = _with_previous(df.withColumn("__key", key), {"__last": F.col("__key")}, order, by)
    new = (follows & ~F.col("__key").eqNullSafe(F.col("__last"))).cast("long")
    return scan(rows.withColumn("__new", new), F.col("__new"), order, by, F.sum, name).drop("__key", "__last", "__first", "__new")


chunk_by = runs


def chunk_every(df: DataFrame, n: int, order: Cols, by: Cols = (), step: int | None = None, keep_rest: bool = True, name: str = "chunk") -> DataFrame:
    """Each row once for each chunk of n rows that begins every step rows; a short last chunk stays if keep_rest."""
    step = step or n
    rows = number(df, order, by, "__i")
    first = F.greatest(F.floor((F.col("__i") - n) / step) + 1, F.lit(0))
    out = rows.withColumn(name, F.explode(F.sequence(first.cast("long"), F.floor(F.col("__i") / step).cast("long")))).where(F.col("__i") < F.col(name) * step + n)
    if not keep_rest:
        size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        out = (out.join(size, list(by)) if by else out.crossJoin(F.broadcast(size))).where(F.col(name) * step + n <= F.col("__n")).drop("__n")
    return out.drop("__i")


def dedup_by(df: DataFrame, key: Column, order: Cols, by: Cols = ()) -> DataFrame:
    """Of each run of equal keys the first row."""
    rows, follows = _with_previous(df.withColumn("__key", key), {"__last": F.col("__key")}, order, by)
    return rows.where(~follows | ~F.col("__key").eqNullSafe(F.col("__last"))).select(*df.columns)


def uniq_by(df: DataFrame, key: Column, order: Cols, by: Cols = ()) -> DataFrame:
    """Of each key the first row: a partial aggregate finds it, no group is sorted."""
    held = df.withColumn("__key", key)
    row = F.struct(*df.columns)
    return held.groupBy(*by, "__key").agg(F.min_by(row, _key(order)).alias("__row")).select("__row.*")


def _edge(df: DataFrame, flag: Column, order: Cols, by: Cols) -> DataFrame:
    """Each row with __edge, the order of the first row of its group for which the flag does not hold (or null)."""
    bad = df.where(~F.coalesce(flag, F.lit(False))).groupBy(*(F.col(b).alias(f"__by{i}") for i, b in enumerate(by))).agg(F.min(_key(order)).alias("__edge"))
    if not by:
        return df.crossJoin(F.broadcast(bad))
    on = F.lit(True)
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    return df.join(bad, on, "left").drop(*(f"__by{i}" for i in range(len(by))))


def _inside(order: Cols) -> Column:
    return F.col("__edge").isNull() | (_key(order) < F.col("__edge"))


def take_while(df: DataFrame, flag: Column, order: Cols, by: Cols = ()) -> DataFrame:
    return _edge(df, flag, order, by).where(_inside(order)).drop("__edge")


def drop_while(df: DataFrame, flag: Column, order: Cols, by: Cols = ()) -> DataFrame:
    return _edge(df, flag, order, by).where(~_inside(order)).drop("__edge")


def split_while(df: DataFrame, flag: Column, order: Cols, by: Cols = (), name: str = "before") -> DataFrame:
    return _edge(df, flag, order, by).withColumn(name, _inside(order)).drop("__edge")


reduce_while = take_while  # the rows that a fold with halt folds


def find_index(df: DataFrame, flag: Column, order: Cols, by: Cols = (), name: str = "index") -> DataFrame:
    """One row for each group: the index of its first row for which the flag holds, or null."""
    return number(df.withColumn("__flag", flag), order, by, "__i").groupBy(*by).agg(F.min(F.when(F.col("__flag"), F.col("__i"))).alias(name))


def find_value(df: DataFrame, value: Column, order: Cols, by: Cols = (), default=None, name: str = "value") -> DataFrame:
    """One row for each group: its first value that is there and not false, or the default."""
    kind = df.select(value.alias("x")).dtypes[0][1]
    there = value.isNotNull() & (value if kind == "boolean" else F.lit(True))
    found = F.min_by(F.when(there, value), F.when(there, _key(order)))
    return df.groupBy(*by).agg((F.coalesce(found, F.lit(default)) if default is not None else found).alias(name))


def map_every(df: DataFrame, n: int, column: str, value: Column, order: Cols, by: Cols = ()) -> DataFrame:
    """Replace the column in rows 0, n, 2n, ...; n = 0 replaces none."""
    if n == 0:
        return df
    return number(df, order, by, "__i").withColumn(column, F.when(F.col("__i") % n == 0, value).otherwise(F.col(column))).drop("__i")


def take_every(df: DataFrame, n: int, order: Cols, by: Cols = ()) -> DataFrame:
    return df.limit(0) if n == 0 else number(df, order, by, "__i").where(F.col("__i") % n == 0).drop("__i")


def drop_every(df: DataFrame, n: int, order: Cols, by: Cols = ()) -> DataFrame:
    return df if n == 0 else number(df, order, by, "__i").where(F.col("__i") % n != 0).drop("__i")


def intersperse(df: DataFrame, column: str, separator: Column, order: Cols, by: Cols = (), name: str = "index") -> DataFrame:
    """The column's values with a separator between any two: (by, column, index)."""
    rows = number(df, order, by, "__i")
    both = F.when(F.col("__i") == 0, F.array(F.struct((F.col("__i") * 2).alias(name), F.col(column).alias(column)))).otherwise(
        F.array(F.struct((F.col("__i") * 2 - 1).alias(name), separator.alias(column)), F.struct((F.col("__i") * 2).alias(name), F.col(column).alias(column)))
    )
    return rows.select(*by, F.inline(both))


def take(df: DataFrame, n: int, order: Cols, by: Cols = ()) -> DataFrame:
    """The first n rows, or the last -n."""
    keys = _sorted(order, n < 0)
    if not by:
        return df.orderBy(*keys).limit(abs(n))
    w = Window.partitionBy(*by).orderBy(*keys)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= abs(n)).drop("__rn")


def drop(df: DataFrame, n: int, order: Cols, by: Cols = ()) -> DataFrame:
    """All but the first n rows, or but the last -n."""
    order = _sorted(order, n < 0)
    if by:
        return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") > abs(n)).drop("__rn")
    return number(df, order, by, "__i").where(F.col("__i") >= abs(n)).drop("__i")


def slice_(df: DataFrame, start: int, count: int, order: Cols, by: Cols = ()) -> DataFrame:
    return number(df, order, by, "__i").where((F.col("__i") >= start) & (F.col("__i") < start + count)).drop("__i")


def at(df: DataFrame, i: int, order: Cols, by: Cols = ()) -> DataFrame:
    """The row with index i, or -i from the end; no row if there is none."""
    if i < 0:
        return drop(take(df, i, order, by), i + 1, order, by) if i < -1 else take(df, -1, order, by)
    return slice_(df, i, 1, order, by)


def reverse(df: DataFrame, order: Cols, by: Cols = (), name: str = "index") -> DataFrame:
    """Rows numbered from the end."""
    return number(df, _sorted(order, True), by, name)


def reverse_slice(df: DataFrame, start: int, count: int, order: Cols, by: Cols = (), name: str = "index") -> DataFrame:
    """Rows numbered so that those of the slice stand in reverse."""
    rows = number(df, order, by, name)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.join(size, list(by)) if by else rows.crossJoin(F.broadcast(size))
    last = F.least(F.lit(start + count), F.col("__n")) - 1
    inside = (F.col(name) >= start) & (F.col(name) <= last)
    return rows.withColumn(name, F.when(inside, start + last - F.col(name)).otherwise(F.col(name)).cast("long")).drop("__n")


def slide(df: DataFrame, first: int, last: int, to: int, order: Cols, by: Cols = (), name: str = "index") -> DataFrame:
    """Rows numbered so that rows first to last stand at index ``to``."""
    n, i = last - first + 1, F.col(name)
    moved = F.when((i >= first) & (i <= last), i - first + to)
    if to < first:
        moved = moved.when((i >= to) & (i < first), i + n)
    else:
        moved = moved.when((i > last) & (i < to + n), i - n)
    return number(df, order, by, name).withColumn(name, moved.otherwise(i).cast("long"))


def zip_frames(left: DataFrame, right: DataFrame, order_left: Cols, order_right: Cols, *more: tuple[DataFrame, Cols]) -> DataFrame:
    """Row i of each frame beside row i of the others, as many as the shortest has, with index."""
    out = number(left, order_left, name="index")
    for frame, order in ((right, order_right), *more):
        out = out.join(number(frame, order, name="index"), "index")
    return out


def zip_with(frames: Sequence[tuple[DataFrame, Cols]], value: Callable[..., Column], columns: Sequence[str], name: str = "value") -> DataFrame:
    """index and a value of the columns named, of the i-th rows of two or more frames."""
    (left, a), (right, b), *more = frames
    return zip_frames(left, right, a, b, *more).select("index", value(*map(F.col, columns)).alias(name))


def zip_reduce(frames: Sequence[tuple[DataFrame, Cols]], value: Callable[..., Column], columns: Sequence[str], fold: Callable[[Column], Column] = F.sum, name: str = "value") -> DataFrame:
    """An aggregate of the values of zip_with: one row."""
    return zip_with(frames, value, columns, "__v").agg(fold("__v").alias(name))


def zip_previous(df: DataFrame, columns: Cols, order: Cols, by: Cols = (), prefix: str = "prev_") -> DataFrame:
    """Each row but the first beside the one before it."""
    rows, follows = _with_previous(df, {prefix + c: F.col(c) for c in columns}, order, by)
    return rows.where(follows).drop("__first")


def extreme(df: DataFrame, key: Column, order: Cols, by: Cols = (), largest: bool = True) -> DataFrame:
    """max_by and min_by: of each group the row with the extreme key, the first of equal ones. Rows without key lose."""
    held = df.withColumn("__key", key)
    best = held.groupBy(*by).agg((F.max if largest else F.min)("__key").alias("__best"))
    on = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in by] + [F.col("a.__key") == F.col("b.__best")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    near = held.alias("a").join(best.alias("b") if by else F.broadcast(best).alias("b"), cond, "left_semi").drop("__key")
    return near.groupBy(*by).agg(F.min_by(F.struct(*df.columns), _key(order)).alias("__row")).select("__row.*")


def fold(df: DataFrame, value: Column, init: Column, merge: Callable[[Column, Column], Column], order: Cols, by: Cols, finish: Callable[[Column], Column] | None = None, name: str = "value") -> DataFrame:
    """Any left fold of each group's values in order. A group's values must fit one row."""
    values = values_in_order(value, order)
    folded = F.aggregate(F.col("__values"), init, merge, finish) if finish else F.aggregate(F.col("__values"), init, merge)
    return df.groupBy(*by).agg(values.alias("__values")).withColumn(name, folded).drop("__values")


def map_join(df: DataFrame, value: Column, joiner: str, order: Cols, by: Cols = (), name: str = "joined") -> DataFrame:
    """The values as strings in order, joined; null is ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    values = values_in_order(text, order)
    return df.groupBy(*by).agg(F.array_join(values, joiner).alias(name))


def shuffle(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed))


def take_random(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows at random, all if there are fewer: a sampling operator."""
    return df.orderBy(F.rand(seed)).limit(n)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag difference: each row of right takes away one equal row of left."""
    return left.exceptAll(right)


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)
