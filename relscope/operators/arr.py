"""Sequence operators on array columns: the collection is nested in a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _empty(a: Column) -> Column:
    return F.slice(a, 1, 0)


def _prefix(a: Column, fn: Fn) -> Column:
    """Length of the longest prefix for which fn holds."""
    stop = F.array_position(F.transform(a, lambda x: _true(fn(x))), False)
    return F.when(stop == 0, F.size(a)).otherwise(stop - 1).cast("int")


def map_(a, fn):
    return F.transform(a, fn)


def flat_map(a, fn):
    return F.flatten(F.transform(a, fn))


def filter_(a, fn):
    return F.filter(a, lambda x: _true(fn(x)))


def reject(a, fn):
    return F.filter(a, lambda x: ~_true(fn(x)))


def filter_map(a, keep, fn):
    return F.transform(filter_(a, keep), fn)


def split_with(a, fn):
    return F.struct(filter_(a, fn).alias("_1"), reject(a, fn).alias("_2"))


def any_(a, fn: Fn = lambda x: x):
    return F.exists(a, lambda x: _true(fn(x)))


def all_(a, fn: Fn = lambda x: x):
    return F.forall(a, lambda x: _true(fn(x)))


def count(a, fn: Fn | None = None):
    return F.size(a) if fn is None else F.size(filter_(a, fn))


def count_until(a, limit: int, fn: Fn | None = None):
    return F.least(count(a, fn), F.lit(limit))


def empty(a):
    return F.size(a) == 0


def member(a, x):
    return _true(F.array_contains(a, x))


def at(a, i: int, default=None):
    got = F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)
    return got if default is None else F.coalesce(got, F.lit(default))


def fetch(a, i: int):
    """The element at i, or an error."""
    n = i if i >= 0 else -i - 1
    return F.when(F.size(a) > n, at(a, i)).otherwise(F.raise_error(F.lit(f"no element at {i}")))


def find(a, fn: Fn, default=None):
    got = F.get(filter_(a, fn), F.lit(0))
    return got if default is None else F.when(any_(a, fn), got).otherwise(F.lit(default))


def find_index(a, fn: Fn):
    return F.nullif(F.array_position(F.transform(a, lambda x: _true(fn(x))), True), F.lit(0)) - 1


def find_value(a, fn: Fn, default=None):
    got = F.get(F.filter(F.transform(a, fn), lambda x: x.isNotNull()), F.lit(0))
    return got if default is None else F.coalesce(got, F.lit(default))


def with_index(a, offset: int = 0):
    return F.transform(a, lambda x, i: F.struct(x.alias("_1"), (i + offset).alias("_2")))


def map_with_index(a, fn):
    return F.transform(a, fn)


def scan(a, merge, init: Column | None = None):
    """All accumulators of a fold; without init the first element is the first."""
    grow = lambda z, x: F.concat(z, F.array(merge(F.element_at(z, -1), x)))
    if init is None:
        return F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1), grow)
    return F.slice(F.aggregate(a, F.array(init), grow), 2, F.greatest(F.size(a), F.lit(0)))


def _runs(a, new):
    """Arrays of the elements between those for which new(element, previous) holds."""
    start = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | new(x, F.get(a, i - 1)), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    return F.transform(start, lambda s, k: F.slice(a, s + 1, F.coalesce(F.get(start, k + 1), F.size(a)) - s))


def chunk_by(a, fn: Fn):
    return _runs(a, lambda x, p: ~fn(x).eqNullSafe(fn(p)))


def dedup_by(a, fn: Fn = lambda x: x):
    return F.filter(a, lambda x, i: (i == 0) | ~fn(x).eqNullSafe(fn(F.get(a, i - 1))))


def uniq_by(a, fn: Fn):
    """The first element of each key."""
    keys = F.transform(a, fn)
    return F.filter(a, lambda x, i: ~F.exists(F.slice(keys, F.lit(1), i), lambda k: k.eqNullSafe(fn(x))))


def uniq(a):
    return F.array_distinct(a)


def take(a, n: int):
    return F.slice(a, 1, n) if n >= 0 else F.slice(a, F.greatest(F.size(a) + n, F.lit(0)) + 1, F.lit(-n))


def drop(a, n: int):
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0))) if n >= 0 else F.slice(a, F.lit(1), F.greatest(F.size(a) + n, F.lit(0)))


def split(a, n: int):
    return F.struct(take(a, n).alias("_1"), drop(a, n).alias("_2"))


def slice_(a, start: int, count_: int):
    return F.slice(a, start + 1, count_)


def take_while(a, fn: Fn):
    return F.slice(a, F.lit(1), _prefix(a, fn))


def drop_while(a, fn: Fn):
    return F.slice(a, _prefix(a, fn) + 1, F.size(a))


def split_while(a, fn: Fn):
    return F.struct(take_while(a, fn).alias("_1"), drop_while(a, fn).alias("_2"))


def map_every(a, n: int, fn: Fn):
    return a if n == 0 else F.transform(a, lambda x, i: F.when(i % n == 0, fn(x)).otherwise(x))


def take_every(a, n: int):
    return _empty(a) if n == 0 else F.filter(a, lambda x, i: i % n == 0)


def drop_every(a, n: int):
    return a if n == 0 else F.filter(a, lambda x, i: i % n != 0)


def chunk_every(a, n: int, step: int | None = None, keep_rest: bool = True):
    step = step or n
    starts = F.filter(F.transform(a, lambda x, i: i), lambda i: (i % step == 0) & (F.lit(keep_rest) | (i + n <= F.size(a))))
    return F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(n)))


def map_intersperse(a, separator, fn: Fn = lambda x: x):
    return F.flatten(F.transform(a, lambda x, i: F.when(i == 0, F.array(fn(x))).otherwise(F.array(separator, fn(x)))))


def intersperse(a, separator):
    return map_intersperse(a, separator)


def map_join(a, joiner: str = "", fn: Fn = lambda x: x):
    return F.array_join(F.transform(a, lambda x: F.coalesce(fn(x).cast("string"), F.lit(""))), joiner)


def reduce(a, merge, init: Column | None = None):
    if init is not None:
        return F.aggregate(a, init, merge)
    return F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), merge)


def reduce_while(a, init: Column, merge, go_on):
    """Fold until go_on(accumulator, element) is false; that element is not folded."""
    out = F.aggregate(a, F.struct(init.alias("acc"), F.lit(False).alias("done")), lambda z, x: F.when(z["done"] | ~_true(go_on(z["acc"], x)), F.struct(z["acc"].alias("acc"), F.lit(True).alias("done"))).otherwise(F.struct(merge(z["acc"], x).alias("acc"), z["done"].alias("done"))))
    return out["acc"]


def map_reduce(a, init: Column, fn, merge):
    """(mapped elements, last accumulator); fn and merge get (element, accumulator before it)."""
    start = F.struct(F.transform(_empty(a), lambda x: fn(x, init)).alias("_1"), init.alias("_2"))
    return F.aggregate(a, start, lambda z, x: F.struct(F.concat(z["_1"], F.array(fn(x, z["_2"]))).alias("_1"), merge(x, z["_2"]).alias("_2")))


def flat_map_reduce(a, init: Column, fn, merge, go_on=lambda x, acc: F.lit(True)):
    """Like map_reduce, but fn gives an array and the fold halts where go_on is false."""
    start = F.struct(F.flatten(F.transform(_empty(a), lambda x: fn(x, init))).alias("_1"), init.alias("_2"), F.lit(False).alias("done"))
    out = F.aggregate(a, start, lambda z, x: F.when(z["done"] | ~_true(go_on(x, z["_2"])), F.struct(z["_1"].alias("_1"), z["_2"].alias("_2"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(z["_1"], fn(x, z["_2"])).alias("_1"), merge(x, z["_2"]).alias("_2"), z["done"].alias("done"))))
    return F.struct(out["_1"].alias("_1"), out["_2"].alias("_2"))


def chunk_while(a, full):
    """Chunks that end after the element with which full(chunk so far) first holds."""
    start = F.struct(F.transform(_empty(a), lambda x: _empty(a)).alias("chunks"), _empty(a).alias("now"))

    def step(z, x):
        now = F.concat(z["now"], F.array(x))
        return F.when(full(now), F.struct(F.concat(z["chunks"], F.array(now)).alias("chunks"), _empty(a).alias("now"))).otherwise(F.struct(z["chunks"].alias("chunks"), now.alias("now")))

    return F.aggregate(a, start, step, lambda z: F.when(F.size(z["now"]) > 0, F.concat(z["chunks"], F.array(z["now"]))).otherwise(z["chunks"]))


def frequencies_by(a, fn: Fn = lambda x: x):
    keys = F.transform(a, fn)
    return F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x.eqNullSafe(k)))))


def group_by(a, fn: Fn, value: Fn = lambda x: x):
    keys = F.array_distinct(F.transform(a, fn))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(a, lambda x: fn(x).eqNullSafe(k)), value)))


def into_map(a, fn: Fn):
    """A map of the (_1, _2) that fn gives; of equal keys the last one counts."""
    pairs = F.transform(a, fn)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["_1"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["_1"] == k), -1)["_2"]))


def extreme_by(a, fn: Fn, largest: bool = True, fallback=None):
    """max_by and min_by: the first element with the extreme key; of an empty array the fallback or null."""
    best = (F.array_max if largest else F.array_min)(F.transform(a, fn))
    got = F.get(F.filter(a, lambda x: fn(x) == best), F.lit(0))
    return got if fallback is None else F.coalesce(got, F.lit(fallback))


def max_(a, fallback=None):
    return F.array_max(a) if fallback is None else F.coalesce(F.array_max(a), F.lit(fallback))


def min_(a, fallback=None):
    return F.array_min(a) if fallback is None else F.coalesce(F.array_min(a), F.lit(fallback))


def max_strict(a):
    return F.coalesce(F.array_max(a), F.raise_error(F.lit("empty")))


def min_max(a):
    return F.struct(F.array_min(a).alias("_1"), F.array_max(a).alias("_2"))


def min_max_by(a, fn: Fn):
    return F.struct(extreme_by(a, fn, False).alias("_1"), extreme_by(a, fn).alias("_2"))


def sum_(a, zero: Column | None = None):
    return F.aggregate(a, F.lit(0.0) if zero is None else zero, lambda z, x: z + x)


def product(a):
    return F.aggregate(a, F.lit(1.0), lambda z, x: z * x)


def sort_by(a, fn: Fn, desc: bool = False):
    """Stable; missing keys last."""
    keyed = F.transform(a, lambda x, i: F.struct(fn(x).alias("k"), i.alias("i"), x.alias("x")))

    def order(p, q):
        near, far = (F.lit(1), F.lit(-1)) if desc else (F.lit(-1), F.lit(1))
        return F.when(p["k"].isNull() & q["k"].isNull(), p["i"] - q["i"]).when(p["k"].isNull(), F.lit(1)).when(q["k"].isNull(), F.lit(-1)).when(p["k"] < q["k"], near).when(p["k"] > q["k"], far).otherwise(p["i"] - q["i"])

    return F.transform(F.array_sort(keyed, order), lambda p: p["x"])


def sort(a, desc: bool = False):
    return sort_by(a, lambda x: x, desc)


def sort_with(a, compare):
    """By a comparator of two elements: a column of -1, 0 or 1."""
    return F.array_sort(a, compare)


def random(a):
    return F.get(F.shuffle(a), F.lit(0))


def take_random(a, n: int):
    return F.slice(F.shuffle(a), 1, n)


def reverse(a):
    return F.reverse(a)


def reverse_slice(a, start: int, n: int):
    return F.concat(take(a, start), F.reverse(F.slice(a, start + 1, n)), drop(a, start + n))


def slide(a, first: int, last: int, to: int):
    part, rest = F.slice(a, first + 1, last - first + 1), F.concat(take(a, first), drop(a, last + 1))
    return F.concat(take(rest, to), part, drop(rest, to))


def zip_with(a, b, fn):
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), fn)


def zip_(a, b):
    return zip_with(a, b, lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))


def unzip(a):
    return F.struct(F.transform(a, lambda x: x["_1"]).alias("_1"), F.transform(a, lambda x: x["_2"]).alias("_2"))


def zip_reduce(a, b, init: Column, merge):
    return F.aggregate(zip_(a, b), init, lambda z, p: merge(p["_1"], p["_2"], z))


def concat(*arrays):
    return F.concat(*arrays)


def difference(a, b):
    """Each element of b takes away the first equal element of a."""
    seen = lambda arr, x, i: F.size(F.filter(F.slice(arr, F.lit(1), i), lambda y: y.eqNullSafe(x)))
    return F.filter(a, lambda x, i: seen(a, x, i) >= F.size(F.filter(b, lambda y: y.eqNullSafe(x))))


def count_while(a, fn: Fn):
    """Elements for which fn is true before the first for which it is false; null neither counts nor stops."""
    stop = F.array_position(F.transform(a, lambda x: F.coalesce(fn(x), F.lit(True))), False)
    return F.size(filter_(F.slice(a, F.lit(1), F.when(stop == 0, F.size(a)).otherwise(stop - 1).cast("int")), fn))


def shuffle(a):
    return F.shuffle(a)


def each(a, _fn=None):
    """Effects are not run; the value is 'ok'."""
    import warnings

    warnings.warn("each is not run on rows", stacklevel=2)
    return F.lit("ok")
