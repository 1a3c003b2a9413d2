"""The registered queries of the relational engine, over the driver's tables, with their SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import call
from .operators import arr, lookup, seq
from .plans.expr import ANY, both, case, concat, either, match, native, opaque
from .plans.rules import Inference, Rules
from .sources import Catalog, Entity, belongs_to, has_many, has_one, many_to_many, through

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def catalog(spark: SparkSession, sf_dir: str, one_join: str = "inner") -> Catalog:
    c = Catalog(spark, one_join)
    path = f"{sf_dir}/{{}}.parquet".format
    c.add(Entity("region", ("r_regionkey",), {"nations": has_many("nation", "r_regionkey", "n_regionkey")}), path("region"))
    c.add(Entity("nation", ("n_nationkey",), {"region": belongs_to("region", "n_regionkey", "r_regionkey"), "customers": has_many("customer", "n_nationkey", "c_nationkey"), "orders": through("orders", "customers", "orders")}), path("nation"))
    c.add(Entity("customer", ("c_custkey",), {"nation": belongs_to("nation", "c_nationkey", "n_nationkey"), "orders": has_many("orders", "c_custkey", "o_custkey"), "events": has_many("events", "c_custkey", "user_id")}), path("customer"))
    c.add(Entity("supplier", ("s_suppkey",), {"nation": belongs_to("nation", "s_nationkey", "n_nationkey"), "lines": has_many("lineitem", "s_suppkey", "l_suppkey")}), path("supplier"))
    c.add(Entity("part", ("p_partkey",), {"lines": has_many("lineitem", "p_partkey", "l_partkey"), "suppliers": many_to_many("supplier", "p_partkey", "s_suppkey", "lineitem", "l_partkey", "l_suppkey")}), path("part"))
    c.add(Entity("orders", ("o_orderkey",), {"customer": belongs_to("customer", "o_custkey", "c_custkey"), "lines": has_many("lineitem", "o_orderkey", "l_orderkey")}, {"o_orderstatus": ("F", "O", "P")}), path("orders"))
    c.add(Entity("lineitem", LINE_KEY, {"order": belongs_to("orders", "l_orderkey", "o_orderkey"), "part": belongs_to("part", "l_partkey", "p_partkey"), "supplier": belongs_to("supplier", "l_suppkey", "s_suppkey")}), path("lineitem"))
    c.add(Entity("events", ("event_id",), {"user": belongs_to("customer", "user_id", "c_custkey")}, {"event_type": ("click", "error", "purchase", "signup", "view")}, ("ts", "event_id")), path("events"))
    c.add(Entity("documents", ("doc_id",), {"label": has_one("labels", "doc_id", "doc_id")}), path("documents"))
    c.add(Entity("labels", ("doc_id",)), path("labels"))
    c.add(Entity("conversations", ("conv_id", "turn")), path("conversations"))
    return c


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[Catalog], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return fn(catalog(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def slim(scope_or_df) -> DataFrame:
    df = scope_or_df if isinstance(scope_or_df, DataFrame) else scope_or_df.df
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


# -- scans and filters -------------------------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region")
def scan_all_regions(c):
    return c("region").df


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(c):
    return slim(c("orders").filter(lambda o: o.o_orderstatus == "F"))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
def filter_twice(c):
    return slim(c("orders").filter(lambda o: o.o_orderstatus == "O").filter(lambda o: o.o_totalprice > 200000))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 100000")
def filter_and(c):
    return slim(c("orders").filter(lambda o: (o.o_orderstatus == "P") & (o.o_totalprice < 100000)))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000")
def filter_or(c):
    return slim(c("orders").filter(lambda o: (o.o_orderstatus == "P") | (o.o_totalprice > 300000)))


@query(f"SELECT {ORDERS} FROM orders WHERE NOT (o_orderstatus = 'F')")
def filter_not(c):
    return slim(c("orders").filter(lambda o: ~(o.o_orderstatus == "F")))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_totalprice <= 250000")
def filter_cmp(c):
    day = native(lambda: F.lit("1995-01-01").cast("timestamp_ntz"))
    return slim(c("orders").filter(lambda o: o.o_orderdate.before(day()) & (o.o_orderdate >= native(lambda: F.lit("1994-01-01").cast("timestamp_ntz"))()) & (o.o_totalprice <= 250000)))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01'")
def filter_compare_gt(c):
    day = native(lambda: F.lit("1997-06-01").cast("timestamp_ntz"))
    return slim(c("orders").filter(lambda o: o.o_orderdate.compare(day()) == 1))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def filter_enum_in(c):
    return c("events").filter(lambda e: e.event_type.is_in("click", "error")).df.select("event_id", "event_type")


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def filter_map_conditions(c):
    return slim(c("orders").filter({"o_orderstatus": "F", "o_custkey": 7}))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_comment_missing = 0".replace("o_comment_missing = 0", "o_custkey IS NOT NULL"))
def filter_truthy_and(c):
    return c("orders").filter(lambda o: both(o.o_orderstatus, o.customer)).count(name="n")


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IS NULL OR o_totalprice > 300000")
def filter_nil_or(c):
    return c("orders").filter(lambda o: either(o.customer.is_nil(), o.o_totalprice > 300000)).count(name="n")


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_1'")
def filter_assoc_path2(c):
    return c("orders").filter(lambda o: o.customer.nation.n_name == "NATION_1").count(name="n")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_tax FROM lineitem WHERE l_tax = l_discount")
def filter_two_fields(c):
    return c("lineitem").filter(lambda x: x.l_tax == x.l_discount).df.select("l_orderkey", "l_partkey", "l_suppkey", "l_tax")


@query("SELECT count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = c_nationkey")
def filter_assoc_field_eq(c):
    return c("lineitem").filter(lambda x: x.supplier.s_nationkey == x.order.customer.c_nationkey).count(name="n")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 5")
def filter_assoc_eq_record(c):
    return c("orders").filter(lambda o: o.customer == {"c_custkey": 5}).df.select("o_orderkey")


# -- has_many conditions -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def exists_children(c):
    return c("orders").filter(lambda o: o.lines.any(lambda x: x.l_returnflag == "R")).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def not_exists_children(c):
    return c("orders").filter(lambda o: ~o.lines.any()).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_returnflag = 'N'))")
def all_children(c):
    return c("orders").filter(lambda o: o.lines.all(lambda x: x.l_returnflag == "N")).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > 350000 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def not_exists_in_or(c):
    return c("orders").filter(lambda o: (o.o_totalprice > 350000) | ~o.lines.any()).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) = 4")
def count_children_eq(c):
    return c("orders").filter(lambda o: o.lines.count() == 4).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) = 0")
def count_filtered_children_eq(c):
    return c("orders").filter(lambda o: o.lines.filter(lambda x: x.l_quantity > 25).count() == 0).df.select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > (SELECT count(*) FROM orders) / (SELECT count(*) FROM customer)")
def count_vs_global_scalar(c):
    return c("customer").filter(lambda u: u.orders.count() > c("orders").total() / c("customer").total()).df.select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49))")
def nested_any(c):
    return c("customer").filter(lambda u: u.orders.any(lambda o: o.lines.any(lambda x: x.l_quantity > 49))).df.select("c_custkey")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > c_nationkey + 30")
def nested_any_outer_ref(c):
    return c("customer").filter(lambda u: u.orders.any(lambda o: o.lines.any(lambda x: x.l_quantity > u.c_nationkey + 30))).df.select("c_custkey")


@query("SELECT event_id FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts > a.ts AND b.value > a.value)")
def theta_not_exists(c):
    later = lambda a: c("events").filter({"event_type": "error"}).exists(lambda b: (b.user_id == a.user_id) & (b.ts > a.ts) & (b.value > a.value))
    return c("events").filter(lambda a: (a.event_type == "signup") & ~later(a)).df.select("event_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN customer x ON o_custkey = x.c_custkey JOIN nation ON x.c_nationkey = n_nationkey WHERE o_custkey = customer.c_custkey AND o_orderstatus = 'P' AND n_regionkey = 2)")
def any_with_path(c):
    return c("customer").filter(lambda u: u.orders.any(lambda o: (o.o_orderstatus == "P") & (o.customer.nation.n_regionkey == 2))).df.select("c_custkey")


@query("SELECT o_orderkey FROM orders JOIN customer u ON o_custkey = u.c_custkey WHERE (SELECT count(*) FROM orders x WHERE x.o_custkey = u.c_custkey) >= 15")
def many_through_one(c):
    return c("orders").filter(lambda o: o.customer.orders.count() >= 15).df.select("o_orderkey")


# -- finding and counting ----------------------------------------------------------------------------------------


@query(f"SELECT {ORDERS} FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 1")
def find_first(c):
    return slim(c("orders").find(lambda o: o.o_totalprice > 300000))


@query("SELECT count(*) AS n FROM lineitem")
def count_all(c):
    return c("lineitem").count(name="n")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A'")
def count_filtered(c):
    return c("lineitem").count(lambda x: x.l_returnflag == "A", "n")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def count_batched_by_key(c):
    return lookup.count_by(c("customer").df.select("c_custkey"), c("orders").filter({"o_orderstatus": "P"}).df, {"c_custkey": "o_custkey"}, "n")


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal > 0")
def count_truthy(c):
    return c("customer").count(lambda u: u.c_acctbal > 0, "n")


@query("SELECT least(count(*), 100) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_until(c):
    return c("orders").count_until(100, lambda o: o.o_orderstatus == "O", "n")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 400000")
def any_top(c):
    return c("orders").any(lambda o: o.o_totalprice > 400000, "found")


@query("SELECT bool_and(o_totalprice > 0) AS good FROM orders")
def all_top(c):
    return c("orders").all(lambda o: o.o_totalprice > 0, "good")


@query("SELECT 'orders' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def count_dynamic_sources(c):
    out = None
    for name in ("orders", "customer", "part"):
        one = c(name).count(name="n").select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# -- groups ------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def frequencies_by(c):
    return c("events").frequencies_by("n", event_type=lambda e: e.event_type)


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
def group_by(c):
    return c("events").group_by(user_id=lambda e: e.user_id).to_lists("ids", lambda e: e.event_id).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS segments FROM customer GROUP BY c_nationkey")
def group_by_value(c):
    return c("customer").group_by(c_nationkey=lambda u: u.c_nationkey).to_lists("segments", lambda u: u.c_mktsegment).withColumn("segments", F.array_join("segments", ","))


def _cents(col):
    return F.round(col * 100, 0).cast("long")


@query("SELECT n_name, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sum_reduce(c):
    return c("orders").group_by(n_name=lambda o: o.customer.nation.n_name).agg(cents=(lambda x: F.sum(_cents(x)), lambda o: o.o_totalprice))


def _extreme_sql(desc: str) -> str:
    return f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice {desc}, o_orderkey) AS rn FROM orders) WHERE rn = 1"


@query(_extreme_sql("DESC"))
def max_by(c):
    return seq.extreme(c("orders").df, F.col("o_totalprice"), ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(_extreme_sql("ASC"))
def min_by(c):
    return seq.extreme(c("orders").df, F.col("o_totalprice"), ["o_orderkey"], ["o_custkey"], largest=False).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_custkey")
def min_max(c):
    return c("orders").group_by(o_custkey=lambda o: o.o_custkey).agg(low=(F.min, lambda o: o.o_totalprice), high=(F.max, lambda o: o.o_totalprice))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest FROM orders GROUP BY o_custkey")
def min_max_by(c):
    return c("orders").df.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"), F.max_by("o_orderkey", F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("dearest"))


@query("SELECT coalesce(max(o_totalprice), 0) AS most FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 0")
def max_fallback(c):
    return c("orders").filter(lambda o: (o.o_orderstatus == "F") & (o.o_totalprice < 0)).agg(most=(lambda x: F.coalesce(F.max(x), F.lit(0.0)), lambda o: o.o_totalprice)).select("most")


ORACLE["max_fallback"] = "SELECT CAST(coalesce(max(o_totalprice), 0) AS DOUBLE) AS most FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 0"


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def map_join(c):
    return seq.map_join(c("nation").df, F.col("n_name"), "|", ["n_nationkey"], ["n_regionkey"], "names")


@query("SELECT n_regionkey AS key, arg_max(n_name, n_nationkey) AS value FROM nation GROUP BY n_regionkey")
def into_map(c):
    # of equal keys the last value counts
    return c("nation").df.groupBy(F.col("n_regionkey").alias("key")).agg(F.max_by("n_name", "n_nationkey").alias("value"))


@query("SELECT CAST(round(avg(o_totalprice), 4) AS DOUBLE) AS mean FROM orders")
def avg_with_default(c):
    return c("orders").agg(mean=(lambda x: F.coalesce(F.round(F.avg(x), 4), F.lit(0.0)), lambda o: o.o_totalprice))


# -- ordered sequences: events per user in time ------------------------------------------------------------------

ORD, BY = ["ts", "event_id"], ["user_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
RN = f"(SELECT *, CAST(row_number() {W}) - 1 AS BIGINT) AS i FROM events)"


def events(c) -> DataFrame:
    return c("events").df.select("event_id", "ts", "user_id", "event_type", "value")


@query(f"SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) {W}) AS BIGINT) AS total FROM events")
def scan_running_sum(c):
    return seq.scan(events(c), _cents(F.col("value")), ORD, BY, F.sum, "total").select("event_id", "total")


@query(f"SELECT event_id, max(value) {W}) AS high FROM events")
def scan_running_max(c):
    return seq.scan_reduce(events(c), F.col("value"), lambda a, x: F.greatest(a, x), ORD, BY, name="high").select("event_id", "high")


@query(f"SELECT event_id, i FROM {RN}")
def with_index(c):
    return seq.with_index(events(c), ORD, BY, "i").select("event_id", "i")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 9 AS i FROM orders")
def with_index_global(c):
    return seq.with_index(c("orders").df, ["o_totalprice", "o_orderkey"], name="i", offset=10).select("o_orderkey", "i")


@query("SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS total FROM orders")
def scan_global(c):
    return seq.scan(c("orders").df, _cents(F.col("o_totalprice")), ["o_orderdate", "o_orderkey"], name="total").select("o_orderkey", "total")


@query("SELECT o_orderkey, CAST(sum(new) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS run FROM (SELECT *, CASE WHEN o_orderstatus <> lag(o_orderstatus) OVER (ORDER BY o_orderdate, o_orderkey) THEN 1 ELSE 0 END AS new FROM orders)")
def chunk_by_global(c):
    return seq.chunk_by(c("orders").df, F.col("o_orderstatus"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "run")


@query("SELECT o_orderkey FROM (SELECT *, lag(o_orderstatus) OVER (ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NULL OR prev <> o_orderstatus")
def dedup_by_global(c):
    return seq.dedup_by(c("orders").df, F.col("o_orderstatus"), ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("SELECT * FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS prev_o_orderkey FROM orders) WHERE prev_o_orderkey IS NOT NULL")
def zip_previous_global(c):
    return seq.zip_previous(c("orders").df, ["o_orderkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "prev_o_orderkey")


@query("SELECT a.i AS index, n_name || r_name || s_name AS value FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) b ON a.i = b.i JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) c ON a.i = c.i")
def zip_with_three(c):
    return seq.zip_with([(c(t).df, [k]) for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"))], F.concat, ["n_name", "r_name", "s_name"])


@query("SELECT sum(a.x * b.y) AS value FROM (SELECT n_nationkey AS x, row_number() OVER (ORDER BY n_name) AS i FROM nation) a JOIN (SELECT r_regionkey AS y, row_number() OVER (ORDER BY r_name) AS i FROM region) b ON a.i = b.i")
def zip_reduce(c):
    return seq.zip_reduce([(c("nation").df, ["n_name"]), (c("region").df, ["r_name"])], lambda x, y: x * y, ["n_nationkey", "r_regionkey"])


@query("SELECT o_orderkey, round(product(1 + l_tax), 6) AS product FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def product(c):
    out = seq.product(c("lineitem").df.withColumnRenamed("l_orderkey", "o_orderkey"), 1 + F.col("l_tax"), ["o_orderkey"])
    return out.select("o_orderkey", F.round("product", 6).alias("product"))


@query(f"SELECT user_id, string_agg(CAST(before + cents AS VARCHAR), ',' ORDER BY ts, event_id) AS totals, CAST(sum(cents) AS BIGINT) AS acc FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM events) GROUP BY user_id")
def map_reduce(c):
    out = seq.map_reduce(events(c), _cents(F.col("value")), F.lit(0).cast("long"), lambda x, acc: acc + x, lambda x, acc: acc + x, ORD, BY)
    return out.select("user_id", F.array_join(F.transform("value", lambda x: x.cast("string")), ",").alias("totals"), "acc")


@query("SELECT user_id, count(*) * 2 AS n, count(*) AS acc FROM events GROUP BY user_id")
def flat_map_reduce(c):
    out = seq.flat_map_reduce(events(c), F.col("event_type"), F.lit(0).cast("long"), lambda x, acc: F.array(x, x), lambda x, acc: acc + 1, ORD, BY)
    return out.select("user_id", F.size("value").cast("long").alias("n"), "acc")


@query(f"SELECT user_id, CAST(i // 3 AS INTEGER) AS index, string_agg(event_type, ',' ORDER BY i) AS kinds FROM {RN} GROUP BY user_id, i // 3")
def chunk_while(c):
    out = seq.chunk_while(events(c), F.col("event_type"), lambda now: F.size(now) == 3, ORD, BY)
    return out.select("user_id", "index", F.array_join("chunk", ",").alias("kinds"))


@query(f"SELECT event_id, CASE WHEN i % 3 = 0 THEN upper(event_type) ELSE event_type END AS event_type FROM {RN}")
def map_every(c):
    return seq.map_every(events(c), 3, "event_type", F.upper("event_type"), ORD, BY).select("event_id", "event_type")


@query(f"SELECT event_id FROM {RN} WHERE i % 4 = 0")
def take_every(c):
    return seq.take_every(events(c), 4, ORD, BY).select("event_id")


@query(f"SELECT event_id FROM {RN} WHERE i % 4 <> 0")
def drop_every(c):
    return seq.drop_every(events(c), 4, ORD, BY).select("event_id")


@query(f"SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n FROM (SELECT *, CAST(sum(new) {W}) AS BIGINT) AS run FROM (SELECT *, CASE WHEN row_number() {W}) > 1 AND event_type <> lag(event_type) {W}) THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, run")
def chunk_by_runs(c):
    return seq.chunk_by(events(c), F.col("event_type"), ORD, BY).groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS ids FROM (SELECT *, CAST(i // 5 AS BIGINT) AS chunk FROM {RN}) GROUP BY user_id, chunk")
def chunk_every(c):
    return seq.map_join(seq.chunk_every(events(c), 5, ORD, BY), F.col("event_id"), ",", ORD, ["user_id", "chunk"], "ids")


@query(f"SELECT user_id, CAST(k AS BIGINT) AS chunk, count(*) AS n FROM {RN}, range(0, 2000) t(k) WHERE i >= k * 2 AND i < k * 2 + 3 GROUP BY user_id, k HAVING count(*) = 3")
def chunk_every_step(c):
    return seq.chunk_every(events(c), 3, ORD, BY, step=2, keep_rest=False).groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id FROM (SELECT *, lag(event_type) {W}) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type")
def dedup_by(c):
    return seq.dedup_by(events(c), F.col("event_type"), ORD, BY).select("event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def uniq_by(c):
    return seq.uniq_by(events(c), F.col("event_type"), ORD, BY).select("event_id")


RUN = f"(SELECT *, min(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) {W}) AS ok FROM events)"


@query(f"SELECT event_id FROM {RUN} WHERE ok = 1")
def take_while(c):
    return seq.take_while(events(c), F.col("event_type") != "purchase", ORD, BY).select("event_id")


@query(f"SELECT event_id FROM {RUN} WHERE ok = 0")
def drop_while(c):
    return seq.drop_while(events(c), F.col("event_type") != "purchase", ORD, BY).select("event_id")


@query(f"SELECT event_id, ok = 1 AS before FROM {RUN}")
def split_while(c):
    return seq.split_while(events(c), F.col("event_type") != "purchase", ORD, BY).select("event_id", "before")


@query(f"SELECT user_id, min(CASE WHEN event_type = 'error' THEN i END) AS i FROM {RN} GROUP BY user_id")
def find_index(c):
    return seq.find_index(events(c), F.col("event_type") == "error", ORD, BY, "i")


@query("SELECT user_id, arg_min(value, (ts, event_id)) FILTER (event_type = 'purchase') AS value FROM events GROUP BY user_id")
def find_value(c):
    return seq.find_value(events(c), F.when(F.col("event_type") == "purchase", F.col("value")), ORD, BY)


@query(f"SELECT event_id, prev_event_id FROM (SELECT event_id, lag(event_id) {W}) AS prev_event_id FROM events) WHERE prev_event_id IS NOT NULL")
def zip_with_prev(c):
    return seq.zip_previous(events(c), ["event_id"], ORD, BY).select("event_id", "prev_event_id")


@query("SELECT a.n_name AS left_name, b.r_name AS right_name, a.i AS index FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) b ON a.i = b.i")
def zip_shortest(c):
    return seq.zip_frames(c("nation").df.select(F.col("n_name").alias("left_name"), "n_nationkey"), c("region").df.select(F.col("r_name").alias("right_name"), "r_regionkey"), ["n_nationkey"], ["r_regionkey"]).select("left_name", "right_name", "index")


@query(f"SELECT user_id, CAST(sum(CASE WHEN ok = 1 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents FROM {RUN} GROUP BY user_id HAVING max(ok) = 1")
def reduce_while(c):
    return seq.reduce_while(events(c), F.col("event_type") != "purchase", ORD, BY).groupBy("user_id").agg(F.sum(_cents(F.col("value"))).alias("cents"))


@query(f"SELECT event_id, i FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS BIGINT) AS i FROM events)")
def reverse_index(c):
    return seq.number(events(c), [F.desc("ts"), F.desc("event_id")], BY, "i").select("event_id", "i")


@query(f"SELECT event_id, CASE WHEN i BETWEEN 1 AND 2 THEN i + 3 WHEN i BETWEEN 3 AND 5 THEN i - 2 ELSE i END AS i FROM {RN}")
def slide(c):
    return seq.slide(events(c), 1, 2, 4, ORD, BY, "i").select("event_id", "i")


@query(f"SELECT event_id, CASE WHEN i BETWEEN 2 AND least(5, n - 1) THEN 2 + least(5, n - 1) - i ELSE i END AS i FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {RN})")
def reverse_slice(c):
    return seq.reverse_slice(events(c), 2, 4, ORD, BY, "i").select("event_id", "i")


@query(f"SELECT event_id FROM {RN} WHERE i BETWEEN 3 AND 6")
def slice_middle(c):
    return seq.slice_(events(c), 3, 4, ORD, BY).select("event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 2")
def at_negative(c):
    return seq.at(events(c), -2, ORD, BY).select("event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 3")
def drop_last(c):
    return seq.drop(events(c), -3, ORD, BY).select("event_id")


@query("SELECT n_regionkey, string_agg(x, '' ORDER BY k) AS text FROM (SELECT n_regionkey, n_name AS x, 2 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation UNION ALL SELECT n_regionkey, ';', 2 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation QUALIFY k > 1) GROUP BY n_regionkey")
def intersperse(c):
    rows = seq.intersperse(c("nation").df.select("n_regionkey", "n_nationkey", "n_name"), "n_name", F.lit(";"), ["n_nationkey"], ["n_regionkey"])
    return seq.map_join(rows, F.col("n_name"), "", ["index"], ["n_regionkey"], "text")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) * 1000 + count(*) AS BIGINT) AS code FROM events GROUP BY user_id")
def fold_two_accumulators(c):
    start = F.struct(F.lit(0).cast("long").alias("clicks"), F.lit(0).cast("long").alias("n"))
    merge = lambda z, x: F.struct((z["clicks"] + F.when(x == "click", 1).otherwise(0)).alias("clicks"), (z["n"] + 1).alias("n"))
    return seq.fold(events(c), F.col("event_type"), start, merge, ORD, BY, lambda z: z["clicks"] * 1000 + z["n"], "code")


# -- sorting and top-k -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderkey) - 1 AS i FROM orders")
def sort_by_asc_desc(c):
    rows = c("orders").df.withColumn("neg", -F.ascii("o_orderstatus"))
    return seq.with_index(rows, ["neg", "o_orderkey"], name="i").select("o_orderkey", "i")


@query(f"SELECT {ORDERS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_k(c):
    return slim(c("orders").sort_by(lambda o: o.o_totalprice, desc=True).limit(5))


@query("SELECT p_brand, p_partkey FROM part ORDER BY p_partkey DESC LIMIT 7")
def take_last(c):
    return seq.take(c("part").df, -7, ["p_partkey"]).select("p_brand", "p_partkey")


# -- keyed lookups -----------------------------------------------------------------------------------------------


@query("SELECT a.conv_id, a.turn, b.text AS r_text FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def query_one_composite(c):
    t = c("conversations").df
    requests = t.select("conv_id", "turn", (F.col("turn") + 1).alias("next"))
    return lookup.query_one(requests, t, {"conv_id": "conv_id", "next": "turn"}, ["conv_id", "turn"]).select("conv_id", "turn", "r_text")


@query("SELECT c_custkey, o_orderkey AS r_o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1")
def query_first_per_key(c):
    return lookup.query_first(c("customer").df.select("c_custkey"), c("orders").df, {"c_custkey": "o_custkey"}, ["c_custkey"], [("o_orderdate", "desc"), "o_orderkey"]).select("c_custkey", "r_o_orderkey")


@query("SELECT c_custkey, o_orderkey AS r_o_orderkey, CAST(rn AS INTEGER) AS rank FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) ON o_custkey = c_custkey AND rn <= 2")
def query_all_topk_per_key(c):
    return lookup.query_all(c("customer").df.select("c_custkey"), c("orders").df, {"c_custkey": "o_custkey"}, ["c_custkey"], [("o_orderdate", "desc"), "o_orderkey"], limit=2).select("c_custkey", "r_o_orderkey", "rank")


@query("SELECT o_orderkey, b_key AS r_o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT a.o_orderkey, b.o_orderkey AS b_key, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey) AS rn FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 20 DAY) WHERE rn <= 2")
def lookup_date_window(c):
    o = c("orders").df
    recent = lambda a, b: (b("o_orderdate") < a("o_orderdate")) & (b("o_orderdate") >= a("o_orderdate") - F.expr("INTERVAL 20 DAY"))
    return lookup.query_all(o, o, {"o_custkey": "o_custkey"}, ["o_orderkey"], [("o_orderdate", "desc"), "o_orderkey"], limit=2, where=recent, keep_empty=False).select("o_orderkey", "r_o_orderkey", "rank")


@query("SELECT n_name, s_suppkey AS r_s_suppkey FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) ON s_nationkey = n_nationkey AND rn = 2")
def query_offset(c):
    return lookup.query_all(c("nation").df, c("supplier").df, {"n_nationkey": "s_nationkey"}, ["n_nationkey"], ["s_suppkey"], limit=1, offset=1, null_keys=True).select("n_name", "r_s_suppkey")


# -- rules -------------------------------------------------------------------------------------------------------


def order_rules() -> Rules:
    r = Rules("orders")
    r.alias(returned={"lines": {"l_returnflag": "R"}}, open={"o_orderstatus": ["O", "P"]})
    r.infer({"o_orderstatus": "F", "returned": True}, state="disputed")
    r.infer({"o_orderstatus": "F"}, state="archived")
    r.infer({"lines": {"l_linestatus": "O"}}, state="in_progress")
    r.infer({"lines": {}}, state="ready")
    r.infer(state="empty")
    r.infer(("all", ["open", {"o_totalprice": ("gte", 150000)}]), important=True)
    r.infer(important=False)
    r.infer({"state": ["disputed", "in_progress"], "important": True}, level=2)
    r.infer({"important": True}, level=1)
    r.infer(level=0)
    return r


STATE = """CASE WHEN o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'disputed'
    WHEN o_orderstatus = 'F' THEN 'archived' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') THEN 'in_progress'
    WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'ready' ELSE 'empty' END"""
IMPORTANT = "(o_orderstatus IN ('O', 'P') AND o_totalprice >= 150000)"
RULED = f"(SELECT *, {STATE} AS state, {IMPORTANT} AS important FROM orders)"


@query(f"SELECT o_orderkey, state FROM {RULED}")
def rule_state_case(c):
    return Inference(c, order_rules()).load("orders", "state")


@query(f"SELECT o_orderkey FROM {RULED} WHERE state IN ('ready', 'empty')")
def rule_state_query_in(c):
    return Inference(c, order_rules()).query_all("orders", {"state": ["ready", "empty"]}).df.select("o_orderkey")


@query(f"SELECT o_orderkey FROM {RULED} WHERE state = 'empty'")
def rule_state_fallback(c):
    return Inference(c, order_rules()).query_all("orders", {"state": "empty"}).df.select("o_orderkey")


@query(f"SELECT count(*) AS n FROM {RULED} WHERE important")
def rule_bool_shorthand(c):
    return Inference(c, order_rules()).filter("orders", "important").count(name="n")


@query(f"SELECT o_orderkey, CAST(CASE WHEN state IN ('disputed', 'in_progress') AND important THEN 2 WHEN important THEN 1 ELSE 0 END AS INTEGER) AS level FROM {RULED}")
def rule_on_predicate(c):
    return Inference(c, order_rules()).load("orders", "level")


@query("SELECT o_orderkey, o_totalprice > 200000 AS big FROM orders")
def rule_args(c):
    r = Rules("orders").infer({"args": {"strict": True}, "o_totalprice": ("gt", ("ref", ["args", "limit"]))}, big=True).infer(big=False)
    return Inference(c, r, args={"strict": True, "limit": 200000}).load("orders", "big")


@query("SELECT o_orderkey, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def rule_ref_path(c):
    return Inference(c, Rules("orders").infer(nation=("ref", ["customer", "nation", "n_name"]))).load("orders", "nation")


@query("SELECT n_nationkey, string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey) AS people FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def rule_ref_branching(c):
    r = Rules("nation").infer(people=("ref", ["customers", {"id": "c_custkey", "segment": "c_mktsegment"}]))
    out = Inference(c, r).load("nation", "people")
    return out.select("n_nationkey", F.array_join(F.transform("people", lambda p: F.concat(p["id"].cast("string"), F.lit(":"), p["segment"])), ",").alias("people"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def rule_override_field(c):
    r = Rules("customer").infer({"fields": {"c_acctbal": ("lt", 0)}}, c_mktsegment="DEBT").infer(c_mktsegment=("ref", ["fields", "c_mktsegment"]))
    return Inference(c, r).load("customer", "c_mktsegment")


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS first_open FROM customer")
def rule_bind_first_child(c):
    r = Rules("customer").infer({"orders": ("bind", "order", {"o_orderstatus": "P"})}, first_open=("bound", "order", ["o_orderkey"]))
    return Inference(c, r).load("customer", "first_open")


@query("SELECT n_nationkey, coalesce(string_agg(s_suppkey, ',' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_nationkey")
def rule_map(c):
    c.entities["nation"].assocs["suppliers"] = has_many("supplier", "n_nationkey", "s_nationkey")
    r = Rules("nation").infer(suppliers_=("map", "suppliers", {"s_acctbal": ("gt", 0)}, "s_suppkey"))
    out = Inference(c, r).load("nation", "suppliers_")
    return out.select("n_nationkey", F.array_join(F.transform("suppliers_", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("SELECT n_nationkey, string_agg(n_name || ':' || c_custkey, ',' ORDER BY c_custkey) AS people FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey")
def rule_map_bind(c):
    r = Rules("nation").infer(people=("map", "customers", ("bind", "who", {"c_acctbal": ("gt", 9000)}), ("call", "concat", ("ref", "n_name"), ":", ("bound", "who", ["c_custkey"]))))
    out = Inference(c, r).load("nation", "people").where(F.size("people") > 0)
    return out.select("n_nationkey", F.array_join("people", ",").alias("people"))


@query("SELECT c_custkey AS id, n_name AS nation, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rule_select(c):
    r = Rules("customer").infer({"c_acctbal": ("lt", 0)}, state="debt").infer(state="fine")
    return Inference(c, r).select("customer", {"id": "c_custkey", "nation": ("ref", ["nation", "n_name"]), "state": "state"})


@query("SELECT o_orderkey, coalesce(count(l_partkey), 0) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity >= 30 GROUP BY o_orderkey")
def rule_filter(c):
    r = Rules("orders").infer(large=("filter", "lines", {"l_quantity": ("gte", 30)}))
    return Inference(c, r).load("orders", "large").select("o_orderkey", F.size("large").cast("long").alias("n"))


@query("SELECT o_orderkey, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' GROUP BY o_orderkey")
def rule_count(c):
    return Inference(c, Rules("orders").infer(n=("count", "lines", {"l_returnflag": "A"}))).load("orders", "n")


@query(f"SELECT c_custkey, CAST(coalesce(n, 0) AS INTEGER) AS n FROM customer LEFT JOIN (SELECT user_id, count(*) FILTER (ok = 1) AS n FROM (SELECT *, min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) {W}) AS ok FROM events) GROUP BY user_id) ON user_id = c_custkey")
def rule_count_while(c):
    r = Rules("customer").infer(n=("count_while", "events", ("not", {"event_type": "error"})))
    return Inference(c, r).load("customer", "n")


@query("SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS code, CAST(isodow(o_orderdate) AS INTEGER) AS weekday FROM orders")
def rule_function_calls(c):
    r = Rules("orders").infer(code=("call", "concat", ("ref", "o_orderstatus"), "-", ("ref", "o_orderpriority"))).infer(weekday=("call", "day_of_week", ("ref", "o_orderdate")))
    return Inference(c, r).load("orders", "code", "weekday")


@query(f"SELECT o_orderkey, state || '/' || important AS inferred FROM {RULED}")
def rule_put_inferred(c):
    out = Inference(c, order_rules()).put("orders", "state", "important")
    return out.select("o_orderkey", F.concat("inferred.state", F.lit("/"), F.col("inferred.important").cast("string")).alias("inferred"))


@query(f"SELECT o_orderkey FROM {RULED} WHERE NOT (state = 'archived')")
def rule_reject(c):
    return Inference(c, order_rules()).reject("orders", {"state": "archived"}).df.select("o_orderkey")


@query("SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer")
def rule_query_first(c):
    r = Rules("customer").infer(last=("call", lambda s: s["o_orderdate"], ("first", "orders", {"o_custkey": ("ref", "c_custkey")}, {"order_by": ("desc", "o_orderdate")})))
    return Inference(c, r).load("customer", "last")


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 1) AS first FROM customer")
def rule_query_first_orders(c):
    r = Rules("customer").infer(first=("call", lambda s: s["o_orderkey"], ("first", "orders", {"o_custkey": ("ref", "c_custkey")}, {"order_by": [("asc", "o_orderpriority"), ("desc", "o_totalprice")]})))
    return Inference(c, r).load("customer", "first")


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY CASE WHEN o_totalprice > 100000 THEN o_totalprice END NULLS LAST, o_orderkey LIMIT 1) AS a, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY CASE WHEN o_totalprice > 100000 THEN o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 1) AS b FROM customer")
def query_first_null_order(c):
    rows = c("orders").df.withColumn("large", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    first = lambda df, order, name: lookup.query_first(df, rows, {"c_custkey": "o_custkey"}, ["c_custkey"], [order, "o_orderkey"]).select(*df.columns, F.col("r_o_orderkey").alias(name))
    return first(first(c("customer").df.select("c_custkey"), "large", "a"), ("large", "desc"), "b")


@query("SELECT c_custkey, (SELECT string_agg(o_orderkey, ',' ORDER BY rn) FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderdate, o_orderkey) AS rn FROM orders WHERE o_custkey = c_custkey) WHERE rn <= 3) AS three FROM customer")
def rule_lookup_two_orders(c):
    r = Rules("customer").infer(three=("lookup", "orders", {"o_custkey": ("ref", "c_custkey")}, {"order_by": [("desc", "o_orderstatus"), "o_orderdate"], "limit": 3}))
    out = Inference(c, r).load("customer", "three")
    return out.select("c_custkey", F.nullif(F.array_join(F.transform("three", lambda x: x["o_orderkey"].cast("string")), ","), F.lit("")).alias("three"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice * 3 > o_totalprice) AS n FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P')")
def count_repeated_outer_rows(c):
    both = c("orders").df.unionByName(c("orders").df.where("o_orderstatus = 'P'"))
    c.add(c.entities["orders"], both)
    c._frames.pop("orders")
    return c("orders").map(o_orderkey=lambda o: o.o_orderkey, n=lambda o: o.lines.count(lambda x: x.l_extendedprice * 3 > o.o_totalprice))


@query("SELECT o_orderkey, o_totalprice > 350000 AS huge FROM orders")
def rule_extra_first(c):
    base = Rules("orders").infer(huge=False)
    return Inference(c, base, extra=[Rules("orders").infer({"o_totalprice": ("gt", 350000)}, huge=True)]).load("orders", "huge")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_tax > 0.02))")
def rule_all_children(c):
    return Inference(c).filter("orders", {"lines": ("all?", {"l_tax": ("gt", 0.02)})}).df.select("o_orderkey")


# -- control flow and functions ----------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN n_regionkey = 1 THEN 'home' ELSE 'other' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey")
def cond_branches(c):
    return c("customer").map(c_custkey=lambda u: u.c_custkey, kind=lambda u: case((u.c_acctbal < 0, "debt"), (u.nation.n_regionkey == 1, "home"), default="other"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'open' END AS kind FROM orders")
def case_patterns(c):
    return c("orders").map(o_orderkey=lambda o: o.o_orderkey, kind=lambda o: match(o, ({"o_orderstatus": "F"}, "done"), ({"o_orderstatus": lambda s: s == "P"}, lambda x: x.o_orderpriority), (ANY, "open")))


@query("SELECT c_custkey, c_name || ' of ' || n_name || ' (' || c_custkey || ')' AS title FROM customer JOIN nation ON c_nationkey = n_nationkey")
def string_interpolation(c):
    return c("customer").map(c_custkey=lambda u: u.c_custkey, title=lambda u: concat(u.c_name, " of ", u.nation.n_name, " (", u.c_custkey, ")"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) // 7 AS d, CAST(l_quantity AS BIGINT) % 7 AS r, CAST(round(l_extendedprice) AS BIGINT) AS p, greatest(l_tax, l_discount) AS m FROM lineitem")
def arithmetic(c):
    q = native(lambda x: x.cast("long"))
    return c("lineitem").map(l_orderkey=lambda x: x.l_orderkey, l_partkey=lambda x: x.l_partkey, l_suppkey=lambda x: x.l_suppkey, d=lambda x: call("div", q(x.l_quantity), 7), r=lambda x: call("rem", q(x.l_quantity), native(lambda: F.lit(7).cast("long"))()), p=lambda x: call("round", x.l_extendedprice), m=lambda x: call("max", x.l_tax, x.l_discount))


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def date_functions(c):
    d = native(lambda x: x.cast("date"))
    out = c("orders").map(o_orderkey=lambda o: o.o_orderkey, due=lambda o: call("date_add", d(o.o_orderdate), 30), days=lambda o: call("diff_days", d(o.o_orderdate), native(lambda: F.lit("1992-01-01").cast("date"))()))
    return out.withColumn("days", F.col("days").cast("long"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def map_projection(c):
    return c("orders").map(lambda o: {"o_orderkey": o.o_orderkey, "c_name": o.customer.c_name, "n_name": o.customer.nation.n_name})


@query("SELECT l_suppkey AS value, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY l_suppkey")
def flat_map(c):
    return c("orders").filter({"o_orderstatus": "P"}).flat_map(lambda o: o.lines.map(lambda x: x.l_suppkey)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# -- sets and bags -----------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def concat_bags(c):
    return seq.concat(c("customer").df.select(F.col("c_nationkey").alias("k")), c("supplier").df.select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def bag_difference(c):
    return seq.difference(c("customer").df.select(F.col("c_nationkey").alias("k")), c("supplier").df.select(F.col("s_nationkey").alias("k")))


@query("SELECT o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY 1")
def split_with(c):
    yes, no = c("orders").split_with(lambda o: o.o_totalprice > 100000)
    return yes.count(name="n").select(F.lit(True).alias("big"), "n").unionByName(no.count(name="n").select(F.lit(False).alias("big"), "n"))


@query(f"SELECT {ORDERS} FROM orders WHERE NOT (o_orderstatus = 'O')")
def reject(c):
    return slim(c("orders").reject(lambda o: o.o_orderstatus == "O"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def uniq(c):
    return c("customer").df.select("c_mktsegment").dropDuplicates()


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
def member(c):
    return c("part").filter(lambda p: p.p_size.is_in(1, 5, 9)).df.select("p_partkey")


# -- user functions ----------------------------------------------------------------------------------------------


def odd_digits(x: float) -> bool:
    return sum(map(int, str(int(x)))) % 2 == 1


ODD = "(SELECT sum(CAST(d AS INTEGER)) FROM (SELECT unnest(string_split(CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR), '')) AS d)) % 2 = 1"


@query("SELECT o_orderkey FROM orders WHERE CAST(trunc(o_totalprice) AS BIGINT) % 3 = 0")
def udf_residual_filter(c):
    third = opaque(lambda x: int(x) % 3 == 0)
    return c("orders").filter(lambda o: third(o.o_totalprice)).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_nationkey < 10 AND NOT (o_totalprice > 100000 AND CAST(trunc(o_totalprice) AS BIGINT) % 3 = 0)")
def udf_and_native_split(c):
    third = opaque(lambda x: int(x) % 3 == 0)
    return c("orders").filter(lambda o: ~((o.o_totalprice > 100000) & third(o.o_totalprice)) & (o.o_orderstatus == "F") & (o.customer.c_nationkey < 10)).df.select("o_orderkey")


# -- whole programs ----------------------------------------------------------------------------------------------


@query("SELECT l_partkey, round(avg(ratio), 9) AS efficiency FROM (SELECT l_partkey, l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) / count(*) AS ratio FROM lineitem GROUP BY l_partkey, l_orderkey) GROUP BY l_partkey ORDER BY 2 DESC, 1 LIMIT 5")
def template_efficiency(c):
    ratios = c("lineitem").group_by(l_partkey=lambda x: x.l_partkey, l_orderkey=lambda x: x.l_orderkey).agg(ratio=(lambda f: F.avg(F.when(f == "R", 1.0).otherwise(0.0)), lambda x: x.l_returnflag))
    return ratios.groupBy("l_partkey").agg(F.round(F.avg("ratio"), 9).alias("efficiency")).orderBy(F.desc("efficiency"), "l_partkey").limit(5)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def dormant_users(c):
    day = native(lambda: F.lit("1998-01-01").cast("timestamp_ntz"))
    return c("customer").filter(lambda u: (u.events.count(lambda e: e.event_type == "purchase") == 0) & ~u.orders.any(lambda o: o.o_orderdate >= day())).df.select("c_custkey")


@query("SELECT n_nationkey, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY n_nationkey")
def through_assoc(c):
    return c("nation").map(n_nationkey=lambda n: n.n_nationkey, n=lambda n: n.orders.count(lambda o: o.o_orderstatus == "P"))


@query("SELECT p_partkey, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def m2m_assoc(c):
    return c("part").map(p_partkey=lambda p: p.p_partkey, n=lambda p: p.suppliers.count())


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def has_one_value(c):
    return c("documents").map(doc_id=lambda d: d.doc_id, quality=lambda d: d.label.quality)


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def has_one_missing(c):
    return c("documents").filter(lambda d: d.label.is_nil()).df.select("doc_id")


@query("SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'invite' WHEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') > 5 THEN 'thank' WHEN EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 45) THEN 'call' ELSE 'wait' END AS action FROM customer")
def next_action(c):
    return c("customer").map(
        c_custkey=lambda u: u.c_custkey,
        action=lambda u: case((~u.orders.any(), "invite"), (u.orders.count(lambda o: o.o_orderstatus == "O") > 5, "thank"), (u.orders.any(lambda o: o.lines.any(lambda x: (x.l_returnflag == "R") & (x.l_quantity > 45))), "call"), default="wait"),
    )


# -- arrays in rows: each user's event types and values in order -------------------------------------------------


def _lists(c) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type", _cents(F.col("value")).alias("cents"))))
    return c("events").df.groupBy("user_id").agg(items.alias("items")).select("user_id", F.transform("items", lambda x: x["event_type"]).alias("kinds"), F.transform("items", lambda x: x["cents"]).alias("cents"))


def _csv(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query(f"SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) FILTER (ok = 1) AS head, count(*) FILTER (ok = 0) AS rest FROM {RUN} GROUP BY user_id")
def arr_split_while(c):
    parts = arr.split_while(F.col("kinds"), lambda x: x != "purchase")
    out = _lists(c).select("user_id", parts.alias("p"))
    return out.select("user_id", F.nullif(F.array_join("p._1", ","), F.lit("")).alias("head"), F.size("p._2").cast("long").alias("rest"))


@query(f"SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM (SELECT *, lag(event_type) {W}) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type GROUP BY user_id")
def arr_dedup(c):
    return _lists(c).select("user_id", F.array_join(arr.dedup_by(F.col("kinds")), ",").alias("kinds"))


@query(f"SELECT user_id, string_agg(CAST(total AS VARCHAR), ',' ORDER BY ts, event_id) AS totals FROM (SELECT *, CAST(sum(CAST(round(value * 100) AS BIGINT)) {W}) AS BIGINT) AS total FROM events) GROUP BY user_id")
def arr_scan(c):
    return _lists(c).select("user_id", _csv(arr.scan(F.col("cents"), lambda z, x: z + x)).alias("totals"))


@query(f"SELECT user_id, count(*) FILTER (new = 1) + 1 AS n FROM (SELECT *, CASE WHEN event_type <> lag(event_type) {W}) THEN 1 ELSE 0 END AS new FROM events) GROUP BY user_id")
def arr_chunk_by(c):
    return _lists(c).select("user_id", F.size(arr.chunk_by(F.col("kinds"), lambda x: x)).cast("long").alias("n"))


@query("SELECT user_id, count(*) AS size, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS most FROM events GROUP BY user_id")
def arr_reduce(c):
    z = F.col("cents")
    return _lists(c).select("user_id", arr.count(z).cast("long").alias("size"), arr.sum_(z, F.lit(0).cast("long")).alias("total"), arr.max_(z).alias("most"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def arr_frequencies(c):
    return _lists(c).select("user_id", F.explode(arr.frequencies_by(F.col("kinds"))).alias("event_type", "n")).withColumn("n", F.col("n").cast("long"))


@query(f"SELECT user_id, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(round(value * 100) AS BIGINT) DESC, ts, event_id) AS cents FROM events GROUP BY user_id")
def arr_sort_desc(c):
    return _lists(c).select("user_id", _csv(arr.sort(F.col("cents"), desc=True)).alias("cents"))


@query(f"SELECT user_id, string_agg(CASE WHEN i % 3 = 0 THEN upper(event_type) ELSE event_type END, ',' ORDER BY i) AS kinds FROM {RN} GROUP BY user_id")
def arr_map_every(c):
    return _lists(c).select("user_id", F.array_join(arr.map_every(F.col("kinds"), 3, F.upper), ",").alias("kinds"))


@query(f"SELECT user_id, string_agg(chunk, ';' ORDER BY k) AS chunks FROM (SELECT user_id, i // 4 AS k, string_agg(event_type, ',' ORDER BY i) AS chunk FROM {RN} GROUP BY ALL) GROUP BY user_id")
def arr_chunk_every(c):
    return _lists(c).select("user_id", F.array_join(F.transform(arr.chunk_every(F.col("kinds"), 4), lambda x: F.array_join(x, ",")), ";").alias("chunks"))


@query(f"SELECT user_id, string_agg(event_type || ':' || CAST(round(value * 100) AS BIGINT), ',' ORDER BY i) AS pairs FROM {RN} GROUP BY user_id")
def arr_zip_with(c):
    return _lists(c).select("user_id", F.array_join(arr.zip_with(F.col("kinds"), F.col("cents"), lambda a, b: F.concat(a, F.lit(":"), b.cast("string"))), ",").alias("pairs"))


@query(f"SELECT user_id, min(CASE WHEN event_type = 'error' THEN i END) AS i FROM {RN} GROUP BY user_id")
def arr_find_index(c):
    return _lists(c).select("user_id", arr.find_index(F.col("kinds"), lambda x: x == "error").cast("long").alias("i"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 GROUP BY user_id")
def arr_uniq_by(c):
    return _lists(c).select("user_id", F.array_join(arr.uniq_by(F.col("kinds"), lambda x: x), ",").alias("kinds"))
