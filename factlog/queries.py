"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import Functions
from .operators import Defined, Spec, evaluate, pull, transact
from .operators.transact import DATOMS
from .plans import Query, call, compare, not_, or_, rule
from .sources import Attribute, Cardinality, FactLog, Registry, ValueType, WideTables
from .sources.log import value_of

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": None, "events": "event_id", "labels": "doc_id", "conversations": ("conv_id", "turn"),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def wide(spark: SparkSession, sf_dir: str, *names: str) -> WideTables:
    return WideTables({n: (spark.read.parquet(f"{sf_dir}/{n}.parquet"), KEYS[n]) for n in names})


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def simple(name: str, sql: str, tables: str, find: list, where: list, columns: list[str], **options) -> None:
    """A query over wide tables; columns: the result's names, in the order of find."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Query(wide(spark, sf_dir, *tables.split()), find, where, **options).run().toDF(*columns)

    QUERIES[name], SQL[name] = run, sql


# patterns, constants, joins

C, O, N = "?c", "?o", "?n"
simple("pattern_scan", "SELECT DISTINCT n_nationkey::BIGINT AS nation, n_name AS name FROM nation", "nation", [N, "?name"], [(N, ":nation/n_name", "?name")], ["nation", "name"])
simple("const_value", "SELECT DISTINCT c_custkey AS customer FROM customer WHERE c_mktsegment = 'BUILDING'", "customer", [C], [(C, ":customer/c_mktsegment", "BUILDING")], ["customer"])
simple("const_entity", "SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey = 7", "customer", ["?name"], [(7, ":customer/c_name", "?name")], ["name"])
simple("star_join", "SELECT DISTINCT o_orderkey AS o, o_custkey AS c, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'", "orders", [O, C, "?p"], [(O, ":orders/o_custkey", C), (O, ":orders/o_totalprice", "?p"), (O, ":orders/o_orderstatus", "F")], ["o", "c", "price"])
simple("ref_path_join", "SELECT DISTINCT o_orderkey AS o, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "orders customer nation", [O, "?name", "?nation"], [(O, ":orders/o_custkey", C), (C, ":customer/c_name", "?name"), (C, ":customer/c_nationkey", N), (N, ":nation/n_name", "?nation")], ["o", "customer", "nation"])
simple("theta_join", "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier", ["?a", "?b"], [("?a", ":supplier/s_nationkey", N), ("?b", ":supplier/s_nationkey", N), ("?a", ":supplier/s_acctbal", "?x"), ("?b", ":supplier/s_acctbal", "?y"), compare("<", "?x", "?y")], ["a", "b"])
simple("cross_product", "SELECT DISTINCT a.r_name AS a, b.r_name AS b FROM region a, region b", "region", ["?a", "?b"], [("?x", ":region/r_name", "?a"), ("?y", ":region/r_name", "?b")], ["a", "b"])
simple("value_join", "SELECT DISTINCT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'MACHINERY' AND s_acctbal > 5000", "supplier customer", ["?s", C], [("?s", ":supplier/s_nationkey", N), (C, ":customer/c_nationkey", N), (C, ":customer/c_mktsegment", "MACHINERY"), ("?s", ":supplier/s_acctbal", "?b"), compare(">", "?b", 5000.0)], ["s", "c"])
simple("self_pattern", "SELECT DISTINCT n_nationkey::BIGINT AS n FROM nation WHERE n_regionkey = n_nationkey", "nation", [N], [(N, ":nation/n_regionkey", N)], ["n"])
simple("semi_join", "SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "customer orders", ["?name"], [(C, ":customer/c_name", "?name"), ("_", ":orders/o_custkey", C)], ["name"])
simple("cross_type_join", "SELECT DISTINCT p_partkey AS p, l_quantity AS q FROM part JOIN lineitem ON p_size = l_quantity", "part lineitem", ["?p", "?z"], [("?p", ":part/p_size", "?z"), ("?l", ":lineitem/l_quantity", "?z")], ["p", "q"])
simple("cross_type_join_all", "SELECT DISTINCT p_partkey AS p, l_quantity AS q FROM part JOIN lineitem ON p_size = l_quantity", "part lineitem", ["?p", "?z"], [("?p", ":part/p_size", "?z"), ("?l", ":lineitem/l_quantity", "?z")], ["p", "q"])
for _op, _name in ((">", "gt"), ("<", "lt"), (">=", "ge"), ("<=", "le"), ("=", "eq"), ("!=", "ne")):
    simple(f"filter_{_name}", f"SELECT DISTINCT p_partkey AS p, p_size::BIGINT AS size FROM part WHERE p_size {_op.replace('!=', '<>')} 25", "part", ["?p", "?s"], [("?p", ":part/p_size", "?s"), compare(_op, "?s", 25)], ["p", "size"])
simple("filter_chain", "SELECT DISTINCT p_partkey AS p FROM part WHERE 10 < p_size AND p_size <= 20", "part", ["?p"], [("?p", ":part/p_size", "?s"), compare("<", 10, "?s"), compare(">=", 20, "?s")], ["p"])
simple("in_param", "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_custkey = 5 OR (o_custkey = 5 AND o_totalprice > 0)", "orders", [O], [(O, ":orders/o_custkey", "?who"), (O, ":orders/o_totalprice", "?p"), compare(">", "?p", "?least")], ["o"], params={"?who": 5, "?least": 0.0})
simple("chained_compare", "SELECT DISTINCT a.p_partkey AS a FROM part a WHERE 5 < a.p_size AND a.p_size < 40", "part", ["?a"], [("?a", ":part/p_size", "?s"), compare("<", 5, "?s", 40)], ["a"])

# negation and disjunction

simple("not_simple", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer orders", [C], [(C, ":customer/c_name", "_"), not_((O, ":orders/o_custkey", C))], ["c"])
simple("not_pair", "SELECT DISTINCT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 3000)", "nation supplier", ["?n"], [("?k", ":nation/n_name", "?n"), not_(("?s", ":supplier/s_nationkey", "?k"), ("?s", ":supplier/s_acctbal", "?b"), compare(">", "?b", 3000.0))], ["n"])
simple("not_multi", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000)", "customer orders", [C], [(C, ":customer/c_name", "_"), not_((O, ":orders/o_custkey", C), (O, ":orders/o_orderstatus", "F"), (O, ":orders/o_totalprice", "?p"), compare(">", "?p", 100000.0))], ["c"])
simple("not_nested", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey AND p.o_orderstatus = 'F'))", "customer orders", [C], [(C, ":customer/c_name", "_"), not_((O, ":orders/o_custkey", C), not_((O, ":orders/o_orderstatus", "F")))], ["c"])
simple("not_outer_compare", "SELECT DISTINCT a.s_suppkey AS s FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal)", "supplier", ["?s"], [("?s", ":supplier/s_nationkey", N), ("?s", ":supplier/s_acctbal", "?x"), not_(("?t", ":supplier/s_nationkey", N), ("?t", ":supplier/s_acctbal", "?y"), compare(">", "?y", "?x"))], ["s"])
simple("not_global", "SELECT DISTINCT r_name AS name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'ATLANTIS')", "region nation", ["?name"], [("?r", ":region/r_name", "?name"), not_((N, ":nation/n_name", "ATLANTIS"))], ["name"])
simple("or_simple", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY'", "customer", [C], [or_((C, ":customer/c_mktsegment", "BUILDING"), (C, ":customer/c_mktsegment", "MACHINERY"))], ["c"])
simple("or_refs", "SELECT DISTINCT n_name AS name, k AS id FROM nation JOIN (SELECT c_nationkey AS nk, c_custkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal > 9000) ON nk = n_nationkey", "nation customer supplier", ["?name", "?k"], [(N, ":nation/n_name", "?name"), or_([("?k", ":customer/c_nationkey", N), ("?k", ":customer/c_acctbal", "?b"), compare(">", "?b", 9000.0)], [("?k", ":supplier/s_nationkey", N), ("?k", ":supplier/s_acctbal", "?d"), compare(">", "?d", 9000.0)])], ["name", "id"])
simple("or_nested_not", "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size < 5 OR (p_size > 45 AND p_brand <> 'Brand#11')", "part", ["?p"], [or_([("?p", ":part/p_size", "?s"), compare("<", "?s", 5)], [("?p", ":part/p_size", "?s"), compare(">", "?s", 45), not_(("?p", ":part/p_brand", "Brand#11"))])], ["p"])

# aggregates, order

_ITEMS = [("?l", ":lineitem/l_returnflag", "?f"), ("?l", ":lineitem/l_quantity", "?q")]
for _agg, _sql in (("count", "count(l_quantity)"), ("sum", "sum(l_quantity)"), ("avg", "avg(l_quantity)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)")):
    simple(f"agg_{_agg}", f"SELECT l_returnflag AS flag, {_sql} AS value FROM lineitem GROUP BY 1", "lineitem", ["?f", (_agg, "?q")], _ITEMS, ["flag", "value"])
simple("agg_count_distinct", "SELECT l_returnflag AS flag, count(DISTINCT l_suppkey) AS value FROM lineitem GROUP BY 1", "lineitem", ["?f", ("count-distinct", "?s")], [("?l", ":lineitem/l_returnflag", "?f"), ("?l", ":lineitem/l_suppkey", "?s")], ["flag", "value"])
simple("agg_global", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders", "orders", [("count", O), ("max", "?p")], [(O, ":orders/o_totalprice", "?p")], ["n", "top"])
simple("agg_multi", "SELECT count(o_orderkey) AS n, c_mktsegment AS segment, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2", "orders customer", [("count", O), "?s", ("sum", "?p"), ("avg", "?p")], [(O, ":orders/o_custkey", C), (O, ":orders/o_totalprice", "?p"), (C, ":customer/c_mktsegment", "?s")], ["n", "segment", "total", "mean"])
simple("agg_join", "SELECT c_name AS name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "orders customer", ["?name", ("count", O)], [(C, ":customer/c_name", "?name"), (O, ":orders/o_custkey", C)], ["name", "orders"])
simple("order_by", "SELECT DISTINCT s_suppkey AS s, s_acctbal AS bal FROM supplier ORDER BY bal DESC, s", "supplier", ["?s", "?b"], [("?s", ":supplier/s_acctbal", "?b")], ["s", "bal"], order=[("?b", "desc"), "?s"])
simple("order_by_limit", "SELECT DISTINCT s_suppkey AS s, s_acctbal AS bal FROM supplier ORDER BY bal DESC, s LIMIT 20", "supplier", ["?s", "?b"], [("?s", ":supplier/s_acctbal", "?b")], ["s", "bal"], order=[("?b", "desc"), "?s"], limit=20)
simple("order_by_aggregate", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, segment", "customer", ["?s", ("count", C)], [(C, ":customer/c_mktsegment", "?s")], ["segment", "n"], order=[("count", "desc"), "?s"])
simple("order_by_hidden", "SELECT s_name AS name FROM supplier GROUP BY s_name ORDER BY max(s_acctbal) DESC, name", "supplier", ["?name"], [("?s", ":supplier/s_name", "?name"), ("?s", ":supplier/s_acctbal", "?b")], ["name"], order=[("?b", "desc"), "?name"])
simple("order_by_offset", "SELECT DISTINCT p_partkey AS p FROM part ORDER BY p LIMIT 10 OFFSET 5", "part", ["?p"], [("?p", ":part/p_name", "_")], ["p"], order=["?p"], limit=10, offset=5)
simple("var_attribute", "SELECT DISTINCT a, n FROM (SELECT ':region/r_regionkey' AS a, count(*) AS n FROM region UNION ALL SELECT ':region/r_name', count(*) FROM region)", "region", ["?a", ("count", "?e")], [("?e", "?a", "_")], ["a", "n"])
simple("free_value_join", "SELECT DISTINCT n_nationkey::BIGINT AS n, p_size::BIGINT AS size, p_partkey AS p FROM nation JOIN part ON p_size = n_regionkey", "nation part", [N, "?v", "?p"], [(N, "?a", "?v"), ("?p", ":part/p_size", "?v"), (N, ":nation/n_regionkey", "?v")], ["n", "size", "p"])
simple("attribute_of_value", "SELECT ':nation/n_name' AS a, CAST(n_nationkey AS VARCHAR) AS e FROM nation WHERE n_name = 'NATION_3'", "nation", ["?a", "?e"], [("?e", "?a", "NATION_3")], ["a", "e"])


# functions


def _functions() -> Functions:
    known = Functions()
    known.register("is-even", lambda x: x % 2 == 0, n_args=1)
    known.register_pandas("is-odd", lambda x: x % 2 == 1, n_args=1)
    known.register_column("one", lambda: F.lit(1), n_args=0)
    known.register_column("is-big", lambda x: x > 30, n_args=1)
    known.register_column("near", lambda x, y: F.abs(x - y) < 1000.0, n_args=2)
    known.register_column("discounted", lambda price, rate: price * (1 - rate))
    return known


simple("udf_pred", "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size % 2 = 0", "part", ["?p"], [("?p", ":part/p_size", "?s"), call("is-even", "?s")], ["p"], functions=_functions())
simple("udf_pandas", "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size % 2 = 1", "part", ["?p"], [("?p", ":part/p_size", "?s"), call("is-odd", "?s")], ["p"], functions=_functions())
simple("udf_no_args", "SELECT DISTINCT p_partkey AS p, 1 AS one FROM part", "part", ["?p", "?one"], [("?p", ":part/p_name", "_"), call("one", out="?one")], ["p", "one"], functions=_functions())
simple("udf_multi", "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size % 2 = 0 AND p_size > 30", "part", ["?p"], [("?p", ":part/p_size", "?s"), call("is-even", "?s"), call("is-big", "?s")], ["p"], functions=_functions())
simple("udf_two_args", "SELECT DISTINCT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE abs(s_acctbal - c_acctbal) < 1000", "supplier customer", ["?s", C], [("?s", ":supplier/s_nationkey", N), (C, ":customer/c_nationkey", N), ("?s", ":supplier/s_acctbal", "?x"), (C, ":customer/c_acctbal", "?y"), call("near", "?x", "?y")], ["s", "c"], functions=_functions())
simple("udf_bind", "SELECT l_returnflag AS flag, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1", "lineitem", ["?f", ("sum", "?r")], [("?l", ":lineitem/l_returnflag", "?f"), ("?l", ":lineitem/l_extendedprice", "?p"), ("?l", ":lineitem/l_discount", "?d"), call("discounted", "?p", "?d", out="?r")], ["flag", "revenue"], functions=_functions())

# recursion

_TREE = "WITH RECURSIVE edge AS (SELECT p_partkey AS k, p_partkey // 2 AS p FROM part WHERE p_partkey // 2 > 0), up AS (SELECT k, p FROM edge UNION SELECT up.k, edge.p FROM up JOIN edge ON up.p = edge.k) "
_RING = "WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), edge AS (SELECT s_suppkey AS k, (s_suppkey * 7 + 1) % n AS p FROM supplier, n), up AS (SELECT k, p FROM edge UNION SELECT up.k, edge.p FROM up JOIN edge ON up.p = edge.k) "


def _tree(spark: SparkSession, sf_dir: str) -> WideTables:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("p_partkey div 2").alias("parent"), "p_size")
    return WideTables({"part": (part.withColumn("parent", F.when(F.col("parent") > 0, F.col("parent"))), "p_partkey")})


def _ring(spark: SparkSession, sf_dir: str) -> WideTables:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    return WideTables({"s": (s.join(F.broadcast(n)).select("s_suppkey", ((F.col("s_suppkey") * 7 + 1) % F.col("n")).alias("next")), "s_suppkey")})


UP = [Defined("up", ("?x", "?y"), (("?x", ":part/parent", "?y"),)), Defined("up", ("?x", "?z"), (("?x", ":part/parent", "?y"), rule("up", "?y", "?z")))]


@registered(_TREE + "SELECT k, p FROM up")
def rule_closure(spark, sf_dir):
    return evaluate(UP, _tree(spark, sf_dir))["up"].toDF("k", "p")


@registered(_RING + "SELECT k, p FROM up")
def rule_cyclic(spark, sf_dir):
    rules = [Defined("go", ("?x", "?y"), (("?x", ":s/next", "?y"),)), Defined("go", ("?x", "?z"), (rule("go", "?x", "?y"), ("?y", ":s/next", "?z")))]
    return evaluate(rules, _ring(spark, sf_dir))["go"].toDF("k", "p")


@registered(_TREE + "SELECT k, p FROM up")
def rule_nonlinear(spark, sf_dir):
    rules = [UP[0], Defined("up", ("?x", "?z"), (rule("up", "?x", "?y"), rule("up", "?y", "?z")))]
    return evaluate(rules, _tree(spark, sf_dir))["up"].toDF("k", "p")


@registered("WITH RECURSIVE edge AS (SELECT p_partkey AS k, p_partkey // 2 AS p FROM part WHERE p_partkey // 2 > 0), w AS (SELECT k, p, 1 AS odd FROM edge UNION SELECT w.k, edge.p, 1 - odd FROM w JOIN edge ON w.p = edge.k) SELECT DISTINCT k, p FROM w WHERE odd = 0")
def rule_mutual(spark, sf_dir):
    rules = [UP[0], Defined("odd", ("?x", "?y"), (("?x", ":part/parent", "?y"),)), Defined("even", ("?x", "?z"), (("?x", ":part/parent", "?y"), rule("odd", "?y", "?z"))), Defined("odd", ("?x", "?z"), (("?x", ":part/parent", "?y"), rule("even", "?y", "?z")))]
    return evaluate(rules[1:], _tree(spark, sf_dir))["even"].toDF("k", "p")


@registered(_TREE + "SELECT up.p AS p, count(*) AS small FROM up JOIN part ON p_partkey = k WHERE p_size < 10 GROUP BY 1")
def rule_in_query(spark, sf_dir):
    source = _tree(spark, sf_dir)
    q = Query(source, ["?y", ("count", "?x")], [rule("up", "?x", "?y"), ("?x", ":part/p_size", "?s"), compare("<", "?s", 10)], rules=evaluate(UP, source))
    return q.run().toDF("p", "small")


@registered(_TREE + "SELECT p_partkey AS p FROM part WHERE p_partkey NOT IN (SELECT k FROM up WHERE p = 2)")
def rule_negated(spark, sf_dir):
    rules = [*UP, Defined("outside", ("?x",), (("?x", ":part/p_size", "_"), not_(rule("up", "?x", 2))))]
    return evaluate(rules, _tree(spark, sf_dir))["outside"].toDF("p")


# the log: every event is a transaction about its user

LAST, SEEN = Attribute(":user/last-type", ValueType.STRING), Attribute(":user/seen", ValueType.STRING, Cardinality.MANY)
_LOG = """WITH ev AS (SELECT event_id + 1 AS tx, user_id AS e, event_type AS v, epoch_ms(ts) AS ms FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY tx DESC) AS r FROM ev WHERE {0}) WHERE r = 1)"""


def event_log(spark: SparkSession, sf_dir: str) -> FactLog:
    """:user/last-type is the type of the user's last event; :user/seen holds all types but error, until a purchase retracts view."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    base = ev.select(F.col("user_id").alias("e"), "event_type", (F.col("event_id") + 1).alias("tx"), ms.alias("tx_time"), ms.alias("valid_from"))
    text = F.col("event_type")
    make = lambda df, a, v, op, added: df.select("e", F.lit(a).alias("a"), *value_of(ValueType.STRING, v), "tx", F.lit(op).cast("bigint").alias("op"), F.lit(added).alias("added"), "tx_time", "valid_from")
    rows = make(base, LAST.ident, text, 0, True).unionByName(make(base.filter("event_type != 'error'"), SEEN.ident, text, 1, True))
    rows = rows.unionByName(make(base.filter("event_type = 'purchase'"), SEEN.ident, F.lit("view"), 2, False))
    return FactLog.empty(spark, Registry(LAST, SEEN)).with_events(rows)


_STATE = """, all_ev AS (SELECT e, v, tx, 1 AS added FROM ev WHERE v <> 'error' AND {0} UNION ALL SELECT e, 'view', tx, 0 FROM ev WHERE v = 'purchase' AND {0}),
now_seen AS (SELECT e, v, tx FROM (SELECT *, row_number() OVER (PARTITION BY e, v ORDER BY tx DESC, added) AS r FROM all_ev) WHERE r = 1 AND added = 1) """


def _until(log: FactLog, tenths: int) -> FactLog:
    """The state as of the transaction at so many tenths of all."""
    return log.as_of(log.times().agg(F.max("tx")).first()[0] * tenths // 10)


def _sql(select: str, bound: str = "true") -> str:
    return (_LOG + _STATE).format(bound) + select


@registered(_sql("SELECT e, v AS kind FROM last"))
def cardone_current(spark, sf_dir):
    return Query(event_log(spark, sf_dir), ["?u", "?t"], [("?u", ":user/last-type", "?t")]).run().toDF("e", "kind")


@registered(_sql("SELECT e, v AS kind FROM now_seen"))
def retraction_current(spark, sf_dir):
    return Query(event_log(spark, sf_dir), ["?u", "?t"], [("?u", ":user/seen", "?t")]).run().toDF("e", "kind")


@registered(_sql("SELECT e, v AS kind, tx FROM last"))
def tx_binding(spark, sf_dir):
    return Query(event_log(spark, sf_dir), ["?u", "?t", "?tx"], [("?u", ":user/last-type", "?t", "?tx")]).run().toDF("e", "kind", "tx")


@registered(_sql("SELECT e, v AS kind FROM last", "tx <= (SELECT max(tx) * 5 // 10 FROM ev)"))
def as_of(spark, sf_dir):
    return Query(_until(event_log(spark, sf_dir), 5), ["?u", "?t"], [("?u", ":user/last-type", "?t")]).run().toDF("e", "kind")


@registered(_sql("SELECT e, v AS kind FROM now_seen", "tx <= (SELECT max(tx) * 7 // 10 FROM ev)"))
def reassert_as_of(spark, sf_dir):
    return Query(_until(event_log(spark, sf_dir), 7), ["?u", "?t"], [("?u", ":user/seen", "?t")]).run().toDF("e", "kind")


@registered(_sql("SELECT e, v AS kind FROM last", "tx <= (SELECT max(tx) FROM ev WHERE ms <= (SELECT (min(ms) + max(ms)) // 2 FROM ev))"))
def as_of_tx_time(spark, sf_dir):
    log = event_log(spark, sf_dir)
    lo, hi = log.history.agg(F.min("tx_time"), F.max("tx_time")).first()
    return Query(log.as_of_time((lo + hi) // 2), ["?u", "?t"], [("?u", ":user/last-type", "?t")]).run().toDF("e", "kind")


@registered(_sql("SELECT DISTINCT e, v AS kind FROM ev WHERE ms <= (SELECT (min(ms) + max(ms)) // 2 FROM ev)"))
def as_of_valid_time(spark, sf_dir):
    log = event_log(spark, sf_dir)
    lo, hi = log.history.agg(F.min("tx_time"), F.max("tx_time")).first()
    return Query(log.valid_at((lo + hi) // 2), ["?u", "?t"], [("?u", ":user/last-type", "?t")]).run().toDF("e", "kind")


@registered(_sql("SELECT last.e, last.v AS last, now_seen.v AS seen FROM last JOIN now_seen ON last.e = now_seen.e AND last.v <> now_seen.v", "tx <= (SELECT max(tx) * 8 // 10 FROM ev)"))
def as_of_join(spark, sf_dir):
    where = [("?u", ":user/last-type", "?a"), ("?u", ":user/seen", "?b"), compare("!=", "?a", "?b")]
    return Query(_until(event_log(spark, sf_dir), 8), ["?u", "?a", "?b"], where).run().toDF("e", "last", "seen")


@registered(_sql("SELECT e FROM last WHERE e NOT IN (SELECT e FROM now_seen WHERE v = 'view')", "tx <= (SELECT max(tx) * 6 // 10 FROM ev)"))
def as_of_not(spark, sf_dir):
    return Query(_until(event_log(spark, sf_dir), 6), ["?u"], [("?u", ":user/last-type", "_"), not_(("?u", ":user/seen", "view"))]).run().toDF("e")


@registered(_sql("SELECT count(*) AS facts FROM (SELECT e FROM last UNION ALL SELECT e FROM now_seen)"))
def history_facts(spark, sf_dir):
    return event_log(spark, sf_dir).facts().agg(F.count(F.lit(1)).alias("facts"))


@registered(_sql("SELECT last.e AS db_id, last.v AS last, s.seen FROM last LEFT JOIN (SELECT e, string_agg(v, ',' ORDER BY v) AS seen FROM now_seen GROUP BY e) s ON s.e = last.e"))
def pull_many(spark, sf_dir):
    log = event_log(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    out = pull(log, users, [Spec(":user/last-type", "last"), Spec(":user/seen", "seen"), Spec(":no/such")])
    return out.select("db_id", "last", F.array_join("seen", ",").alias("seen"))


# tables as a log, for nested shapes and transactions


def customer_log(spark: SparkSession, sf_dir: str) -> FactLog:
    """Customers refer to nations, nations to regions; ids lie apart by table."""
    text, ref = ValueType.STRING, ValueType.REF
    registry = Registry(Attribute(":c/name", text, identity=True), Attribute(":c/nation", ref), Attribute(":n/name", text), Attribute(":n/region", ref), Attribute(":r/name", text))
    nation, region = 1 << 40, 2 << 40
    sources = [("customer", "c_custkey", 0, (":c/name", F.col("c_name")), (":c/nation", F.col("c_nationkey") + nation)), ("nation", "n_nationkey", nation, (":n/name", F.col("n_name")), (":n/region", F.col("n_regionkey") + region)), ("region", "r_regionkey", region, (":r/name", F.col("r_name")))]
    rows = None
    for table, key, base, *attributes in sources:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        for a, v in attributes:
            one = df.select((F.col(key) + base).cast("bigint").alias("e"), F.lit(a).alias("a"), *value_of(registry[a].type, v), F.lit(1).cast("bigint").alias("tx"), F.lit(0).cast("bigint").alias("op"), F.lit(True).alias("added"), F.lit(0).cast("bigint").alias("tx_time"), F.lit(0).cast("bigint").alias("valid_from"))
            rows = one if rows is None else rows.unionByName(one)
    return FactLog.empty(spark, registry).with_events(rows)


@registered("SELECT c_custkey AS db_id, c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def pull_nested(spark, sf_dir):
    shape = [Spec(":c/name", "name"), Spec(":c/nation", "nation", (Spec(":n/name", "name"), Spec(":n/region", "region", (Spec(":r/name", "name"),))))]
    out = pull(customer_log(spark, sf_dir), spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), shape)
    return out.select("db_id", "name", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


def _renamed(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """The customers of a market segment move to nation 0, named by their identity values; one that is new comes along."""
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_mktsegment = 'BUILDING'")
    extra = spark.createDataFrame([("Customer#new",)], "c_name string") if by == "upsert" else old.select("c_name").limit(0)
    names = old.select("c_name").unionByName(extra)
    entity = {"upsert": (F.lit(None), F.col("c_name"), F.lit(None), F.lit(None)), "lookup": (F.lit(None), F.lit(None), F.lit(":c/name"), F.col("c_name"))}[by]
    kinds = ("e bigint", "temp string", "lookup_a string", "lookup_v string")
    head = [c.cast(k.split()[1]).alias(k.split()[0]) for c, k in zip(entity, kinds)]
    rows = names.select(F.xxhash64("c_name").alias("seq"), *head, F.lit(":c/nation").alias("a"), *value_of(ValueType.REF, F.lit(1 << 40)), F.lit(False).alias("retract"))
    if by == "upsert":
        rows = rows.unionByName(names.select(F.xxhash64("c_name").alias("seq"), *head, F.lit(":c/name").alias("a"), *value_of(ValueType.STRING, F.col("c_name")), F.lit(False).alias("retract")))
    return rows.select(*[x.split()[0] for x in DATOMS.split(", ")])


_MOVED = "SELECT name, nation FROM (SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END::BIGINT AS nation FROM customer{0})"
_NATIONS = [("?c", ":c/name", "?name"), ("?c", ":c/nation", "?n")]


@registered(_MOVED.format(" UNION ALL SELECT 'Customer#new', 0"))
def identity_upsert(spark, sf_dir):
    log = transact(customer_log(spark, sf_dir).checkpointed(), _renamed(spark, sf_dir, "upsert"), tx_time=1).log
    return Query(log, ["?name", "?n"], _NATIONS).run().toDF("name", "n").select("name", (F.col("n") - (1 << 40)).alias("nation"))


@registered(_MOVED.format(""))
def lookup_ref(spark, sf_dir):
    log = transact(customer_log(spark, sf_dir).checkpointed(), _renamed(spark, sf_dir, "lookup"), tx_time=1).log
    return Query(log, ["?name", "?n"], _NATIONS).run().toDF("name", "n").select("name", (F.col("n") - (1 << 40)).alias("nation"))


@registered("SELECT c_name AS name, c_nationkey::BIGINT AS nation FROM customer")
def transact_as_of(spark, sf_dir):
    """The state before a transaction is still there after it."""
    log = transact(customer_log(spark, sf_dir).checkpointed(), _renamed(spark, sf_dir, "upsert"), tx_time=1).log
    return Query(log.as_of(1), ["?name", "?n"], _NATIONS).run().toDF("name", "n").select("name", (F.col("n") - (1 << 40)).alias("nation"))


@registered("SELECT count(*) FILTER (WHERE added) AS asserted, count(*) FILTER (WHERE NOT added) AS retracted FROM (SELECT true AS added FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT true FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT false FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT false FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT true UNION ALL SELECT true)")
def transact_datoms(spark, sf_dir):
    """What a transaction wrote: a name and a nation for each customer, and the retractions of what they had."""
    done = transact(customer_log(spark, sf_dir).checkpointed(), _renamed(spark, sf_dir, "upsert"), tx_time=1)
    return done.datoms.agg(F.count_if("added").alias("asserted"), F.count_if(~F.col("added")).alias("retracted"))


@registered("SELECT o_custkey AS c, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'")
def same_tx_events(spark, sf_dir):
    """All orders of a customer in one transaction, in order: each sets its status; an F is asserted and retracted again."""
    registry = Registry(Attribute(":c/status", ValueType.STRING))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    make = lambda df, step, added: df.select(F.col("o_custkey").cast("bigint").alias("e"), F.lit(":c/status").alias("a"), *value_of(ValueType.STRING, F.col("o_orderstatus")), F.lit(1).cast("bigint").alias("tx"), (F.col("o_orderkey") * 2 + step).cast("bigint").alias("op"), F.lit(added).alias("added"), F.lit(0).cast("bigint").alias("tx_time"), F.lit(0).cast("bigint").alias("valid_from"))
    log = FactLog.empty(spark, registry).with_events(make(o, 0, True).unionByName(make(o.filter("o_orderstatus = 'F'"), 1, False)))
    return Query(log, ["?c", "?s"], [("?c", ":c/status", "?s")]).run().toDF("c", "status")


@registered(_sql("SELECT e, v AS kind FROM last", "ms <= (SELECT (min(ms) + max(ms)) // 2 FROM ev)").replace("ORDER BY tx DESC) AS r FROM ev WHERE", "ORDER BY ms DESC, tx DESC) AS r FROM ev WHERE"))
def valid_intervals(spark, sf_dir):
    """The type that was valid at a time: each assertion ends where the user's next one begins."""
    log = event_log(spark, sf_dir)
    lo, hi = log.history.agg(F.min("tx_time"), F.max("tx_time")).first()
    return Query(log.valid_at((lo + hi) // 2, intervals=True), ["?u", "?t"], [("?u", ":user/last-type", "?t")]).run().toDF("e", "kind")


@registered(_sql("SELECT last.e AS db_id, last.v AS last, s.seen FROM last LEFT JOIN (SELECT e, string_agg(v, ',' ORDER BY v) AS seen FROM now_seen GROUP BY e) s ON s.e = last.e", "tx <= (SELECT max(tx) // 2 FROM ev)"))
def pull_as_of(spark, sf_dir):
    log = _until(event_log(spark, sf_dir), 5)
    users = log.history.filter(F.col("tx") <= log.tx).select("e").distinct()
    out = pull(log, users, [Spec(":user/last-type", "last"), Spec(":user/seen", "seen")])
    return out.select("db_id", "last", F.array_join("seen", ",").alias("seen"))


@registered("SELECT c_custkey AS db_id, c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def pull_wildcard(spark, sf_dir):
    """All attributes, through two references."""
    out = pull(customer_log(spark, sf_dir), spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), levels=3)
    nation = F.col("`:c/nation`")
    return out.select("db_id", F.col("`:c/name`").alias("name"), nation[":n/name"].alias("nation"), nation[":n/region"][":r/name"].alias("region"))


#: What entry() runs.
FLAGSHIP = "agg_join"
