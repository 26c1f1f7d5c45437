"""Changes and checks of tables, on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import changes as ch
from eventloom.operators.ids import Sequencer, assign_ids
from eventloom.plans.registry import query, table

c = F.col

# The changed rows come from the tables: orders give the newest balance of a customer.
_SOURCE = """SELECT o_custkey + 500 AS c_custkey, max(o_totalprice) AS c_acctbal, 'ONLINE' AS c_mktsegment FROM orders GROUP BY 1"""


def _source(spark, sf):
    return (table(spark, sf, "orders").groupBy((c("o_custkey") + 500).alias("c_custkey"))
            .agg(F.max("o_totalprice").alias("c_acctbal")).withColumn("c_mktsegment", F.lit("ONLINE")))


@query("insert_select_with_defaults", """SELECT * FROM supplier UNION ALL
SELECT c_custkey + 1000000, c_name, coalesce(nullif(c_nationkey, 3), 99), CAST(0 AS DOUBLE) FROM customer WHERE c_acctbal > 9000""")
def _(spark, sf):
    rows = table(spark, sf, "customer").filter("c_acctbal > 9000").select(
        (c("c_custkey") + 1000000).alias("s_suppkey"), c("c_name").alias("s_name"), F.nullif("c_nationkey", F.lit(3)).alias("s_nationkey"))
    return ch.insert(table(spark, sf, "supplier"), rows, {"s_acctbal": F.lit(0), "s_nationkey": F.lit(99)}, null_to_default=["s_nationkey"])


@query("insert_computed_column", """SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL
SELECT CAST(s_suppkey + 100 AS INTEGER), 'S-' || s_suppkey, CAST((s_suppkey + 100) % 5 AS INTEGER) FROM supplier""")
def _(spark, sf):
    rows = table(spark, sf, "supplier").select((c("s_suppkey") + 100).alias("n_nationkey"), F.concat(F.lit("S-"), c("s_suppkey")).alias("n_name"))
    return ch.insert(table(spark, sf, "nation"), rows, computed={"n_regionkey": c("n_nationkey") % 5})


@query("upsert_keep_unlisted_columns", f"""SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, t.c_name, t.c_nationkey,
coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, coalesce(s.c_mktsegment, t.c_mktsegment) AS c_mktsegment
FROM customer t FULL JOIN ({_SOURCE}) s ON t.c_custkey = s.c_custkey""")
def _(spark, sf):
    return ch.upsert(table(spark, sf, "customer"), _source(spark, sf), ["c_custkey"])


@query("insert_on_duplicate_key_update", f"""SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(t.c_name, 'new') AS c_name, t.c_nationkey,
CASE WHEN t.c_custkey IS NULL THEN s.c_acctbal WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE t.c_acctbal + s.c_acctbal END AS c_acctbal,
coalesce(t.c_mktsegment, s.c_mktsegment) AS c_mktsegment FROM customer t FULL JOIN ({_SOURCE}) s ON t.c_custkey = s.c_custkey""")
def _(spark, sf):
    return ch.upsert(table(spark, sf, "customer"), _source(spark, sf), ["c_custkey"],
                     {"c_acctbal": lambda old, new: old("c_acctbal") + new("c_acctbal")}, {"c_name": F.lit("new")})


@query("upsert_repeated_keys", """SELECT coalesce(t.c_custkey, s.k) AS c_custkey, t.c_name, t.c_nationkey, coalesce(s.v, t.c_acctbal) AS c_acctbal,
coalesce(s.p, t.c_mktsegment) AS c_mktsegment FROM customer t FULL JOIN
(SELECT o_custkey + 500 AS k, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS v, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p
FROM orders GROUP BY 1) s ON t.c_custkey = s.k""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select((c("o_custkey") + 500).alias("c_custkey"), c("o_totalprice").alias("c_acctbal"),
                                             c("o_orderpriority").alias("c_mktsegment"), "o_orderdate", "o_orderkey")
    return ch.upsert(table(spark, sf, "customer"), rows, ["c_custkey"], order=["o_orderdate", "o_orderkey"])


@query("insert_on_duplicate_key_update_in_turn", """SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NULL THEN t.v
WHEN t.k IS NULL THEN list_reduce(s.l, lambda a, b: (a * 3 + b) % 1000003) ELSE list_reduce(list_prepend(t.v, s.l), lambda a, b: (a * 3 + b) % 1000003) END AS v FROM
(SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer) t FULL JOIN
(SELECT o_custkey + 500 AS k, list(CAST(o_orderkey AS BIGINT) ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY 1) s ON t.k = s.k""")
def _(spark, sf):
    t = table(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_nationkey").cast("bigint").alias("v"))
    s = table(spark, sf, "orders").select((c("o_custkey") + 500).alias("k"), c("o_orderkey").cast("bigint").alias("v"), "o_orderdate")
    return ch.upsert(t, s, ["k"], {"v": lambda old, new: (old("v") * 3 + new("v")) % 1000003}, order=["o_orderdate", "v"])


_NULLED = "SELECT nullif(s_nationkey, 5) AS s_nationkey, count(*) AS n FROM supplier GROUP BY 1"


@query("upsert_null_keys_never_match", f"""SELECT coalesce(t.k, s.k) AS k, coalesce(s.n, t.n) AS n FROM
(SELECT nullif(n_nationkey, 7) AS k, CAST(n_regionkey AS BIGINT) AS n FROM nation) t FULL JOIN
(SELECT s_nationkey AS k, n FROM ({_NULLED})) s ON t.k = s.k""")
def _(spark, sf):
    t = table(spark, sf, "nation").select(F.nullif("n_nationkey", F.lit(7)).alias("k"), c("n_regionkey").cast("bigint").alias("n"))
    s = table(spark, sf, "supplier").groupBy(F.nullif("s_nationkey", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return ch.upsert(t, s, ["k"])


@query("replace_into", """SELECT coalesce(r.k, n_nationkey) AS n_nationkey, coalesce(r.name, n_name) AS n_name, coalesce(r.region, n_regionkey) AS n_regionkey
FROM nation FULL JOIN (SELECT CAST(s_suppkey AS INTEGER) AS k, s_name AS name, s_nationkey % 5 AS region FROM supplier WHERE s_suppkey < 40) r ON r.k = n_nationkey""")
def _(spark, sf):
    rows = table(spark, sf, "supplier").filter("s_suppkey < 40").select(
        c("s_suppkey").cast("int").alias("n_nationkey"), c("s_name").alias("n_name"), (c("s_nationkey") % 5).alias("n_regionkey"))
    return ch.replace_into(table(spark, sf, "nation"), rows, ["n_nationkey"])


@query("update_where", """SELECT p_partkey, p_name, CASE WHEN p_size > 30 THEN 'Bulk' ELSE p_brand END AS p_brand, p_type,
CASE WHEN p_size > 30 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_size > 30 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part""")
def _(spark, sf):
    return ch.update(table(spark, sf, "part"), {"p_brand": F.lit("Bulk"), "p_size": c("p_size") + 1, "p_retailprice": c("p_retailprice") * 2}, c("p_size") > 30)


@query("update_first_rows", """SELECT o_orderkey, CASE WHEN r <= 200 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM
(SELECT *, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) END AS r FROM orders)""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ch.update(orders, {"o_orderstatus": F.lit("X")}, c("o_orderstatus") == "F", limit=200, order=["o_orderkey"])


@query("delete_where", "SELECT p_partkey FROM part WHERE NOT coalesce(nullif(p_size, 10) > 20, false)")
def _(spark, sf):
    return ch.delete(table(spark, sf, "part"), F.nullif("p_size", F.lit(10)) > 20).select("p_partkey")


@query("delete_first_rows", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN
(SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 500)""")
def _(spark, sf):
    return ch.delete(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), c("o_totalprice") > 100000, 500, ["o_orderkey"]).select("o_orderkey")


@query("truncate_table", "SELECT * FROM region WHERE false")
def _(spark, sf):
    return ch.truncate(table(spark, sf, "region"))


@query("alter_columns", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name, s_nationkey, s_acctbal > 0 AS solvent FROM supplier")
def _(spark, sf):
    return ch.alter(table(spark, sf, "supplier"), add={"solvent": c("s_acctbal") > 0}, drop=["s_acctbal"], rename={"s_suppkey": "id"}, retype={"s_suppkey": "string"})


@query("check_unique", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return ch.violations_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_primary_key", """SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT nullif(p_size, 10) AS k FROM part) GROUP BY k HAVING count(*) > 1 OR k IS NULL""")
def _(spark, sf):
    return ch.violations_unique(table(spark, sf, "part").select(F.nullif("p_size", F.lit(10)).alias("k")), ["k"], primary=True)


@query("check_condition", "SELECT p_partkey FROM part WHERE NOT (nullif(p_size, 10) < 40)")
def _(spark, sf):
    return ch.violations_check(table(spark, sf, "part"), F.nullif("p_size", F.lit(10)) < 40).select("p_partkey")


@query("check_foreign_key", "SELECT l_orderkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def _(spark, sf):
    parents = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return ch.violations_fk(table(spark, sf, "lineitem"), ["l_orderkey"], parents, ["o_orderkey"]).select("l_orderkey", "l_partkey")


@query("cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0")
    return ch.cascade_delete(table(spark, sf, "orders"), ["o_custkey"], gone, ["c_custkey"]).select("o_orderkey")


_GONE = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@query("cascade_set_null", f"SELECT o_orderkey, CASE WHEN {_GONE} THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def _(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0")
    return ch.cascade_set(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], gone, ["c_custkey"])


@query("cascade_set_default", f"SELECT o_orderkey, CASE WHEN {_GONE} THEN -1 ELSE o_custkey END AS o_custkey FROM orders")
def _(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0")
    return ch.cascade_set(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], gone, ["c_custkey"], {"o_custkey": F.lit(-1)})


@query("assign_ids", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
CAST(100 + 5 * (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS BIGINT) AS id FROM lineitem""")
def _(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return assign_ids(table(spark, sf, "lineitem").select(*key), key, start=100, step=5)


@query("sequence_numbers", """SELECT c_custkey, CAST(10 + ((row_number() OVER (ORDER BY c_custkey) - 1) * 3) % 999 AS BIGINT) AS id FROM customer""")
def _(spark, sf):
    s = Sequencer(start=10, increment=3, minimum=10, maximum=1008, cycle=True)
    return s.next_values(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])
