"""Scans, predicates, joins, aggregates, windows, sorting and set operations on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import conditional as cond
from eventloom.functions import user
from eventloom.operators import aggregates as agg
from eventloom.operators import joins, sequence, sets, sql_relations
from eventloom.operators.ids import row_numbers
from eventloom.plans.mining import batch_sql, controller_sql
from eventloom.plans.registry import query, sql_query, table, views
from eventloom.session import scratch_path
from eventloom.sources import csv as csv_files
from eventloom.sources import files
from eventloom.sources.tables import range_over, unnest, values

# --- scans and sources ------------------------------------------------------------------

sql_query("table_scan", "orders", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'""")


@query("range_table_gap_fill", """
WITH r AS (SELECT unnest(range((SELECT min(o_custkey) FROM orders), (SELECT max(o_custkey) FROM orders) + 1)) AS x)
SELECT r.x AS "X", CAST(count(o_orderkey) AS BIGINT) AS orders FROM r LEFT JOIN orders ON o_custkey = r.x GROUP BY r.x""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    keys = range_over(orders, F.min("o_custkey"), F.max("o_custkey"))
    per_key = orders.groupBy(F.col("o_custkey").alias("X")).agg(F.count(F.lit(1)).alias("orders"))
    return keys.join(per_key, "X", "left").fillna(0, ["orders"])


@query("values_table", """
SELECT o_orderpriority, CAST(C2 AS BIGINT) AS weight, CAST(count(*) AS BIGINT) AS n FROM orders JOIN
(VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('5-LOW', 1)) v(C1, C2) ON o_orderpriority = C1 GROUP BY 1, 2""")
def _(spark, sf):
    v = values(spark, [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("5-LOW", 1)])
    return (table(spark, sf, "orders").join(v, F.col("o_orderpriority") == F.col("C1"))
            .groupBy("o_orderpriority", F.col("C2").alias("weight")).agg(F.count(F.lit(1)).alias("n")))


_WORDS = "string_split(p_name, ' ')"


@query("table_of_arrays", f"""
SELECT p_partkey, unnest({_WORDS}) AS w, unnest([p_brand]) AS b FROM part""")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.array("p_brand").alias("b"))
    return unnest(part, "w", "b")


@query("table_of_arrays_distinct", f"SELECT DISTINCT unnest({_WORDS}) AS w, unnest([p_type]) AS b FROM part")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.split("p_name", " ").alias("w"), F.array("p_type").alias("b"))
    return unnest(part, "w", "b", distinct=True)


@query("table_function", """
SELECT r_name, CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM region,
LATERAL (SELECT unnest(range(r_regionkey)) x) a, LATERAL (SELECT unnest(range(r_regionkey)) y) b""")
def _(spark, sf):
    user.register(spark)
    views(spark, sf, "region")
    return spark.sql("SELECT r_name, m.x, m.y FROM region, LATERAL matrix(r_regionkey) m")


@query("csv_round_trip", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer""")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    csv_files.write_csv(rows, path, "fieldSeparator=;")
    return csv_files.read_csv(spark, path, options="fieldSeparator=;")


@query("csv_write_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM documents")
def _(spark, sf):
    n = csv_files.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "text"), scratch_path(spark, "csv"))
    return spark.createDataFrame([(n,)], "n bigint")


@query("csv_empty_table", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE n_chars < 0")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    csv_files.write_csv(table(spark, sf, "documents").where("n_chars < 0").select("doc_id", "text"), path)
    return csv_files.read_csv(spark, path, keep_case=True)


@query("csv_quoted_text", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    csv_files.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return csv_files.read_csv(spark, path)


@query("file_write_and_read", "SELECT CAST(sum(strlen(n_name) + 1) AS BIGINT) AS chars FROM nation")
def _(spark, sf):
    path = scratch_path(spark, "files")
    files.file_write(table(spark, sf, "nation"), "n_name", path)
    read = files.file_read(spark, path + "/*.txt", "UTF-8")
    return read.agg(F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("create_table_as_sorted", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 20000")
def _(spark, sf):
    stored = files.create_table_as(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                                   scratch_path(spark, "ctas"), sorted_by=["o_totalprice"])
    return stored.filter(F.col("o_totalprice") < 20000)


@query("view_over_view", """SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10 GROUP BY 1""")
def _(spark, sf):
    views(spark, sf, "customer")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW solvent AS SELECT * FROM customer WHERE c_acctbal > 0")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW solvent_near AS SELECT * FROM solvent WHERE c_nationkey < 10")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM solvent_near GROUP BY c_mktsegment")


@query("relation_from_sql_text", batch_sql("SELECT l_suppkey c, l_linestatus l, epoch_us(l_shipdate) // 1000 t FROM lineitem", False))
def _(spark, sf):
    views(spark, sf, "lineitem")
    return sql_relations.directlyfollows(spark, "SELECT l_suppkey, l_linestatus, l_shipdate FROM lineitem")


@query("weak_relation_from_sql_text", batch_sql("SELECT l_suppkey c, l_returnflag l, epoch_us(l_shipdate) // 1000 t FROM lineitem", True))
def _(spark, sf):
    views(spark, sf, "lineitem")
    return sql_relations.follows(spark, "SELECT l_suppkey, l_returnflag, l_shipdate FROM lineitem")


@query("controller_from_sql_text", controller_sql("SELECT conv_id c, role l, turn t, role k FROM conversations"))
def _(spark, sf):
    views(spark, sf, "conversations")
    return sql_relations.controller(spark, "SELECT conv_id, role, turn FROM conversations")


# --- projection and predicates ----------------------------------------------------------

sql_query("projection_alias_wildcard", "nation", "SELECT n.*, n_name AS label, n_regionkey + 1 AS next_region FROM nation n")
sql_query("from_first", "nation region", "FROM nation JOIN region ON n_regionkey = r_regionkey SELECT n_name, r_name",
          "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql_query("where_filter", "lineitem", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_quantity < 5 AND l_discount BETWEEN 0.05 AND 0.07""")
_MAYBE = "(SELECT p_partkey, nullif(p_size, 10) s, nullif(p_brand, 'Brand#1') b FROM part) p"
sql_query("three_valued_logic", "part", f"""SELECT p_partkey, s > 20 AND b = 'Brand#2' AS both, s > 20 OR b = 'Brand#2' AS either,
NOT (s > 20) AS negated FROM {_MAYBE}""")
sql_query("comparisons", "part", f"""SELECT p_partkey, s = 5 AS eq, s <> 5 AS ne, s < 5 AS lt, s <= 5 AS le, s > 5 AS gt, s >= 5 AS ge FROM {_MAYBE}""")
sql_query("null_tests", "part", f"SELECT p_partkey, s IS NULL AS a, b IS NOT NULL AS c FROM {_MAYBE}")
sql_query("null_safe_comparison", "part", f"""SELECT p_partkey, s IS DISTINCT FROM 7 AS d, b IS NOT DISTINCT FROM nullif(p_brand2, 'Brand#1') AS same
FROM (SELECT p_partkey, nullif(p_size, 10) s, nullif(p_brand, 'Brand#1') b, p_brand p_brand2 FROM part) p""")
sql_query("between", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
sql_query("in_list_with_null", "part", f"SELECT p_partkey, s IN (1, 2, NULL) AS hit, s NOT IN (3, 4) AS out FROM {_MAYBE}")


@query("in_empty_list", f"SELECT p_partkey, false AS hit FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", cond.is_in(F.nullif("p_size", F.lit(10)), []).alias("hit"))


sql_query("in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")


@query("not_in_subquery_null_aware", f"""SELECT CAST(count(*) AS BIGINT) AS n,
CAST(count(CASE WHEN s NOT IN (SELECT nullif(l_linenumber, 3) FROM lineitem) THEN 1 END) AS BIGINT) AS hits FROM {_MAYBE}""")
def _(spark, sf):
    views(spark, sf, "part")
    values = table(spark, sf, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("v"))
    flagged = joins.with_not_in(spark.sql(f"SELECT * FROM {_MAYBE}"), F.col("s"), values, "out")
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("out")).alias("hits"))


@query("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return joins.not_in(c, F.col("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("not_in_three_answers", """SELECT p_partkey, nullif(p_size, 7) NOT IN (SELECT l_linenumber FROM lineitem) AS plain,
nullif(p_size, 7) NOT IN (SELECT nullif(l_linenumber, 3) FROM lineitem) AS with_null, nullif(p_size, 7) NOT IN (SELECT l_linenumber FROM lineitem WHERE l_linenumber < 0) AS none FROM part""")
def _(spark, sf):
    rows, lines, k = table(spark, sf, "part").select("p_partkey", "p_size"), table(spark, sf, "lineitem"), F.nullif("p_size", F.lit(7))
    for name, values in (("plain", lines.select("l_linenumber")), ("with_null", lines.select(F.nullif("l_linenumber", F.lit(3)))),
                         ("none", lines.where("l_linenumber < 0").select("l_linenumber"))):
        rows = joins.with_not_in(rows, k, values, name)
    return rows.drop("p_size")


def _quantified(name, op, quantifier):
    @query(name, f"SELECT c_custkey, c_acctbal {op} {quantifier} (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3) AS hit, "
                 f"c_acctbal {op} {quantifier} (SELECT s_acctbal FROM supplier WHERE s_nationkey < 0) AS none, "
                 f"c_acctbal {op} {quantifier} (SELECT nullif(s_nationkey, 5) FROM supplier) AS with_null FROM customer")
    def _(spark, sf):
        c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
        with_null = s.select(F.nullif("s_nationkey", F.lit(5)).alias("v"))
        one = lambda values, col: joins.quantified(F.col("c_acctbal"), op, quantifier, values, col)
        return c.select("c_custkey", one(s.filter("s_nationkey = 3"), "s_acctbal").alias("hit"),
                        one(s.filter("s_nationkey < 0"), "s_acctbal").alias("none"), one(with_null, "v").alias("with_null"))


_quantified("greater_than_all", ">", "ALL")
_quantified("less_than_any", "<", "ANY")
_quantified("at_least_any", ">=", "ANY")

sql_query("exists_correlated", "customer orders", """SELECT c_custkey FROM customer WHERE EXISTS
(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
sql_query("not_exists_correlated", "customer orders", """SELECT c_custkey FROM customer WHERE NOT EXISTS
(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
sql_query("scalar_subquery", "orders", """SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)""")
sql_query("scalar_subquery_correlated", "nation customer", """SELECT n_name, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS top FROM nation""")


@query("scalar_subquery_several_columns", """SELECT n_name, (SELECT min(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS lo,
(SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS hi FROM nation""")
def _(spark, sf):
    views(spark, sf, "nation", "customer")
    return spark.sql("""SELECT n_name, ends.lo, ends.hi FROM (SELECT n_name,
        (SELECT struct(min(c_acctbal) AS lo, max(c_acctbal) AS hi) FROM customer WHERE c_nationkey = n_nationkey) AS ends FROM nation)""")


sql_query("like_patterns", "part", r"""SELECT p_partkey, p_name LIKE 'small%' AS a, p_name LIKE '%g' AS b, p_name LIKE '%e_ %' AS c,
p_brand LIKE 'Brand#1!_' ESCAPE '!' OR p_brand LIKE 'Brand#1_' ESCAPE '!' AS d FROM part""")
sql_query("ilike", "part", "SELECT p_partkey FROM part WHERE p_type ILIKE 'eco%'")
sql_query("regexp_find", "part", "SELECT p_partkey, p_name RLIKE 'g$|^b' AS hit, NOT (p_name RLIKE '[aeiou]{2}') AS miss FROM part",
          "SELECT p_partkey, regexp_matches(p_name, 'g$|^b') AS hit, NOT regexp_matches(p_name, '[aeiou]{2}') AS miss FROM part")
sql_query("regexp_case_insensitive", "part", "SELECT p_partkey FROM part WHERE p_type RLIKE '(?i)^prom'",
          "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^prom', 'i')")
sql_query("ignore_case_column", "part", """SELECT p_partkey FROM part WHERE CAST(p_type AS STRING) COLLATE UTF8_LCASE = 'economy'""",
          "SELECT p_partkey FROM part WHERE lower(p_type) = 'economy'")


@query("row_values", """SELECT p_partkey, (p_size = 5 AND p_brand = 'Brand#2') AS eq,
((p_size, p_brand) IN ((1, 'Brand#1'), (2, 'Brand#2'), (7, 'Brand#3'))) AS hit FROM part""")
def _(spark, sf):
    pair = [F.col("p_size"), F.col("p_brand")]
    return table(spark, sf, "part").select("p_partkey", cond.row_equals(pair, (5, "Brand#2")).alias("eq"),
                                           cond.row_in(pair, [(1, "Brand#1"), (2, "Brand#2"), (7, "Brand#3")]).alias("hit"))


sql_query("case_expressions", "part", f"""SELECT p_partkey, CASE WHEN s > 30 THEN 'big' WHEN s > 10 THEN 'mid' ELSE 'small' END AS searched,
CASE s WHEN 1 THEN 'one' WHEN NULL THEN 'never' ELSE 'other' END AS simple FROM {_MAYBE}""")


@query("decode_and_casewhen", f"""SELECT p_partkey, CASE WHEN s IS NULL THEN 'none' WHEN s = 1 THEN 'one' ELSE 'many' END AS d,
CASE WHEN s > 25 THEN 1 ELSE 0 END AS w FROM {_MAYBE}""")
def _(spark, sf):
    s = F.nullif("p_size", F.lit(10))
    return table(spark, sf, "part").select("p_partkey", cond.decode(s, None, "none", 1, "one", "many").alias("d"),
                                           cond.casewhen(s > 25, 1, 0).alias("w"))


sql_query("arithmetic", "part", """SELECT p_partkey, p_size + 3 AS a, p_size - 60 AS s, p_size * 7 AS m, CAST(p_size div 4 AS INT) AS q,
(p_size - 25) % 4 AS r, -p_size AS n FROM part""", """SELECT p_partkey, p_size + 3 AS a, p_size - 60 AS s, p_size * 7 AS m,
CAST(p_size // 4 AS INTEGER) AS q, (p_size - 25) % 4 AS r, -p_size AS n FROM part""")
sql_query("concatenation", "part", f"SELECT p_partkey, b || '/' || CAST(s AS STRING) AS t FROM {_MAYBE}",
          f"SELECT p_partkey, b || '/' || CAST(s AS VARCHAR) AS t FROM {_MAYBE}")
sql_query("casts", "orders", """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) > 1000 AS a, CAST(o_orderkey AS STRING) AS s,
CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, o_custkey :: INT AS c, CAST(o_orderdate AS DATE) AS d,
try_cast(o_orderstatus AS INT) AS nope FROM orders""", """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) > 1000 AS a,
CAST(o_orderkey AS VARCHAR) AS s, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, CAST(o_custkey AS INTEGER) AS c,
CAST(o_orderdate AS DATE) AS d, TRY_CAST(o_orderstatus AS INTEGER) AS nope FROM orders""")


@query("array_subscript", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[4] AS DOUBLE), 6) AS fourth,
CAST(NULL AS DOUBLE) AS beyond FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    at = lambda i: F.round(cond.subscript(F.col("embedding"), i).cast("double"), 6)
    return e.select("vec_id", at(0).alias("first"), at(3).alias("fourth"), at(100000).alias("beyond"))


@query("query_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000")
def _(spark, sf):
    views(spark, sf, "orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = :status AND o_totalprice > :price",
                     args={"status": "P", "price": 250000})


@query("running_total_variable", """SELECT o_custkey, o_orderkey, CAST(sum(1) OVER (PARTITION BY o_custkey
ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM orders""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return sequence.running_total(orders, F.lit(1).cast("bigint"), "n", keys=["o_custkey"], order=["o_orderkey"], by=["o_custkey"])


sql_query("select_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# --- joins ------------------------------------------------------------------------------

sql_query("inner_join", "orders customer nation", """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000""")
sql_query("inner_join_star", "lineitem orders customer nation region", """SELECT r_name, l_returnflag, count(*) AS n,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, l_returnflag""")
sql_query("left_join", "customer orders", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000""")
sql_query("right_join", "orders customer", "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
sql_query("full_join", "customer supplier", """SELECT c_nationkey, s_nationkey, count(*) AS n FROM (SELECT * FROM customer WHERE c_nationkey < 15) c
FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 10) s ON c_nationkey = s_nationkey GROUP BY c_nationkey, s_nationkey""")
sql_query("comma_join", "nation region", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
sql_query("cross_join_filtered", "nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region WHERE r_regionkey < n_regionkey")
sql_query("natural_join", "nation region", """SELECT * FROM (SELECT n_name, n_regionkey AS r_regionkey FROM nation) a
NATURAL JOIN (SELECT r_regionkey, r_name FROM region) b""")
sql_query("nested_join", "customer orders lineitem", """SELECT c_custkey, count(l_linenumber) AS n FROM customer LEFT JOIN
(orders JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R') ON c_custkey = o_custkey GROUP BY c_custkey""")
sql_query("semi_join", "part lineitem", "SELECT p_partkey FROM part LEFT SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) ON p_partkey = l_partkey",
          "SELECT p_partkey FROM part SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) ON p_partkey = l_partkey")
sql_query("anti_join", "part lineitem", "SELECT p_partkey FROM part LEFT ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 30) ON p_partkey = l_partkey",
          "SELECT p_partkey FROM part ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 30) ON p_partkey = l_partkey")


@query("old_style_outer_join", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def _(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select("n_nationkey", "s_suppkey")


_BAND = "s_acctbal - 25 AND s_acctbal + 25"


@query("range_join", f"SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_acctbal BETWEEN {_BAND}")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25).alias("lo"), (F.col("s_acctbal") + 25).alias("hi"))
    return joins.range_join(table(spark, sf, "customer"), "c_acctbal", s, "lo", "hi", unit=10.0).select("s_suppkey", "c_custkey")


@query("range_join_mixed_lengths", """SELECT s_suppkey, CAST(count(*) AS BIGINT) AS n FROM supplier JOIN customer
ON c_acctbal BETWEEN s_acctbal AND s_acctbal + pow(2, s_suppkey % 14) GROUP BY 1""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"),
                                            (F.col("s_acctbal") + F.pow(F.lit(2.0), F.col("s_suppkey") % 14)).alias("hi"))
    return (joins.range_join(table(spark, sf, "customer"), "c_acctbal", s, "lo", "hi", how="count")
            .groupBy("s_suppkey").agg(F.sum("n").alias("n")))


@query("range_semi_join", f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE c_acctbal BETWEEN {_BAND})")
def _(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_acctbal") - 25).alias("lo"), (F.col("s_acctbal") + 25).alias("hi"))
    return joins.range_join(table(spark, sf, "customer"), "c_acctbal", s, "lo", "hi", unit=10.0, how="left_semi").select("c_custkey")


# Boxes made from the star schema: a part is a box of its size and price, a customer a small square.
_PART_BOX = ("p_partkey, p_size AS axmin, p_retailprice AS aymin, p_size + p_partkey % 5 AS axmax, p_retailprice + p_partkey % 97 AS aymax")
_SUPP_BOX = ("s_suppkey, s_suppkey % 50 AS bxmin, 900 + s_acctbal / 10 AS bymin, s_suppkey % 50 + 2 AS bxmax, 900 + s_acctbal / 10 + s_suppkey % 61 AS bymax")


def _boxes(spark, sf):
    views(spark, sf, "part", "supplier")
    return (spark.sql(f"SELECT {_PART_BOX} FROM part"),
            spark.sql(f"SELECT {_SUPP_BOX} FROM supplier"))


@query("box_intersection_join", f"""SELECT p_partkey, s_suppkey FROM (SELECT {_PART_BOX} FROM part) a JOIN (SELECT {_SUPP_BOX} FROM supplier) b
ON axmin <= bxmax AND bxmin <= axmax AND aymin <= bymax AND bymin <= aymax""")
def _(spark, sf):
    a, b = _boxes(spark, sf)
    return joins.bbox_join(a, b, "a", "b", unit=4.0).select("p_partkey", "s_suppkey")


@query("box_lookup", f"""SELECT p_partkey FROM (SELECT {_PART_BOX} FROM part) WHERE axmin <= 12 AND 10 <= axmax AND aymin <= 960 AND 940 <= aymax""")
def _(spark, sf):
    a, _b = _boxes(spark, sf)
    window = {"bxmin": 10, "bymin": 940, "bxmax": 12, "bymax": 960}
    return a.withColumns({k: F.lit(v) for k, v in window.items()}).filter(joins.intersects("a", "b")).select("p_partkey")


@query("envelope_union", f"""SELECT p_brand, CAST(min(axmin) AS INTEGER) AS xmin, min(aymin) AS ymin, CAST(max(axmax) AS BIGINT) AS xmax, max(aymax) AS ymax
FROM (SELECT p_brand, {_PART_BOX} FROM part) GROUP BY p_brand""")
def _(spark, sf):
    views(spark, sf, "part")
    boxes = spark.sql(f"SELECT p_brand, {_PART_BOX} FROM part")
    return boxes.groupBy("p_brand").agg(*joins.envelope_union("a"))


@query("next_order_join", """SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_key FROM orders""")
def _(spark, sf):
    steps = sequence.neighbours(table(spark, sf, "orders"), F.col("o_orderkey"), keys=["o_custkey"], order=["o_orderdate", "o_orderkey"], endpoints=True)
    return steps.where(F.col("prev").isNotNull()).select(F.col("prev.v").alias("o_orderkey"), "o_custkey", F.col("next.v").alias("next_key"))


# --- aggregation ------------------------------------------------------------------------

sql_query("group_by_expressions", "lineitem", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS net FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus""",
          """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS net FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus""")
sql_query("group_by_null_group", "part", f"SELECT b, s % 5 AS m, count(*) AS n FROM {_MAYBE} GROUP BY b, s % 5")
sql_query("global_aggregate_empty", "orders", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_totalprice < 0")
sql_query("having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("having_without_group", "orders", "SELECT count(*) AS n FROM orders HAVING max(o_totalprice) > 0")
sql_query("aggregate_distinct", "lineitem", """SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_suppkey""",
          """SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_suppkey""")
sql_query("count_all_and_column", "part", f"SELECT count(*) AS n, count(s) AS sizes, count(b) AS brands FROM {_MAYBE}")


@query("sum_types", """SELECT o_orderstatus, CAST(sum(o_custkey) AS VARCHAR) AS big, CAST(sum(CAST(o_totalprice > 200000 AS INTEGER)) AS BIGINT) AS dear FROM orders GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        agg.sum_exact(F.col("o_custkey")).cast("string").alias("big"), agg.sum_true(F.col("o_totalprice") > 200000).alias("dear"))


@query("avg_of_whole_numbers", """SELECT p_brand, CAST(sum(p_size) // count(p_size) AS INTEGER) AS size, CAST(trunc(sum(p_size - 40) / count(p_size)) AS INTEGER) AS below
FROM part GROUP BY p_brand""")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(agg.avg_same_type(F.col("p_size")).alias("size"),
                                                           agg.avg_same_type(F.col("p_size") - 40).alias("below"))


sql_query("avg_of_doubles", "part", "SELECT p_brand, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand")
sql_query("min_max", "orders", """SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderstatus) AS s FROM orders GROUP BY o_orderpriority""")
sql_query("group_concat", "nation region", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
          "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@query("group_concat_distinct", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(agg.group_concat(F.col("p_type"), "|", distinct=True).alias("types"))


@query("string_agg_ordered", """SELECT r_name, string_agg(nullif(n_name, 'NATION_3'), '; ' ORDER BY n_nationkey DESC) AS names FROM nation
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(
        agg.group_concat(F.nullif("n_name", F.lit("NATION_3")), "; ", order=[-F.col("n_nationkey")]).alias("names"))


@query("group_concat_descending", """SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type DESC, p_partkey) AS types,
string_agg(p_name, ';' ORDER BY nullif(p_size, 5) DESC NULLS LAST, p_name DESC) AS names FROM part GROUP BY p_brand""")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(
        agg.group_concat(F.col("p_type"), order=[agg.descending("p_type"), F.col("p_partkey")]).alias("types"),
        agg.group_concat(F.col("p_name"), ";", order=[agg.descending(F.nullif("p_size", F.lit(5))), agg.descending("p_name")]).alias("names"))


sql_query("stddev_variance", "lineitem", """SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss,
round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_quantity), 5) AS vs FROM lineitem GROUP BY l_returnflag""")
sql_query("variance_of_single_row", "nation", "SELECT n_name, stddev_samp(n_regionkey) AS s, var_pop(n_regionkey) AS v FROM nation GROUP BY n_name")
sql_query("bool_aggregates", "part", f"SELECT b, bool_or(s > 45) AS some, bool_and(s > 1) AS every FROM {_MAYBE} GROUP BY b")
sql_query("bit_aggregates", "part", "SELECT p_brand, bit_or(p_size) AS o, bit_and(p_size + 64) AS a FROM part GROUP BY p_brand")


@query("selectivity_exact", """SELECT p_brand, CAST(least(greatest(floor(100 * (count(DISTINCT p_type)) / count(*)), 1), 100) AS INTEGER) AS types,
CAST(least(greatest(floor(100 * (count(DISTINCT nullif(p_size, 10)) + CAST(bool_or(p_size = 10) AS INTEGER)) / count(*)), 1), 100) AS INTEGER) AS sizes
FROM part GROUP BY p_brand""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("s", F.nullif("p_size", F.lit(10)))
    return p.groupBy("p_brand").agg(agg.selectivity("p_type", True).alias("types"), agg.selectivity("s", True).alias("sizes"))


@query("selectivity_sketch")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(*[agg.selectivity(c).alias(c) for c in ("l_orderkey", "l_partkey", "l_returnflag")])


@query("histogram_rows", "SELECT p_brand, nullif(p_type, 'PROMO') AS value, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY 1, 2")
def _(spark, sf):
    return agg.histogram_rows(table(spark, sf, "part").withColumn("t", F.nullif("p_type", F.lit("PROMO"))), "t", ["p_brand"])


@query("histogram", """SELECT p_brand, string_agg(p_size || ':' || n, ',' ORDER BY p_size) AS h FROM
(SELECT p_brand, p_size, count(*) n FROM part GROUP BY 1, 2) GROUP BY p_brand""")
def _(spark, sf):
    h = agg.histogram(table(spark, sf, "part"), "p_size", ["p_brand"])
    return h.select("p_brand", F.array_join(F.transform("histogram", lambda e: F.concat_ws(":", e["value"].cast("string"), e["count"].cast("string"))), ",").alias("h"))


@query("column_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(least(greatest(floor(100 * count(DISTINCT {c}) / count(*)), 1), 100) AS INTEGER) AS selectivity,
CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def _(spark, sf):
    return agg.profile(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), exact=True)


@query("sampled_aggregate")
def _(spark, sf):
    return table(spark, sf, "lineitem").limit(1000).agg(F.count(F.lit(1)).alias("n"), agg.selectivity("l_suppkey").alias("suppliers"))


@query("user_aggregate", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS g FROM part GROUP BY p_brand")
def _(spark, sf):
    g = user.aggregate_by(table(spark, sf, "part"), ["p_brand"], "p_retailprice", user.GEOMETRIC_MEAN, "g")
    return g.select("p_brand", F.round("g", 6).alias("g"))


@query("user_aggregate_typed", """SELECT p_brand, first(p_name ORDER BY p_retailprice DESC, p_name) || '/' || count(*) AS best FROM part
WHERE p_retailprice IS NOT NULL AND p_name IS NOT NULL GROUP BY p_brand""")
def _(spark, sf):
    return user.fold_by(table(spark, sf, "part"), ["p_brand"], ["p_name", "p_retailprice"], user.DEAREST, "best", "string")


@query("user_function_overloads", """SELECT p_partkey, p_size * 2.0::DOUBLE AS one, p_size * 2.0::DOUBLE + p_retailprice AS two, nullif(p_size, 3) * 2.0::DOUBLE + p_retailprice AS with_null,
true AS fixed FROM part""")
def _(spark, sf):
    views(spark, sf, "part")
    score = user.register_function(spark, "part_score", {1: lambda a: a * 2.0, 2: lambda a, b: a * 2.0 + b}, "double")
    drawn = user.register_function(spark, "part_draw", {1: lambda a: a * 0.0}, "double", deterministic=False)
    fixed = score.deterministic and not drawn.deterministic
    return spark.sql(f"""SELECT p_partkey, part_score(p_size) AS one, part_score(p_size, p_retailprice) AS two,
    part_score(nullif(p_size, 3), p_retailprice) AS with_null, {str(fixed).lower()} AS fixed FROM part""")


@query("table_function_dynamic", """SELECT user_id AS key, CAST(count_if(event_type = 'view') AS BIGINT) AS view, CAST(count_if(event_type = 'click') AS BIGINT) AS click
FROM events GROUP BY user_id""")
def _(spark, sf):
    views(spark, sf, "events")
    user.register(spark)
    return spark.sql("SELECT * FROM label_counts(TABLE(SELECT user_id, event_type FROM events) PARTITION BY (user_id), 'view,click')")


@query("table_function_ordered", """SELECT user_id AS key, lag(event_type) OVER w AS before, event_type AS after FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(event_id) OVER w IS NOT NULL""")
def _(spark, sf):
    views(spark, sf, "events")
    user.register(spark)
    return spark.sql("""SELECT * FROM label_steps(TABLE(SELECT user_id, event_type, ts, event_id FROM events) PARTITION BY (user_id) ORDER BY (ts, event_id))""")


@query("user_function_python", """SELECT p_partkey, p_size > 1 AND NOT EXISTS (SELECT 1 FROM range(2, p_size) d(d) WHERE p_size % d = 0) AS prime FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", user.is_prime("p_size").alias("prime"))


@query("user_function_from_source", "SELECT p_partkey, p_retailprice * 2 + p_size AS v FROM part")
def _(spark, sf):
    views(spark, sf, "part")
    user.sql_function(spark, "price_score", "price DOUBLE, size INT", "DOUBLE", "price * 2 + size")
    return spark.sql("SELECT p_partkey, price_score(p_retailprice, p_size) AS v FROM part")


# --- row numbers, order, limit ------------------------------------------------------------

@query("row_number_over_table", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def _(spark, sf):
    return row_numbers(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rn")


@query("rownum_filter", "SELECT CAST(least(100, count(*)) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 10")
def _(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 10").limit(100).agg(F.count(F.lit(1)).alias("n"))


sql_query("order_by_and_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
sql_query("order_by_ordinal_and_alias", "customer", "SELECT c_custkey AS k, c_nationkey AS n FROM customer ORDER BY n DESC, 1 LIMIT 40")
sql_query("order_by_unselected", "customer", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
sql_query("nulls_low_by_default", "part", f"SELECT p_partkey, s FROM {_MAYBE} ORDER BY s, p_partkey LIMIT 60",
          f"SELECT p_partkey, s FROM {_MAYBE} ORDER BY s NULLS FIRST, p_partkey LIMIT 60")
sql_query("nulls_first_last", "part", f"SELECT p_partkey, s FROM {_MAYBE} ORDER BY s DESC NULLS FIRST, p_partkey LIMIT 60")
sql_query("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")


@query("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 5")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy("o_totalprice", "o_orderkey").offset(5).limit(15).select("o_orderkey")


@query("select_top", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey")


sql_query("top_per_group", "orders", """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER
(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 2""")
sql_query("sort_whole_table", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber")

# --- set operations and recursion -----------------------------------------------------------

sql_query("union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("intersect", "customer orders", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders")
sql_query("except", "customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")


@query("set_operations_left_to_right", """SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT p_size FROM part)
INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 3""")
def _(spark, sf):
    c, p, s = (table(spark, sf, t) for t in ("customer", "part", "supplier"))
    return sets.chain(c.select(F.col("c_nationkey").alias("k")), ("union", p.select("p_size")),
                      ("intersect", s.filter("s_nationkey > 3").select("s_nationkey")))


sql_query("union_type_alignment", "nation part", "SELECT n_nationkey AS v FROM nation UNION ALL SELECT p_retailprice FROM part")
sql_query("common_table_expressions", "orders customer", """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), per AS
(SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON o_custkey = c_custkey WHERE n > 1""")
_TREE = """WITH RECURSIVE tree(k, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 1 UNION ALL
SELECT c_custkey, depth + 1 FROM customer JOIN tree ON c_custkey div 3 = k WHERE c_custkey > 1) SELECT k, depth FROM tree"""
sql_query("recursive_query", "customer", _TREE, _TREE.replace("div", "//"))


@query("recursive_query_text", _TREE.replace("div", "//"))
def _(spark, sf):
    views(spark, sf, "customer")
    return sets.recursive_sql(spark, "tree", "SELECT c_custkey AS k, 0 AS depth FROM customer WHERE c_custkey = 1",
                              "SELECT c_custkey, depth + 1 FROM customer JOIN tree ON c_custkey div 3 = k WHERE c_custkey > 1")


@query("recursive_query_loop", _TREE.replace("div", "//"))
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    nodes = c.filter("c_custkey > 1").withColumn("parent", (F.col("c_custkey") - F.col("c_custkey") % 3) / 3)
    base = c.filter("c_custkey = 1").select(F.col("c_custkey").alias("k"), F.lit(0).alias("depth"))
    return sets.recursive(base, lambda d: nodes.join(d, nodes.parent == d.k).select(F.col("c_custkey").alias("k"), (F.col("depth") + 1).alias("depth")))


sql_query("derived_table", "orders", """SELECT s, n FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE s <> 'O'""")
