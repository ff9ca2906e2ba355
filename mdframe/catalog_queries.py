"""Queries in the language, each with equivalent DuckDB SQL: the coverage catalogue of the engine.

Every query runs over whole tables. Documents for the body functions are made from orders and their lines, so that what is extracted
has a closed form over the base tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.catalog_files import FILES
from mdframe.catalog_output import OUTPUT
from mdframe.engine import Engine

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
FLAGSHIP = (
    "select o_orderpriority, count(*) as n, round_(sum(o_totalprice)) as total from orders where o_totalprice > 100000 "
    "group by o_orderpriority having count(*) > 1 order by o_orderpriority"
)


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown document for each order, from its lines."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    lines = read("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("l"))
    rows = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("l", F.coalesce("l", F.array().cast(lines.schema["l"].dataType)))
    text = lambda x: x.cast("string")
    key = text(F.col("o_orderkey"))
    items = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- ["), F.when(x["l_returnflag"] == "R", "x").otherwise(" "), F.lit("] part "), text(x["l_partkey"]))), "\n")
    links = F.array_join(F.transform("l", lambda x: F.concat(F.lit("[part "), text(x["l_partkey"]), F.lit("](https://parts.example/"), text(x["l_partkey"]), F.lit(")"))), "\n")
    table = F.array_join(F.transform("l", lambda x: F.concat(F.lit("| "), text(x["l_linenumber"]), F.lit(" | "), text(x["q"]), F.lit(" |"))), "\n")
    body = F.concat(
        F.lit("# Order "), key, F.lit("\n\n## Items\n\n"), items, F.lit("\n\n## Links\n\n"), links, F.lit("\n\n### Data\n\n```"),
        F.coalesce(F.get("l", F.lit(0))["l_linestatus"], F.lit("none")), F.lit("\nstatus "), F.col("o_orderstatus"), F.lit("\n```\n\n| line | quantity |\n|---|---|\n"), table,
        F.lit("\n\n> note "), key, F.lit("\n\nAn *em "), key, F.lit("* and **strong** with ~~gone~~ and `code` ![pic](p"), key,
        F.lit(".png) and [ref][r].  \nTODO call("), key, F.lit(") here.[^1]\n\n[r]: https://ref.example/"), key, F.lit("\n[^1]: foot\n\n<div>raw</div>\n"),
    )
    return rows.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), key).alias("title"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_totalprice").alias("total"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.col("o_orderdate").alias("createdAt"), body.alias("body"),
    )


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown document for each customer, of shapes that depend on the key: deep headings, nested lists, references, blocks of HTML."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, name, lit = F.col("c_custkey").cast("string"), F.col("c_name"), F.lit
    two, three = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0
    part = lambda test, *text: F.when(test, F.concat(*text)).otherwise(lit(""))
    body = F.concat(
        lit("# "), name, lit("\n\nIntro *x* for "), name, lit(".\n\n`c"), key, lit("`\n\n- a "), key, lit("\n  - b\n    - c\n- d\n\n"),
        part(two, lit("#### Four\n\n##### Five "), key, lit("\n\n[see][im]\n\n###### Six\n\n<section>\n"), key, lit("\n</section>\n\n")),
        part(three, lit("![pic][im] and last words\n\n1. one\n2. two\n\n")), lit("[im]: http://i/"), key, lit(' "T"\n'),
    )
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), body.alias("body"))


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the base tables, documents of orders, lists of lines, and nullable labels."""
    out = Engine(spark)
    out.register_parquet(sf_dir, *BASE)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def lists() -> DataFrame:
        line = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("flag"))
        rows = read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(line)).alias("items"))
        return rows.select("k", "items", F.transform("items", lambda x: x["quantity"]).alias("q"), F.transform("items", lambda x: x["flag"]).alias("flags"))

    out.register_lazy("docs", lambda: order_documents(spark, sf_dir))
    out.register_lazy("notes", lambda: customer_notes(spark, sf_dir))
    out.register_lazy("lists", lists)
    out.register_lazy("marked", lambda: read("documents").select("doc_id", "lang", "source", "text").join(read("labels"), "doc_id", "left"))
    out.register_lazy("words", lambda: read("part").select("p_partkey", "p_name", F.split("p_name", " ").alias("w"), "p_brand", "p_type", "p_size"))
    return out


LISTS = "WITH lists AS (SELECT l_orderkey AS k, list_sort(list({'part': l_partkey, 'quantity': l_quantity::BIGINT, 'flag': l_returnflag})) AS items FROM lineitem GROUP BY 1) "
MARKED = "WITH marked AS (SELECT d.doc_id, lang, source, text, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) "
DOCS = (
    "WITH g AS (SELECT l_orderkey, list_sort(list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'q': l_quantity::INT, 'r': l_returnflag, 'st': l_linestatus, "
    "'e': l_extendedprice, 'd': l_shipdate})) AS l FROM lineitem GROUP BY 1), "
    "docs AS (SELECT o.*, coalesce(l, []) AS l FROM orders o LEFT JOIN g ON o_orderkey = l_orderkey) "
)
NOTES = "WITH notes AS (SELECT c_custkey AS id, c_name AS name, c_custkey % 2 = 0 AS two, c_custkey % 3 = 0 AS three FROM customer) "
TOC = "'[\"Order ' || o_orderkey || '\",\"Items\",\"Links\",\"Data\"]'"

# name: (query, DuckDB SQL)
CATALOG: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 1"),
    "select_project": ("select n_name, n_regionkey from nation", "SELECT n_name, n_regionkey FROM nation"),
    "select_star": ("select * from nation", "SELECT * FROM nation"),
    "select_bare": ("select from region", "SELECT * FROM region"),
    "select_alias": ("select n_name as name, n_nationkey + 1 as next from nation", "SELECT n_name AS name, n_nationkey::BIGINT + 1 AS next FROM nation"),
    "auto_names": ("select upper(r_name), r_regionkey = 2 from region", 'SELECT upper(r_name) AS "upper(r_name)", r_regionkey = 2 AS "r_regionkey_=_2" FROM region'),
    "where_compare": ('select o_orderkey from orders where o_totalprice >= 200000 and o_totalprice <= +400000 and o_orderdate < "1997-01-01"', "SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000 AND o_totalprice <= 400000 AND o_orderdate < TIMESTAMP '1997-01-01'"),
    "where_and_or_not": (
        'select o_orderkey from orders where not o_orderstatus = "F" and o_totalprice > 50000 or o_orderpriority = "1-URGENT"',
        "SELECT o_orderkey FROM orders WHERE (NOT o_orderstatus = 'F' AND o_totalprice > 50000) OR o_orderpriority = '1-URGENT'",
    ),
    "where_not_scope": (
        "select o_orderkey from orders where not (o_totalprice > 100000) and o_orderkey > 100",
        "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000) AND o_orderkey > 100",
    ),
    "number_vs_text": ('select o_orderkey from orders where o_orderkey = "32" or o_totalprice > "300000.5"', "SELECT o_orderkey FROM orders WHERE o_orderkey = 32 OR o_totalprice > 300000.5"),
    "date_vs_text": ('select o_orderkey from orders where o_orderdate >= "2000-01-01"', "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'"),
    "text_contains": ('select p_partkey from part where p_name contains "ring"', "SELECT p_partkey FROM part WHERE contains(p_name, 'ring')"),
    "text_starts_ends": (
        'select p_partkey from part where p_name starts_with "s" or p_name ends_with "g"',
        "SELECT p_partkey FROM part WHERE starts_with(p_name, 's') OR ends_with(p_name, 'g')",
    ),
    "text_not_tests": (
        'select p_partkey from part where p_name not contains "ring" and p_name not starts_with "s" and p_name not ends_with "t"',
        "SELECT p_partkey FROM part WHERE NOT contains(p_name, 'ring') AND NOT starts_with(p_name, 's') AND NOT ends_with(p_name, 't')",
    ),
    "matches": ('select p_partkey from part where p_name matches "^[a-m].*r"', "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*r')"),
    "matches_flags": ('select p_partkey from part where p_name matches "/RING/i"', "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'RING', 'i')"),
    "in_list": ('select o_orderkey from orders where o_orderstatus in ("F", "P")', "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "not_in_list": ('select o_orderkey from orders where o_orderstatus not in ("F", "P")', "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')"),
    "is_empty": ("select doc_id from marked where quality is empty", MARKED + "SELECT doc_id FROM marked WHERE quality IS NULL"),
    "is_not_empty": ("select doc_id from marked where quality is not empty and text is not empty", MARKED + "SELECT doc_id FROM marked WHERE quality IS NOT NULL AND text <> ''"),
    "has_field": ("select doc_id from marked where has(toxic) and not has(nothing)", MARKED + "SELECT doc_id FROM marked WHERE toxic IS NOT NULL"),
    "equal_null": ("select doc_id from marked where quality = 1", MARKED + "SELECT doc_id FROM marked WHERE quality = 1"),
    "unequal_null": ("select doc_id from marked where quality != 1", MARKED + "SELECT doc_id FROM marked WHERE quality IS DISTINCT FROM 1"),
    "absent_in": ("select doc_id from marked where quality not in (1)", MARKED + "SELECT doc_id FROM marked WHERE coalesce(quality NOT IN (1), true)"),
    "absent_matches": ('select doc_id from marked where not (nothing matches "x") and not (lang matches "^e")', MARKED + "SELECT doc_id FROM marked WHERE NOT starts_with(lang, 'e')"),
    "less_null": ("select doc_id from marked where quality < 1", MARKED + "SELECT doc_id FROM marked WHERE quality < 1"),
    "any_op": ('select p_partkey from words where w any = "ring"', "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')"),
    "any_contains": ('select p_partkey from words where w any starts_with "s"', "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 's'))) > 0"),
    "all_op": ('select p_partkey from words where w all contains "e"', "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: NOT contains(x, 'e'))) = 0"),
    "any_of_scalar": ('select p_partkey, p_name any = "ring" as s, w any = "ring" as a from words', "SELECT p_partkey, false AS s, list_contains(string_split(p_name, ' '), 'ring') AS a FROM part"),
    "in_array": ('select p_partkey from words where "ring" in w', "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')"),
    "array_contains": ('select p_partkey from words where w contains "ring"', "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')"),
    "arithmetic": (
        "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge, -l_quantity as minus, l_quantity / 0 as none from lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS minus, NULL::DOUBLE AS none FROM lineitem",
    ),
    "power_mod_divide": (
        "select p_partkey, p_size % 7 as m, p_size ^ 2 as p, p_size / 4 as d, 2 ^ 3 ^ 2 as r from part",
        "SELECT p_partkey, p_size::BIGINT % 7 AS m, pow(p_size, 2)::DOUBLE AS p, p_size / 4.0::DOUBLE AS d, 512.0::DOUBLE AS r FROM part",
    ),
    "text_plus": ('select p_partkey, p_brand + "-" + p_size as s from part', "SELECT p_partkey, p_brand || '-' || p_size AS s FROM part"),
    "array_union": (
        'select p_partkey, (w + ["new", "ring"]).join("|") as u from words',
        "SELECT p_partkey, array_to_string(list_distinct_in_order, '|') AS u FROM (SELECT p_partkey, list_filter(list_concat(string_split(p_name, ' '), ['new', 'ring']), "
        "lambda x, i: list_position(list_concat(string_split(p_name, ' '), ['new', 'ring']), x) = i) AS list_distinct_in_order FROM part)",
    ),
    "array_difference": ('select p_partkey, (w - ["ring"]).join("|") as u from words', "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'ring'), '|') AS u FROM part"),
    "array_add_remove": (
        'select p_partkey, (w + "ring").count() as a, (w - "ring").count() as b, ("ring" + w).first() as c from words',
        "SELECT p_partkey, len(w) + (NOT list_contains(w, 'ring'))::BIGINT AS a, len(list_filter(w, lambda x: x <> 'ring'))::BIGINT AS b, "
        "CASE WHEN list_contains(w, 'ring') THEN w[1] ELSE 'ring' END AS c FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
    ),
    "date_arithmetic": (
        'select o_orderkey, dateFormat(o_orderdate + 86400000, "YYYY-MM-DD") as d, o_orderdate - date("1995-01-01") as x, "1999-01-01" - o_orderdate as y, o_orderdate - o_orderdate as z, daysUntil("1995-01-01", o_orderdate) as days from orders',
        "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS d, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') AS x, epoch_ms(TIMESTAMP '1999-01-01') - epoch_ms(o_orderdate) AS y, 0::BIGINT AS z, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days FROM orders",
    ),
    "date_functions": (
        'select o_orderkey, isBefore(o_orderdate, "1998-06-01") as b, isAfter(o_orderdate, "1998-06-01") as a, dateAdd(o_orderdate, 10) as p, date_sub(o_orderdate, 3) as m, dateFormat(o_orderdate, "DD/MM/YYYY HH:mm") as f from orders',
        "SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-06-01' AS b, o_orderdate > TIMESTAMP '1998-06-01' AS a, o_orderdate + INTERVAL 10 DAY AS p, o_orderdate - INTERVAL 3 DAY AS m, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS f FROM orders",
    ),
    "group_count": ("select o_orderstatus, count(*) as n from orders group by o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "group_aggregates": (
        "select l_returnflag, l_linestatus, sum(l_linenumber) as s, round_(avg(l_quantity)) as a, min(l_extendedprice) as lo, max(l_shipdate) as hi, count(l_tax) as c from lineitem group by l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_linenumber)::BIGINT AS s, round(avg(l_quantity), 2) AS a, min(l_extendedprice) AS lo, max(l_shipdate) AS hi, count(l_tax) AS c FROM lineitem GROUP BY ALL",
    ),
    "aggregate_arithmetic": (
        "select o_custkey, max(o_totalprice) - min(o_totalprice) as spread, count(*) * 2 as twice from orders group by o_custkey",
        "SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread, count(*) * 2 AS twice FROM orders GROUP BY 1",
    ),
    "having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_totalprice) > 250000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 250000"),
    "having_no_group": ("select n_name from nation having n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "global_aggregate": ("select count(*) as n, min(o_orderdate) as first, max(o_totalprice) as top from orders", "SELECT count(*) AS n, min(o_orderdate) AS first, max(o_totalprice) AS top FROM orders"),
    "group_bare_first": ("select c_nationkey, c_custkey, c_name, count(*) as n from customer group by c_nationkey", "SELECT c_nationkey, min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name, count(*) AS n FROM customer GROUP BY 1"),
    "count_null": ("select lang, count(quality) as q, count(*) as n from marked group by lang", MARKED + "SELECT lang, count(quality) AS q, count(*) AS n FROM marked GROUP BY 1"),
    "group_expression": ("select p_size % 5 as r, count(*) as n from part group by p_size % 5", "SELECT p_size::BIGINT % 5 AS r, count(*) AS n FROM part GROUP BY 1"),
    "order_limit": ("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "order_hidden": ("select c_custkey from customer order by c_acctbal, c_custkey limit 7 offset 3", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7 OFFSET 3"),
    "order_nulls_last": ("select doc_id, quality from marked order by quality, doc_id offset 60", MARKED + "SELECT doc_id, quality FROM marked ORDER BY quality NULLS LAST, doc_id OFFSET 60"),
    "offset": ("select n_nationkey from nation order by n_name offset 20", "SELECT n_nationkey FROM nation ORDER BY n_name OFFSET 20"),
    "limit_zero": ("select n_nationkey from nation limit 0", "SELECT n_nationkey FROM nation LIMIT 0"),
    "distinct": ("select distinct c_mktsegment, c_nationkey from customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "distinct_expression": ("select distinct upper(c_mktsegment) as s from customer order by s", "SELECT DISTINCT upper(c_mktsegment) AS s FROM customer"),
    "join_inner": ("select n_name, r.r_name as region from nation n join region r on n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_where": (
        "select c.c_name as c_name, orders.o_orderkey as k from customer c inner join orders on c.c_custkey = orders.o_custkey where o_totalprice > 300000",
        "SELECT c_name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000",
    ),
    "join_trailing": (
        "select s_name, nation.n_name as nation from supplier where s_acctbal > 0 inner join nation on supplier.s_nationkey = nation.n_nationkey",
        "SELECT s_name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0",
    ),
    "join_left": ("select c_custkey, o.o_orderkey as k from customer left join orders o on customer.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_right": ("select l.doc_id as l, d.doc_id as d from labels l right join documents d on l.doc_id = d.doc_id", "SELECT l.doc_id AS l, d.doc_id AS d FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id"),
    "join_cross": ("select r_name, n.n_name as nation from region cross join nation n", "SELECT r_name, n_name AS nation FROM region CROSS JOIN nation"),
    "join_theta": ("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_group": (
        "select n.n_name as nation, count(*) as n, sum(c_custkey) as s from customer join nation n on c_nationkey = n.n_nationkey group by n.n_name",
        "SELECT n_name AS nation, count(*) AS n, sum(c_custkey)::BIGINT AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "join_three": (
        "select c_name, n.n_name as nation, r.r_name as region from customer join nation n on c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey where c_acctbal > 5000",
        "SELECT c_name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000",
    ),
    "union_distinct": ("select c_nationkey as k from customer union select s_nationkey as k from supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("select c_nationkey as k from customer union all select s_nationkey as k from supplier union all select n_nationkey from nation", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation"),
    "union_chain": ("select c_nationkey as k from customer union select s_nationkey as k from supplier union all select n_nationkey from nation", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT n_nationkey FROM nation"),
    "union_chain_last": ("select c_nationkey as k from customer union all select s_nationkey as k from supplier union select n_nationkey from nation", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation"),
    "in_subquery": ("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "not_in_subquery": ("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "not_in_nulls": (  # null-safe, as = is: a null is in a result that holds one, and hides nothing else
        "select doc_id, quality from marked where quality not in (select toxic from marked where toxic is empty or toxic = 1)",
        MARKED + "SELECT doc_id, quality FROM marked m WHERE NOT EXISTS (SELECT 1 FROM marked i WHERE (i.toxic IS NULL OR i.toxic = 1) AND i.toxic IS NOT DISTINCT FROM m.quality)",
    ),
    "not_in_without_nulls": ("select doc_id from marked where quality not in (select toxic from labels where toxic = 1)", MARKED + "SELECT doc_id FROM marked WHERE quality IS DISTINCT FROM 1"),
    "exists_correlated": ('select c_custkey from customer where exists (select from orders where o_custkey = outer.c_custkey and o_orderstatus = "P")', "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "not_exists": ("select c_custkey from customer where not exists (select from orders where o_custkey = outer.c_custkey and o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "scalar_subquery": ("select o_orderkey from orders where o_totalprice = (select max(o_totalprice) from orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)"),
    "count_subquery": ("select c_custkey, count(select from orders where o_custkey = outer.c_custkey) as n from customer", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "text_functions": (
        'select p_partkey, upper(p_name) as u, lower(p_brand) as l, len(p_type) as n, replace(p_name, "r", "__") as r, split(p_name, " ").join("+") as j, trim(" " + p_name + " ") as t from part',
        "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type) AS n, replace(p_name, 'r', '__') AS r, replace(p_name, ' ', '+') AS j, p_name AS t FROM part",
    ),
    "case_functions": (
        "select p_partkey, capitalize(p_name) as c, camelCase(p_name) as m, pascal_case(p_name) as p, sentence(p_name) as s, snakeCase(p_name) as n, kebab_case(p_name) as k from part",
        "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS c, "
        "lower(string_split(p_name, ' ')[1]) || array_to_string(list_transform(string_split(p_name, ' ')[2:], lambda x: upper(x[1]) || lower(x[2:])), '') AS m, "
        "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') AS p, upper(p_name[1]) || lower(p_name[2:]) AS s, "
        "replace(lower(p_name), ' ', '_') AS n, replace(lower(p_name), ' ', '-') AS k FROM part",
    ),
    "text_predicates": ('select p_partkey, contains(p_name, "in") as c, startsWith(p_name, "s") as s, endsWith(p_name, "g") as e, trimAll("|" + p_name + "|b") as t from part', "SELECT p_partkey, contains(p_name, 'in') AS c, starts_with(p_name, 's') AS s, ends_with(p_name, 'g') AS e, ' ' || p_name || ' b' AS t FROM part"),
    "text_methods": (
        'select p_partkey, p_type.toLowerCase() as l, p_name.toUpperCase() as u, (" " + p_name + " ").trim() as t, p_name.startsWith("s") as s, p_name.endsWith("g") as e, p_name.includes("in") as i from part',
        "SELECT p_partkey, lower(p_type) AS l, upper(p_name) AS u, p_name AS t, starts_with(p_name, 's') AS s, ends_with(p_name, 'g') AS e, contains(p_name, 'in') AS i FROM part",
    ),
    "call_again": ('select p_partkey, replace(p_name, "r")("_") as r, join(w, "+") as j from words', "SELECT p_partkey, replace(p_name, 'r', '_') AS r, replace(p_name, ' ', '+') AS j FROM part"),
    "clock": (
        'select r_name, len(now()) as n, today() = now().slice(0, 10) as t, daysSince(today()) as z, nextDate("weekly") > today() as w, date("1996-02-03") as d, len(user()) > 0 as u, date("no date") is empty as e from region',
        "SELECT r_name, 24 AS n, true AS t, 0::BIGINT AS z, true AS w, '1996-02-03T00:00:00.000Z' AS d, true AS u, true AS e FROM region",
    ),
    "conversions": (
        'select event_id, str(user_id) as s, int(value) as i, int("12abc") as j, float("2.5x") as f, bool(user_id) as b, bool("yes") as y, array(event_type).count() as a, typeof(value) as t, typeof(event_type) as u from events',
        "SELECT event_id, user_id::VARCHAR AS s, floor(value)::BIGINT AS i, 12::BIGINT AS j, 2.5::DOUBLE AS f, user_id <> 0 AS b, true AS y, 1::BIGINT AS a, 'number' AS t, 'string' AS u FROM events",
    ),
    "enums": (
        'select event_id, nextEnum(event_type, ["view", "click", "purchase"]) as n, prevEnum(event_type, ["view", "click", "purchase"]) as p from events',
        "SELECT event_id, CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' ELSE 'view' END AS n, CASE event_type WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'click' ELSE 'purchase' END AS p FROM events",
    ),
    "array_filter": ('select k, items.filter(flag = "R").count() as r, items.where(quantity > 25 and flag != "N").count() as w from lists', LISTS + "SELECT k, len(list_filter(items, lambda x: x.flag = 'R')) AS r, len(list_filter(items, lambda x: x.quantity > 25 AND x.flag <> 'N')) AS w FROM lists"),
    "array_filter_outer": ("select k, items.filter(part > k).count() as n from lists", LISTS + "SELECT k, len(list_filter(items, lambda x: x.part > k)) AS n FROM lists"),
    "array_map": ("select k, items.map('part').join(',') as p, items.map(quantity * 2).join('-') as q from lists", LISTS + "SELECT k, array_to_string(list_transform(items, lambda x: x.part), ',') AS p, array_to_string(list_transform(items, lambda x: x.quantity * 2), '-') AS q FROM lists"),
    "array_sort": ("select k, items.map('quantity').sort().join(',') as q from lists", LISTS + "SELECT k, array_to_string(list_sort(list_transform(items, lambda x: x.quantity)), ',') AS q FROM lists"),
    "array_sort_field": ("select k, items.sort('quantity').map('quantity').join(',') as q from lists", LISTS + "SELECT k, array_to_string(list_sort(list_transform(items, lambda x: x.quantity)), ',') AS q FROM lists"),
    "array_ends": ("select k, q.first() as f, q.last() as l, q[0] as a, q[-1] as z, q[99] as none, items[0].part as p from lists", LISTS + "SELECT k, items[1].quantity AS f, items[-1].quantity AS l, items[1].quantity AS a, items[-1].quantity AS z, NULL::BIGINT AS none, items[1].part AS p FROM lists"),
    "array_slice": ("select k, q.slice(1, 3).join(',') as a, q.slice(-2).join(',') as b from lists", LISTS + "SELECT k, array_to_string(list_transform(items[2:3], lambda x: x.quantity), ',') AS a, array_to_string(list_transform(items[-2:], lambda x: x.quantity), ',') AS b FROM lists"),
    "array_unique": ("select k, flags.unique().count() as n, flags.count() as c, flags.unique().sort().join('') as s from lists", LISTS + "SELECT k, len(list_distinct(list_transform(items, lambda x: x.flag))) AS n, len(items) AS c, array_to_string(list_sort(list_distinct(list_transform(items, lambda x: x.flag))), '') AS s FROM lists"),
    "array_flatten": ('select p_partkey, w.map(split(_, "i")).flatten().count() as n from words', "SELECT p_partkey, list_sum(list_transform(string_split(p_name, ' '), lambda x: len(string_split(x, 'i'))))::BIGINT AS n FROM part"),
    "text_slice": ("select p_partkey, p_name.slice(1, 4) as a, p_name.slice(-3) as b, p_brand.length() as n from part", "SELECT p_partkey, p_name[2:4] AS a, p_name[-3:] AS b, length(p_brand) AS n FROM part"),
    "map_methods": (
        'select n_nationkey, fields().keys().count() as k, fields().values().count() as v, fields("n_*").join(",") as f, fields().n_name as name from nation',
        "SELECT n_nationkey, 3::BIGINT AS k, 3::BIGINT AS v, 'n_nationkey,n_name,n_regionkey' AS f, n_name AS name FROM nation",
    ),
    "map_get": ("select event_id, props.k as k from events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "map_key": ("select event_id, props['k'] as k, event_type.length() as n from events", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(event_type) AS n FROM events"),
    "map_entries": ("select n_nationkey, fields().entries().count() as e, fields().entries().map('key').join(',') as k, fields().length() as n from nation", "SELECT n_nationkey, 3::BIGINT AS e, 'n_nationkey,n_name,n_regionkey' AS k, 3::BIGINT AS n FROM nation"),
    "document_id": ("select id() as i, title from docs where id = 32 or total > 400000", "SELECT o_orderkey::VARCHAR AS i, 'Order ' || o_orderkey AS title FROM orders WHERE o_orderkey = 32 OR o_totalprice > 400000"),
    "notes_deep_headings": (
        "select id, h4.count() as a, h5[0].title as b, h6.map('title').join(',') as c, has_section('Four') as f from notes",
        NOTES + "SELECT id, two::BIGINT AS a, CASE WHEN two THEN 'Five ' || id END AS b, CASE WHEN two THEN 'Six' ELSE '' END AS c, two AS f FROM notes",
    ),
    "notes_outline": (
        "select id, outline(5) as o, toc([1, 6]).map('title').join('/') as t from notes",
        NOTES + "SELECT id, '└── ' || name || CASE WHEN two THEN chr(10) || '            └── Four' || chr(10) || '                └── Five ' || id ELSE '' END AS o, name || CASE WHEN two THEN '/Six' ELSE '' END AS t FROM notes",
    ),
    "notes_paragraphs": ("select id, p[0].content as a, p.filter(content contains 'last').count() as b from notes", NOTES + "SELECT id, 'Intro x for ' || name || '.' AS a, three::BIGINT AS b FROM notes"),
    "notes_references": (
        "select id, imageRef.map('identifier').join(',') as i, imageRef.count() as n, def('im').map('url').join(',') as u, linkRef[0].text as l from notes",
        NOTES + "SELECT id, CASE WHEN three THEN 'im' ELSE '' END AS i, three::BIGINT AS n, 'http://i/' || id AS u, CASE WHEN two THEN 'see' END AS l FROM notes",
    ),
    "notes_lists": (
        "select id, listItem.map('content').join('|') as c, list.count() as n, list.filter(ordered = true).count() as o, listItem.filter(children.count() > 0).count() as k from notes",
        NOTES + "SELECT id, 'a ' || id || 'bc|bc|c|d' || CASE WHEN three THEN '|one|two' ELSE '' END AS c, 3 + three::BIGINT AS n, three::BIGINT AS o, 2::BIGINT AS k FROM notes",
    ),
    "notes_html": ("select id, html.count() as n, html[0].content as h, inlineCode.map('content').join(',') as c from notes", NOTES + "SELECT id, two::BIGINT AS n, CASE WHEN two THEN '<section>' || chr(10) || id || chr(10) || '</section>' END AS h, 'c' || id AS c FROM notes"),
    "notes_sections": ("select id, section('Five ' + id).hierarchy.join('/') as h, sections().count() as n from notes", NOTES + "SELECT id, CASE WHEN two THEN name || '/Four' END AS h, 1 + 3 * two::BIGINT AS n FROM notes"),
    "notes_scans": (  # one parse for all patterns, elements and outlines
        r"select id, grep(/last (\w+)/).map('text').join(',') as a, grep(/INTRO/i)[0].section.join('/') as b, grep(/\bc\b/).count() as c, outline(1) as o from notes",
        NOTES + "SELECT id, CASE WHEN three THEN 'last words' ELSE '' END AS a, name AS b, 1::BIGINT AS c, '└── ' || name AS o FROM notes",
    ),
    "md_headings": ("select id, h1[0].title as h, h2.count() as n, h2.map('title').join(',') as t, h3[0].level as l from docs", DOCS + "SELECT o_orderkey AS id, 'Order ' || o_orderkey AS h, 2::BIGINT AS n, 'Items,Links' AS t, 3 AS l FROM docs"),
    "md_toc": ("select id, toc().map('title').join('/') as t, toc(2).count() as n, toc([1, 3]).count() as m from docs", DOCS + "SELECT o_orderkey AS id, 'Order ' || o_orderkey || '/Items/Links/Data' AS t, 2::BIGINT AS n, 2::BIGINT AS m FROM docs"),
    "md_outline": ("select id, outline(2) as o from docs", DOCS + "SELECT o_orderkey AS id, '└── Order ' || o_orderkey || chr(10) || '    ├── Items' || chr(10) || '    └── Links' AS o FROM docs"),
    "md_sections": ("select id, sections().map(hierarchy.count()).join('') as h, section('Links').level as l, section('No').title as none from docs", DOCS + "SELECT o_orderkey AS id, '0112' AS h, 2 AS l, NULL::VARCHAR AS none FROM docs"),
    "md_section_content": (
        "select id, section('Items').content as c from docs",
        DOCS + "SELECT o_orderkey AS id, CASE WHEN len(l) > 0 THEN array_to_string(list_transform(l, lambda x: '- [' || CASE WHEN x.r = 'R' THEN 'x' ELSE ' ' END || '] part ' || x.p), chr(10)) END AS c FROM docs",
    ),
    "md_has_section": ("select id from docs where has section('Links') and not has_section('Nope')", DOCS + "SELECT o_orderkey AS id FROM docs"),
    "md_in_toc": ("select id from docs where 'items' in toc() and h1('Order 1*').count() > 0", DOCS + "SELECT o_orderkey AS id FROM docs WHERE starts_with('Order ' || o_orderkey, 'Order 1')"),
    "md_links": (
        "select id, link.map('url').join(',') as u, links().map(section.count()).unique().join('') as s, link('*/1*').count() as n from docs",
        DOCS + "SELECT o_orderkey AS id, array_to_string(list_transform(l, lambda x: 'https://parts.example/' || x.p), ',') AS u, CASE WHEN len(l) > 0 THEN '2' ELSE '' END AS s, "
        "len(list_filter(l, lambda x: starts_with(x.p::VARCHAR, '1'))) AS n FROM docs",
    ),
    "md_link_wildcard": ("select id, link('*parts*').count() as a, link('https*').count() as b, link('*7').count() as c from docs", DOCS + "SELECT o_orderkey AS id, len(l) AS a, len(l) AS b, len(list_filter(l, lambda x: x.p % 10 = 7)) AS c FROM docs"),
    "md_images": ("select id, image[0].url as u, images()[0].alt as a from docs", DOCS + "SELECT o_orderkey AS id, 'p' || o_orderkey || '.png' AS u, 'pic' AS a FROM docs"),
    "md_code": ("select id, code[0].lang as l, code('F').count() as f, codeblocks()[0].content as c, inlineCode[0].content as i from docs", DOCS + "SELECT o_orderkey AS id, coalesce(l[1].st, 'none') AS l, (coalesce(l[1].st, 'none') = 'F')::BIGINT AS f, 'status ' || o_orderstatus AS c, 'code' AS i FROM docs"),
    "md_table": (
        "select id, table[0].headers.map('content').join(',') as h, tableRow.count() as r, tableCell.count() as c, tableRow.map(cells[1].content).join(',') as q from docs",
        DOCS + "SELECT o_orderkey AS id, 'line,quantity' AS h, len(l) AS r, 2 + 2 * len(l) AS c, array_to_string(list_transform(l, lambda x: x.q), ',') AS q FROM docs",
    ),
    "md_tasks": (
        "select id, listItem.filter(checked = true).count() as done, listItem.filter(checked = false).count() as open, list.count() as lists, listItem('part 1*').count() as ones from docs",
        DOCS + "SELECT o_orderkey AS id, len(list_filter(l, lambda x: x.r = 'R')) AS done, len(list_filter(l, lambda x: x.r <> 'R')) AS open, (len(l) > 0)::BIGINT AS lists, len(list_filter(l, lambda x: starts_with(x.p::VARCHAR, '1'))) AS ones FROM docs",
    ),
    "md_inline": (
        "select id, em[0].content as e, strong[0].content as s, del[0].content as d, blockquote[0].content as b, break.count() as k, footnote[0].label as f, html[0].content as h from docs",
        DOCS + "SELECT o_orderkey AS id, 'em ' || o_orderkey AS e, 'strong' AS s, 'gone' AS d, 'note ' || o_orderkey AS b, 1::BIGINT AS k, '1' AS f, '<div>raw</div>' AS h FROM docs",
    ),
    "md_references": ("select id, linkRef[0].identifier as r, def('r')[0].url as u, imageRef.count() as i from docs", DOCS + "SELECT o_orderkey AS id, 'r' AS r, 'https://ref.example/' || o_orderkey AS u, 0::BIGINT AS i FROM docs"),
    "md_body_namespace": ("select id, body.h1[0].title as t, body.blockquote.count() as n from docs", DOCS + "SELECT o_orderkey AS id, 'Order ' || o_orderkey AS t, 1::BIGINT AS n FROM docs"),
    "md_grep": (
        r"select id, grep(/call\((\d+)\)/)[0].captures[0] as c, grep(/TODO/)[0].column as k, grep(/todo/i).count() as n from docs",
        DOCS + "SELECT o_orderkey AS id, o_orderkey::VARCHAR AS c, 0 AS k, 1::BIGINT AS n FROM docs",
    ),
    "md_grep_text": ("select p_partkey, grep(p_name, /r/).count() as n from part", "SELECT p_partkey, length(p_name) - length(replace(p_name, 'r', '')) AS n FROM part"),
    "md_content_range": ("select id, content(1, 3) as c, content(1) as one from docs", DOCS + "SELECT o_orderkey AS id, '# Order ' || o_orderkey || chr(10) || chr(10) || '## Items' AS c, '# Order ' || o_orderkey AS one FROM docs"),
    "md_absent_field": ("select id from docs where priority is empty", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0"),
    "md_tags": ('select id from docs where tags any = "1-URGENT" and status = "F"', "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
    "md_group": ("select status, count(*) as n, max(total) as m from docs group by status", "SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1"),
    "content_prefilter": ('select doc_id from documents where text contains "idiot" or text contains "scum"', "SELECT doc_id FROM documents WHERE contains(text, 'idiot') OR contains(text, 'scum')"),
    "update_frame": ('update where o_orderstatus = "P" set o_totalprice = o_totalprice * 2, o_orderpriority = "x-" + o_orderpriority', "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'x-' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority FROM orders"),
    "delete_frame": ('delete where o_orderstatus != "F"', "SELECT * FROM orders WHERE o_orderstatus = 'F'"),
    "create_frame": ('create o_orderkey = 0 o_orderstatus = "N" o_totalprice:number = "12.5"', "SELECT * FROM orders UNION ALL SELECT 0, NULL, 'N', 12.5, NULL, NULL"),
    "trigger_deny": ('before update where old.o_orderstatus = "F" and new.o_totalprice > 100000 deny "closed"', "SELECT o_orderkey, 'closed' AS denied FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"),
    "trigger_update": (
        'update where o_totalprice > 300000 set o_totalprice = o_totalprice + 1',
        "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, "
        "CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 'was ' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority FROM orders",
    ),
}
TRIGGERS = {"trigger_update": ('before update where old.o_orderstatus = "F" and new.o_totalprice > old.o_totalprice set o_orderpriority = "was " + old.o_orderpriority',)}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The result of a catalogue query."""
    made = engine(spark, sf_dir)
    made.register_function("round_", lambda x: F.round(x, 2), returns=_double())
    made.default = "orders"
    if name == "trigger_deny":
        from mdframe.operators.mutate import trigger_frame

        rows = made.table("orders").frame
        return trigger_frame(made, CATALOG[name][0], rows, rows).where("denied is not null").select("o_orderkey", "denied")
    for trigger in TRIGGERS.get(name, ()):
        made.sql(trigger)
    return made.sql(CATALOG[name][0]).frame


def _double():
    from pyspark.sql import types as T

    return T.DoubleType()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "flagship")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in CATALOG} | {name: query for name, (query, _) in (FILES | OUTPUT).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (CATALOG | FILES | OUTPUT).items()}
