"""Driver queries for the engine's operators, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.filters import compile_filter
from docengine.operators import find as finding
from docengine.operators import graph, repair, triggers, updates
from docengine.operators.aggregate import aggregate
from docengine.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "supplier": "s_suppkey", "nation": "n_nationkey", "labels": "doc_id", "documents": "doc_id"}


def coll(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a collection: its key as ``_id``."""
    return raw(spark, d, name).withColumn("_id", F.col(KEYS[name]))


def orders_doc(spark: SparkSession, d: str) -> DataFrame:
    items = raw(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("items")
    )
    return coll(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def _find(name: str, table: str, filter_: dict, where: str, columns: str, **options: Any) -> None:
    names = columns.split(", ")

    @query(name, f"SELECT {columns} FROM {table} WHERE {where}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return finding.find(coll(spark, d, table), filter_, projection={"_id": 0} | dict.fromkeys(names, 1), **options)


O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_find("filter_eq", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", O)
_find("filter_ne_null", "orders", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus IS DISTINCT FROM 'F'", O)
_find("filter_range", "orders", {"o_totalprice": {"$gte": 50000, "$lt": 150000}}, "o_totalprice >= 50000 AND o_totalprice < 150000", O)
_find("filter_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')", O)
_find("filter_nin", "orders", {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", O)
_find("filter_regex_i", "part", {"p_type": {"$regex": "^standard|steel$", "$options": "i"}}, "regexp_matches(p_type, '^standard|steel$', 'i')", "p_partkey, p_name, p_type")
_find(
    "filter_and_or_nor_not", "orders",
    {"$and": [{"$or": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 200000}}]}, {"$nor": [{"o_orderpriority": "5-LOW"}]}], "o_custkey": {"$not": {"$lt": 100}}, "$not": {"o_orderkey": {"$lte": 10}}},
    "(o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT coalesce(o_orderpriority = '5-LOW', false) AND NOT coalesce(o_custkey < 100, false) AND NOT coalesce(o_orderkey <= 10, false)", O,
)


@query("filter_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def filter_exists(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(orders_doc(spark, d), {"items": {"$exists": True}, "nothing": {"$exists": False}}).select("o_orderkey")


@query("filter_exists_not", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def filter_exists_not(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(orders_doc(spark, d), {"items": {"$exists": False}}).select("o_orderkey")


@query("filter_regex_options", "SELECT p_partkey FROM part WHERE regexp_matches(p_name || chr(10) || p_type, 's.*E', 'is')")
def filter_regex_options(spark: SparkSession, d: str) -> DataFrame:
    docs = coll(spark, d, "part").withColumn("both", F.concat_ws("\n", "p_name", "p_type"))
    return finding.find(docs, {"both": {"$regex": "s.*E", "$options": "is"}}).select("p_partkey")


@query("filter_id_normalised", "SELECT c_custkey FROM customer WHERE c_custkey >= 0 AND CAST(c_custkey AS VARCHAR) IN ('3', '17', '99')")
def filter_id_normalised(spark: SparkSession, d: str) -> DataFrame:
    docs = raw(spark, d, "customer").withColumn("_id", F.col("c_custkey").cast("string"))
    return finding.find(docs, {"_id": {"$in": [3, {"$numberInt": "17"}, "99"]}}).select("c_custkey")


@query("filter_array_any", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def filter_array_any(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(orders_doc(spark, d), {"items.l_returnflag": "R"}).select("o_orderkey")


@query("filter_array_same_leaf", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10 AND l_quantity < 12)")
def filter_array_same_leaf(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(orders_doc(spark, d), {"items.l_quantity": {"$gt": 10, "$lt": 12}}).select("o_orderkey")


@query("find_sort_skip_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10")
def find_sort_skip_limit(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(coll(spark, d, "orders"), {"o_totalprice": {"$gte": 1000}}, sort={"o_totalprice": -1}, skip=10, limit=20).select("o_orderkey", "o_totalprice")


@query("find_topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 50")
def find_topk(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(coll(spark, d, "customer"), sort={"c_acctbal": 1}, limit=50).select("c_custkey", "c_acctbal")


@query("get_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    return finding.get(coll(spark, d, "customer"), 7).select("c_custkey", "c_name")


@query("project_include", "SELECT c_custkey AS _id, c_name, c_acctbal FROM customer")
def project_include(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(coll(spark, d, "customer"), projection={"c_name": 1, "c_acctbal": 1})


@query("project_exclude", "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def project_exclude(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(coll(spark, d, "customer"), projection={"c_acctbal": 0, "c_mktsegment": 0, "_id": 0})


@query(
    "group_sum_avg_min_max_count",
    "SELECT o_orderstatus AS _id, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY 1",
)
def group_sum_avg_min_max_count(spark: SparkSession, d: str) -> DataFrame:
    spec = {"_id": "$o_orderstatus", "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}, "n": {"$count": {}}}
    out = aggregate(coll(spark, d, "orders"), [{"$match": {"o_totalprice": {"$gte": 100000}}}, {"$group": spec}, {"$sort": {"_id": 1}}])
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query(
    "group_compound_key",
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2",
)
def group_compound_key(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(raw(spark, d, "lineitem"), [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "n": {"$sum": 1}}}])
    return out.select("_id.flag", "_id.status", F.round("qty", 2).alias("qty"), "n")


@query("group_null_key", "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
def group_null_key(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(coll(spark, d, "orders"), [{"$group": {"_id": None, "total": {"$sum": "$o_totalprice"}, "n": {"$count": {}}}}])
    return out.select(F.round("total", 2).alias("total"), "n")


@query(
    "group_first_last",
    "SELECT o_custkey AS _id, arg_min_null(o_orderkey, struct_pack(a := -o_totalprice, b := o_orderkey)) AS first, arg_max_null(o_orderkey, struct_pack(a := -o_totalprice, b := o_orderkey)) AS last FROM orders GROUP BY 1",
)
def group_first_last(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(coll(spark, d, "orders"), [{"$sort": {"o_totalprice": -1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}])


@query("group_push", "SELECT o_custkey AS _id, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def group_push(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(coll(spark, d, "orders"), [{"$sort": {"o_orderdate": 1}}, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}])
    return out.select("_id", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("group_add_to_set", "SELECT o_custkey AS _id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS seen FROM orders GROUP BY 1")
def group_add_to_set(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(coll(spark, d, "orders"), [{"$group": {"_id": "$o_custkey", "seen": {"$addToSet": "$o_orderpriority"}}}])
    return out.select("_id", F.array_join("seen", ",").alias("seen"))


@query("group_constant_literal", "SELECT 'all' AS _id, count(*) AS n, sum(o_custkey) AS keys, 'x' AS tag FROM orders")
def group_constant_literal(spark: SparkSession, d: str) -> DataFrame:
    spec = {"_id": "all", "n": {"$count": {}}, "keys": {"$sum": "$o_custkey"}, "tag": {"$min": {"$literal": "x"}}}
    return aggregate(coll(spark, d, "orders"), [{"$group": spec}]).withColumn("keys", F.col("keys").cast("long"))


@query("projection_list", "SELECT c_custkey AS _id, c_name FROM customer WHERE c_nationkey = 7")
def projection_list(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(coll(spark, d, "customer"), {"c_nationkey": 7}, projection=["c_name"])


@query("count_stage", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_stage(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(coll(spark, d, "orders"), [{"$match": {"o_orderstatus": "O"}}, {"$count": "n"}])


@query("count_filter", "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24")
def count_filter(spark: SparkSession, d: str) -> DataFrame:
    return finding.counted(raw(spark, d, "lineitem"), {"l_discount": {"$gt": 0.05}, "l_quantity": {"$lt": 24}})


@query("distinct_field", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_field(spark: SparkSession, d: str) -> DataFrame:
    return finding.distinct(coll(spark, d, "customer"), "c_mktsegment")


@query("distinct_array", "SELECT DISTINCT l_returnflag AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def distinct_array(spark: SparkSession, d: str) -> DataFrame:
    docs = orders_doc(spark, d).withColumn("flags", F.expr("transform(items, x -> x.l_returnflag)"))
    return finding.distinct(docs, "flags", {"o_orderstatus": "F"})


@query("unwind", "SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def unwind(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(orders_doc(spark, d), [{"$unwind": "$items"}])
    return out.select("o_orderkey", "items.l_linenumber", "items.l_partkey", "items.l_quantity")


@query("unwind_preserve", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def unwind_preserve(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(orders_doc(spark, d), [{"$unwind": {"path": "$items", "preserveNullAndEmptyArrays": True}}])
    return out.select("o_orderkey", "items.l_linenumber")


@query("lookup", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    spec = {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}
    out = aggregate(coll(spark, d, "customer"), [{"$lookup": spec}], {"orders": coll(spark, d, "orders")})
    total = F.aggregate("orders", F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.round(total, 2).alias("total"))


@query("lookup_unwind", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 100000")
def lookup_unwind(spark: SparkSession, d: str) -> DataFrame:
    spec = {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "buyer"}
    out = aggregate(coll(spark, d, "orders"), [{"$lookup": spec}, {"$unwind": "$buyer"}, {"$match": {"o_totalprice": {"$gte": 100000}}}], {"customer": coll(spark, d, "customer")})
    return out.select("o_orderkey", "buyer.c_name", "o_totalprice")


@query("lookup_empty", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lookup_empty(spark: SparkSession, d: str) -> DataFrame:
    spec = {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "label"}
    docs = coll(spark, d, "documents").drop("text")
    out = aggregate(docs, [{"$lookup": spec}], {"labels": coll(spark, d, "labels")})
    return out.where(F.size("label") == 0).select("doc_id", "lang")


@query("lookup_foreign_array", "SELECT p_partkey, count(DISTINCT l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def lookup_foreign_array(spark: SparkSession, d: str) -> DataFrame:
    spec = {"from": "orders", "localField": "p_partkey", "foreignField": "items.l_partkey", "as": "orders"}
    out = aggregate(coll(spark, d, "part"), [{"$lookup": spec}], {"orders": orders_doc(spark, d)})
    return out.select("p_partkey", F.size("orders").cast("long").alias("n"))


@query(
    "lookup_local_path",
    "WITH o AS (SELECT o_orderkey, min(l_linenumber) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o.o_orderkey, count(l_partkey) AS n FROM o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.k JOIN part ON p_partkey = l_partkey GROUP BY 1",
)
def lookup_local_path(spark: SparkSession, d: str) -> DataFrame:
    docs = orders_doc(spark, d).where("items is not null").withColumn("lead", F.struct(F.col("items")[0]["l_linenumber"].alias("k"))).select("_id", "o_orderkey", "lead")
    lines = raw(spark, d, "lineitem").withColumn("_id", F.concat_ws("-", "l_orderkey", "l_linenumber", F.monotonically_increasing_id()))
    spec = {"from": "lines", "localField": "lead.key", "foreignField": "key", "as": "found"}
    docs = docs.withColumn("lead", F.struct(F.concat_ws(":", "o_orderkey", "lead.k").alias("key")))
    out = aggregate(docs, [{"$lookup": spec}], {"lines": lines.withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))})
    return out.select("o_orderkey", F.size("found").cast("long").alias("n"))


@query("pipeline_sort_lookup_page", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 15")
def pipeline_sort_lookup_page(spark: SparkSession, d: str) -> DataFrame:
    spec = {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "buyer"}
    out = aggregate(coll(spark, d, "orders"), [{"$sort": {"o_totalprice": -1}}, {"$lookup": spec}, {"$skip": 15}, {"$limit": 40}], {"customer": coll(spark, d, "customer")}, optimise=False)
    return out.select("o_orderkey", F.col("buyer")[0]["c_name"].alias("c_name"))


@query("pipeline_sort_unwind_page", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey ORDER BY o_totalprice DESC, o_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice LIMIT 100 OFFSET 7")
def pipeline_sort_unwind_page(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(orders_doc(spark, d), [{"$sort": {"o_totalprice": -1}}, {"$unwind": "$items"}, {"$skip": 7}, {"$limit": 100}])
    return out.select("o_orderkey", "items.l_linenumber")


@query("batch_in_join", "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
def batch_in_join(spark: SparkSession, d: str) -> DataFrame:
    spec = {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}
    dear = finding.find(coll(spark, d, "orders"), {"o_totalprice": {"$gt": 200000}}).select("_id", "o_custkey")
    out = aggregate(coll(spark, d, "customer"), [{"$lookup": spec}, {"$match": {"orders": {"$ne": []}}}], {"orders": dear})
    return out.where(F.size("orders") > 0).select("c_custkey", "c_name")


@query("pipeline_match_after_group", "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def pipeline_match_after_group(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(coll(spark, d, "orders"), [{"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 15}}}])


@query("pipeline_project_sort_page", "SELECT c_custkey AS _id, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name DESC, c_custkey LIMIT 30 OFFSET 5")
def pipeline_project_sort_page(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(coll(spark, d, "customer"), [{"$project": {"c_name": 1, "c_mktsegment": 1}}, {"$sort": {"c_name": -1}}, {"$match": {"c_mktsegment": "BUILDING"}}, {"$skip": 5}, {"$limit": 30}, {"$project": {"c_name": 1}}])


def _update(name: str, table: str, filter_: dict, update: dict, columns: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = coll(spark, d, table)
        return updates.updated(df, update, compile_filter(filter_, df.schema, strict=True)).select(*columns.split(", "))


_update("upd_set", "orders", {"o_orderstatus": "F"}, {"$set": {"o_orderpriority": "DONE", "note": "x"}}, "o_orderkey, o_orderpriority, note", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'x' END AS note FROM orders")
_update("upd_inc_mul", "customer", {"c_mktsegment": "BUILDING"}, {"$inc": {"c_nationkey": 100, "visits": 1}, "$mul": {"c_acctbal": 2}}, "c_custkey, c_nationkey, visits, c_acctbal", "SELECT c_custkey, CAST(c_nationkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 100 ELSE 0 END AS BIGINT) AS c_nationkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END AS BIGINT) AS visits, c_acctbal * CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS c_acctbal FROM customer")
_update("upd_min_max", "customer", {}, {"$min": {"c_acctbal": 5000.0}, "$max": {"c_nationkey": 10}}, "c_custkey, c_acctbal, c_nationkey", "SELECT c_custkey, least(c_acctbal, 5000.0) AS c_acctbal, CAST(greatest(c_nationkey, 10) AS BIGINT) AS c_nationkey FROM customer")
_update("upd_unset", "customer", {"c_acctbal": {"$lt": 0}}, {"$unset": {"c_mktsegment": ""}}, "c_custkey, c_mktsegment", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
_update("upd_rename", "customer", {}, {"$rename": {"c_mktsegment": "segment"}}, "c_custkey, c_mktsegment, segment", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_mktsegment, c_mktsegment AS segment FROM customer")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    made = F.array("c_mktsegment", F.lit("x"), F.when(F.col("c_nationkey") > 10, "BUILDING").otherwise("y"))
    return coll(spark, d, "customer").select("_id", "c_custkey", made.alias("tags"))


TAGS = "[c_mktsegment, 'x', CASE WHEN c_nationkey > 10 THEN 'BUILDING' ELSE 'y' END]"


def _array(name: str, update: dict, sql: str) -> None:
    @query(name, f"SELECT c_custkey, array_to_string({sql.format(t=TAGS)}, ',') AS tags FROM customer")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return updates.updated(_tags(spark, d), update).select("c_custkey", F.array_join("tags", ",").alias("tags"))


_array("upd_push_slice", {"$push": {"tags": {"$each": ["p", "q"], "$slice": -4}}}, "list_concat({t}, ['p', 'q'])[2:5]")
_array("upd_push_position", {"$push": {"tags": {"$each": ["p"], "$position": 1}}}, "list_concat({t}[1:1], ['p'], {t}[2:3])")
_array("upd_add_to_set", {"$addToSet": {"tags": "BUILDING"}}, "CASE WHEN list_contains({t}, 'BUILDING') THEN {t} ELSE list_append({t}, 'BUILDING') END")
_array("upd_pop", {"$pop": {"tags": -1}}, "{t}[2:3]")
_array("upd_pull", {"$pull": {"tags": "BUILDING"}}, "list_filter({t}, lambda x: x <> 'BUILDING')")
_array("upd_pull_all", {"$pullAll": {"tags": ["x", "y"]}}, "list_filter({t}, lambda x: x NOT IN ('x', 'y'))")


_array("upd_pull_condition", {"$pull": {"tags": {"$in": ["x", "BUILDING"]}}}, "list_filter({t}, lambda x: x NOT IN ('x', 'BUILDING'))")


@query("upd_current_date", "SELECT c_custkey, true AS recent FROM customer WHERE c_nationkey < 5")
def upd_current_date(spark: SparkSession, d: str) -> DataFrame:
    out = updates.updated(coll(spark, d, "customer").where("c_nationkey < 5"), {"$currentDate": {"seen": True}})
    return out.select("c_custkey", (F.abs(F.unix_seconds(F.col("seen").cast("timestamp")) - F.unix_seconds(F.current_timestamp())) < 90_000).alias("recent"))


def _customers(spark: SparkSession, d: str):
    rows = raw(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("_id"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return _stored(spark, rows, "customer")


def _building(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "customer").where("c_mktsegment = 'BUILDING'")


@query("upsert_replace", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_mktsegment = 'BUILDING'")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    """An upsert of the documents of one segment, and of as many new ones, through the store."""
    customers, keys = _customers(spark, d), _building(spark, d).select("c_custkey")
    new = keys.unionByName(keys.select((F.col("c_custkey") + 10000000).alias("c_custkey")))
    customers.upsert(new.select(F.col("c_custkey").cast("string").alias("_id"), "c_custkey", F.lit("new").alias("c_name")))
    return customers.df.select("c_custkey", "c_name")


@query("store_merge", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS c_name FROM customer")
def store_merge(spark: SparkSession, d: str) -> DataFrame:
    customers = _customers(spark, d)
    customers.merge(_building(spark, d).select(F.col("c_custkey").cast("string").alias("_id"), (F.col("c_acctbal") + 1).alias("c_acctbal")), remove=["c_name"])
    return customers.df.select("c_custkey", "c_acctbal", "c_name")


@query("store_update_many", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'late' END AS note FROM customer")
def store_update_many(spark: SparkSession, d: str) -> DataFrame:
    customers = _customers(spark, d)
    customers.update({"c_acctbal": {"$lt": 0}}, {"$inc": {"c_acctbal": 100}, "$set": {"note": "late"}, "$setOnInsert": {"made": True}}, multi=True)
    return customers.df.select("c_custkey", "c_acctbal", "note")


@query("store_update_upserts", "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS made FROM customer UNION ALL SELECT -5, 'none', 'now'")
def store_update_upserts(spark: SparkSession, d: str) -> DataFrame:
    """$setOnInsert and the filter's equalities seed the new document."""
    customers = _customers(spark, d)
    customers.update({"c_custkey": -5, "_id": "x"}, {"$set": {"c_name": "none"}, "$setOnInsert": {"made": "now"}}, upsert=True)
    return customers.df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "made")


@query("store_insert_rejects", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 10000000, 'second' FROM customer WHERE c_mktsegment = 'BUILDING'")
def store_insert_rejects(spark: SparkSession, d: str) -> DataFrame:
    """An unordered insert of known and new ids: known ones stay as they are."""
    customers, keys = _customers(spark, d), _building(spark, d).select("c_custkey")
    more = keys.unionByName(keys.select((F.col("c_custkey") + 10000000).alias("c_custkey")))
    customers.insert(more.select(F.col("c_custkey").cast("string").alias("_id"), "c_custkey", F.lit("second").alias("c_name")), ordered=False)
    return customers.df.select("c_custkey", "c_name")


@query("store_find_and_modify", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 1) THEN 'top' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey <> (SELECT c_custkey FROM customer ORDER BY c_acctbal, CAST(c_custkey AS VARCHAR) LIMIT 1)")
def store_find_and_modify(spark: SparkSession, d: str) -> DataFrame:
    customers = _customers(spark, d)
    customers.find_and_modify({}, sort={"c_acctbal": -1}, update={"$set": {"c_mktsegment": "top"}})
    customers.find_and_modify({}, sort={"c_acctbal": 1}, remove=True)
    return customers.df.select("c_custkey", "c_mktsegment")


@query("delete_many", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 100000 AND o_orderstatus = 'O', false)")
def delete_many(spark: SparkSession, d: str) -> DataFrame:
    orders = _stored(spark, raw(spark, d, "orders").withColumn("_id", F.col("o_orderkey").cast("string")), "orders")
    orders.delete({"o_totalprice": {"$lt": 100000}, "o_orderstatus": "O"})
    return orders.df.select("o_orderkey")


@query("store_versions", "SELECT 'count' AS what, CAST((SELECT count(*) FROM customer) AS BIGINT) AS n UNION ALL SELECT 'after compact', (SELECT count(*) FROM customer) UNION ALL SELECT 'snapshot', (SELECT count(*) FROM customer) UNION ALL SELECT 'indexes', 1 UNION ALL SELECT 'parts', 1")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """Stats, compaction and a snapshot opened again."""
    from docengine.sources.store import Database

    customers = _customers(spark, d)
    customers.ensure_index(["c_name"], unique=True)
    rows = [("count", customers.stats()["count"])]
    customers.db.compact()
    rows.append(("after compact", customers.count()))
    target = f"{customers.db.root}-copy"
    customers.db.snapshot(target)
    rows.append(("snapshot", Database(spark, target)["customer"].count()))
    rows += [("indexes", customers.stats()["nindexes"]), ("parts", len(customers.meta["parts"]))]
    return spark.createDataFrame(rows, "what string, n long")


@query("store_repair", "SELECT c_mktsegment AS _id, count(*) AS n FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer GROUP BY c_name) GROUP BY 1")
def store_repair(spark: SparkSession, d: str) -> DataFrame:
    customers = _customers(spark, d)
    customers.ensure_index(["c_name"], unique=True)
    customers.repair()
    return customers.aggregate([{"$group": {"_id": "$c_mktsegment", "n": {"$count": {}}}}])


@query("import_export_ndjson", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def import_export_ndjson(spark: SparkSession, d: str) -> DataFrame:
    customers = _customers(spark, d)
    path = f"{customers.db.root}/out.ndjson"
    io.export(customers.df, path, "ndjson", {"c_acctbal": {"$gt": 0}})
    back = customers.db.create("back")
    io.import_into(back, path, "ndjson")
    return back.df.select("_id", "c_name", "c_acctbal")


@query("import_export_csv", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer")
def import_export_csv(spark: SparkSession, d: str) -> DataFrame:
    """The engine's one CSV file with its byte-order mark, read back with types found anew."""
    customers = _customers(spark, d)
    path = f"{customers.db.root}/out.csv"
    io.export_csv(customers.df, path, hidden=["c_mktsegment"])
    back = customers.db.create("back")
    io.import_into(back, path)
    return back.df.select("_id", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("graph_edges_with_props", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'c:' || o_custkey AS _from, 'o:' || o_orderkey AS _to, o_totalprice AS weight FROM orders WHERE o_custkey = 7 ORDER BY 1")
def graph_edges_with_props(spark: SparkSession, d: str) -> DataFrame:
    edges = raw(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), F.concat(F.lit("c:"), "o_custkey").alias("_from"), F.concat(F.lit("o:"), "o_orderkey").alias("_to"), F.col("o_totalprice").alias("weight"))
    return graph.incident(edges, "c:7").select("_id", "_from", "_to", "weight")


@query("trigger_update_action", "SELECT c_custkey, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'BUYER' END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
def trigger_update_action(spark: SparkSession, d: str) -> DataFrame:
    """An insert of orders updates their customers through a trigger."""
    customers = _customers(spark, d)
    action = {"type": "update", "collection": "customer", "id": {"$get": "o_custkey"}, "fields": {"c_mktsegment": "BUYER"}}
    customers.db.create_trigger(triggers.Trigger("after_insert", "orders", [action], {"o_totalprice": {"$gt": 300000}}))
    customers.db.create("orders").insert(raw(spark, d, "orders").withColumn("_id", F.col("o_orderkey").cast("string")))
    return customers.df.select("c_custkey", "c_mktsegment")


@query("command_aggregate_pages", "SELECT o_orderstatus AS _id, count(*) AS n FROM orders GROUP BY 1")
def command_aggregate_pages(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate command, its cursor read in pages of one."""
    from docengine.commands import Commands
    from docengine.sources.store import Database

    db = Database(spark, f"{_scratch(spark)}/commands-{uuid.uuid4().hex}")
    db.register("orders", coll(spark, d, "orders"))
    run = Commands(db).run
    reply = run({"aggregate": "orders", "pipeline": [{"$group": {"_id": "$o_orderstatus", "n": {"$count": {}}}}], "cursor": {"batchSize": 1}})["cursor"]
    rows = list(reply["firstBatch"])
    while reply["id"]:
        reply = run({"getMore": reply["id"], "collection": "orders", "batchSize": 1})["cursor"]
        rows += reply["nextBatch"]
    return spark.createDataFrame([(r["_id"], r["n"]) for r in rows], "_id string, n long")


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each nation to the next by key, and to the first of its region."""
    n = raw(spark, d, "nation")
    ring = n.select(F.concat(F.lit("n:"), "n_nationkey").alias("_from"), F.concat(F.lit("n:"), (F.col("n_nationkey") + 1) % 25).alias("_to"))
    home = n.select(F.concat(F.lit("n:"), "n_nationkey").alias("_from"), F.concat(F.lit("n:"), "n_regionkey").alias("_to"))
    return ring.unionByName(home)


EDGES = "e AS (SELECT 'n:' || n_nationkey AS s, 'n:' || ((n_nationkey + 1) % 25) AS t FROM nation UNION SELECT 'n:' || n_nationkey, 'n:' || n_regionkey FROM nation)"


@query("graph_neighbors_both", f"WITH {EDGES} SELECT DISTINCT t AS vertex FROM (SELECT s, t FROM e UNION SELECT t, s FROM e) x(s, t) WHERE s = 'n:3'")
def graph_neighbors_both(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(nation_edges(spark, d), "n:3", graph.BOTH)


@query(
    "graph_traverse",
    f"WITH RECURSIVE {EDGES}, w(v, k) AS (SELECT 'n:7', 0 UNION SELECT t, k + 1 FROM w JOIN e ON s = v WHERE k < 4) SELECT v AS vertex, CAST(min(k) AS INTEGER) AS depth FROM w GROUP BY 1",
)
def graph_traverse(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(nation_edges(spark, d), "n:7", max_depth=4)


PAIRS = [("n:20", "n:3"), ("n:24", "n:7"), ("n:9", "n:9"), ("n:20", "n:19")]


@query(
    "graph_shortest_path",
    f"WITH RECURSIVE {EDGES}, q(a, b) AS (VALUES {', '.join(map(str, PAIRS))}), w(a, v, p) AS (SELECT a, a, [a] FROM q UNION SELECT a, t, list_append(p, t) FROM w JOIN e ON s = v WHERE len(p) < 7 AND NOT list_contains(p, t)), f AS (SELECT q.a, q.b, p, row_number() OVER (PARTITION BY q.a, q.b ORDER BY len(p), p) AS k FROM q JOIN w ON w.a = q.a AND w.v = q.b) SELECT q.a AS start, q.b AS stop, array_to_string(p, '>') AS path FROM q LEFT JOIN f ON f.a = q.a AND f.b = q.b AND k = 1",
)
def graph_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths with ties, to the start itself, and one that is too long."""
    edges = nation_edges(spark, d)
    found = [(a, b, graph.shortest_path(edges, a, b)) for a, b in PAIRS]
    return spark.createDataFrame([(a, b, ">".join(p) if p else None) for a, b, p in found], "start string, stop string, path string")


@query("graph_bought_contains", "SELECT DISTINCT 'c:' || o_custkey AS customer, 'p:' || l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def graph_bought_contains(spark: SparkSession, d: str) -> DataFrame:
    bought = raw(spark, d, "orders").select(F.concat(F.lit("c:"), "o_custkey").alias("_from"), F.concat(F.lit("o:"), "o_orderkey").alias("_to"))
    contains = raw(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("o:"), "l_orderkey").alias("_from"), F.concat(F.lit("p:"), "l_partkey").alias("_to"))
    a, b = graph.steps(bought), graph.steps(contains)
    return a.join(b, a["dst"] == b["src"]).select(a["src"].alias("customer"), b["dst"].alias("part")).distinct()


@query("trigger_after_insert_audit", "SELECT 'orders' AS src, o_orderkey AS ref, o_orderstatus AS status FROM orders WHERE o_totalprice > 150000")
def trigger_after_insert_audit(spark: SparkSession, d: str) -> DataFrame:
    action = {"type": "insert", "collection": "audit", "doc": {"src": "orders", "ref": {"$get": "_id"}, "status": {"$get": "o_orderstatus"}}}
    t = triggers.Trigger("after_insert", "orders", [action], {"o_totalprice": {"$gt": 150000}})
    triggers.validate(t)
    return triggers.rows(t, action, coll(spark, d, "orders"))


@query("trigger_before_set", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true END AS vip, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def trigger_before_set(spark: SparkSession, d: str) -> DataFrame:
    t = triggers.Trigger("before_insert", "orders", [{"type": "set", "fields": {"vip": True}}, {"type": "unset", "fields": ["o_orderpriority"]}], {"o_orderstatus": "F"})
    return triggers.before(t, coll(spark, d, "orders")).select("o_orderkey", "vip", "o_orderpriority")


@query("rbac_field_deny", "SELECT * EXCLUDE (c_acctbal) FROM customer WHERE c_mktsegment = 'MACHINERY'")
def rbac_field_deny(spark: SparkSession, d: str) -> DataFrame:
    from docengine.operators.security import Permission
    from docengine.sources.store import Database

    db = Database(spark, f"{_scratch(spark)}/rbac-{uuid.uuid4().hex}")
    db.register("customer", coll(spark, d, "customer"))
    db.security.create_role("reader", [Permission("customer", read=True, field_deny=["c_acctbal"])])
    db.security.create_user("reader", "secret", ["reader"])
    return db.security.authenticate("reader", "secret").find("customer", {"c_mktsegment": "MACHINERY"}).drop("_id")


def _scratch(spark: SparkSession) -> str:
    from docengine.plans.lineage import shared_dir

    return f"{shared_dir(spark)}/docengine-{spark.sparkContext.applicationId}"


def _stored(spark: SparkSession, rows: DataFrame, name: str):
    """A collection of these rows in a scratch database of its own."""
    from docengine.sources.store import Database

    made = Database(spark, f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}").create(name)
    made.insert(rows)
    return made


@query("export_csv_shape", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")
def export_csv_shape(spark: SparkSession, d: str) -> DataFrame:
    return io.export_columns(coll(spark, d, "customer"), hidden=["c_acctbal"])


@query("fields_discovery", "SELECT path, type, n FROM (VALUES ('event_id', 'number', (SELECT count(event_id) FROM events)), ('ts', 'date', (SELECT count(ts) FROM events)), ('user_id', 'number', (SELECT count(user_id) FROM events)), ('event_type', 'string', (SELECT count(event_type) FROM events)), ('value', 'number', (SELECT count(value) FROM events)), ('props', 'string', (SELECT count(props) FROM events))) v(path, type, n)")
def fields_discovery(spark: SparkSession, d: str) -> DataFrame:
    return io.discovered(raw(spark, d, "events"))


@query("fields_nested", "SELECT * FROM (VALUES ('_id', 'number'), ('o_custkey', 'number'), ('o_orderdate', 'date'), ('o_orderkey', 'number'), ('o_orderpriority', 'string'), ('o_orderstatus', 'string'), ('o_totalprice', 'number'), ('items', 'array'), ('buyer', 'object'), ('buyer.key', 'number'), ('buyer.name', 'string')) v(path, type)")
def fields_nested(spark: SparkSession, d: str) -> DataFrame:
    docs = orders_doc(spark, d).withColumn("buyer", F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("name")))
    found = io.discover(docs, max_scan=1 << 30)
    return spark.createDataFrame(sorted(found["types"].items()), "path string, type string")


@query("repair_dedupe", "SELECT o_custkey AS _id, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def repair_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "orders").select(F.col("o_custkey").alias("_id"), "o_orderkey")
    return repair.first_by(rows, ["_id"], [F.col("o_orderkey")])


@query("resolve_ids", "SELECT CAST(k AS VARCHAR) AS _id, CASE WHEN k IN (SELECT c_custkey FROM customer) THEN 'customer' ELSE 'part' END AS collection FROM (SELECT c_custkey AS k FROM customer UNION SELECT p_partkey FROM part)")
def resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: coll(spark, d, n).withColumn("_id", F.col(KEYS[n]).cast("string")) for n in ("customer", "part")}
    ids = tables["customer"].select("_id").union(tables["part"].select("_id"))
    return graph.resolve_ids(ids, tables).select("_id", "collection")


@query("unique_conflicts", "SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def unique_conflicts(spark: SparkSession, d: str) -> DataFrame:
    from docengine.operators.indexes import Index, conflicts

    return conflicts(coll(spark, d, "customer"), Index(("c_mktsegment",), True)).select(F.col("__k0").alias("key"), "n")


@query("variant_filter", "SELECT CAST(event_id AS VARCHAR) AS _id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def variant_filter(spark: SparkSession, d: str) -> DataFrame:
    from docengine.functions import variant

    text = F.concat(F.lit('{"_id": "'), F.col("event_id").cast("string"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    docs = variant.from_json_rows(raw(spark, d, "events").select(text.alias("json")))
    return docs.where(compile_filter({"props.k": {"$gte": 50}}, docs.schema)).select("_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(
        coll(spark, d, "orders"),
        [{"$match": {"o_totalprice": {"$gte": 100000}}}, {"$group": {"_id": "$o_orderstatus", "total": {"$sum": "$o_totalprice"}, "cnt": {"$count": {}}}}, {"$sort": {"_id": 1}}],
    )
