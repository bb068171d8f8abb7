"""The star graph: customers, suppliers, places, parts and orders of the given tables as one graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import Graph
from tessera.plans.registry import table


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    ident = lambda kind, key: F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))

    def node(df: DataFrame, kind: str, key: str, name, type_: str, attributes=None) -> DataFrame:
        return df.select(
            F.lit("g0").alias("graph_id"), ident(kind, key).alias("id"), name.alias("name"), F.lit(type_).alias("type"), F.concat(F.lit(f"a {type_} named "), name).alias("base_description"),
            (attributes if attributes is not None else F.create_map().cast("map<string,string>")).alias("base_attributes"), F.array(F.col(key).cast("long") % 7).alias("chunk_id"),
        )

    def edge(df: DataFrame, source, target, relation: str, weight, key) -> DataFrame:
        return df.select(F.lit("g0").alias("graph_id"), F.concat_ws(" ", source, F.lit(relation), target).alias("id"), source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.concat(F.lit("it "), F.lit(relation)).alias("description"), weight.cast("double").alias("weight"), (key.cast("long") % 7).alias("chunk_id"))

    orders, lines = t("orders"), t("lineitem")
    nodes = [
        node(t("region"), "region", "r_regionkey", F.col("r_name"), "location"),
        node(t("nation"), "nation", "n_nationkey", F.col("n_name"), "location"),
        node(t("customer"), "customer", "c_custkey", F.col("c_name"), "character"),
        node(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), "group"),
        node(t("part"), "part", "p_partkey", F.col("p_name"), "item"),
        node(orders, "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "event", F.create_map(F.lit("time"), F.date_format("o_orderdate", "yyyy-MM-dd"))),
    ]
    one = F.lit(1.0)
    nation, region, customer, order = (ident(k, c) for k, c in (("nation", "n_nationkey"), ("region", "n_regionkey"), ("customer", "o_custkey"), ("order", "o_orderkey")))
    after = orders.withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("next is not null")
    share = F.round(F.col("q") / 50, 4)
    edges = [
        edge(t("nation"), nation, region, "located in", one, F.col("n_nationkey")),
        edge(t("nation"), region, nation, "contains", one, F.col("n_nationkey")),
        edge(t("supplier"), ident("supplier", "s_suppkey"), ident("nation", "s_nationkey"), "located in", one, F.col("s_suppkey")),
        edge(t("customer"), ident("customer", "c_custkey"), ident("nation", "c_nationkey"), "lives in", one, F.col("c_custkey")),
        edge(orders, customer, order, "participates in", one, F.col("o_orderkey")),
        edge(orders, order, customer, "involves", one, F.col("o_orderkey")),
        edge(lines.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q")), ident("order", "l_orderkey"), ident("part", "l_partkey"), "affects", share, F.col("l_orderkey")),
        edge(lines.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")), ident("supplier", "l_suppkey"), ident("part", "l_partkey"), "provides", share, F.col("l_suppkey")),
        edge(after, order, ident("order", "next"), "precedes", one, F.col("o_orderkey")),
    ]
    both = [reduce(DataFrame.unionByName, x) for x in (nodes, edges)]
    return Graph(both[0], both[1])


def _sql() -> str:
    node = lambda frm, kind, key, name, type_: f"SELECT 'g0' AS graph_id, '{kind}_' || {key} AS id, {name} AS name, '{type_}' AS type, 'a {type_} named ' || {name} AS base_description, CAST({key} AS BIGINT) % 7 AS chunk FROM {frm}"
    edge = lambda frm, s, r, t, w, key: f"SELECT 'g0' AS graph_id, {s} || ' {r} ' || {t} AS id, {s} AS source, {t} AS target, '{r}' AS relation, 'it {r}' AS description, CAST({w} AS DOUBLE) AS weight, CAST({key} AS BIGINT) % 7 AS chunk_id FROM {frm}"
    nodes = " UNION ALL ".join([
        node("region", "region", "r_regionkey", "r_name", "location"), node("nation", "nation", "n_nationkey", "n_name", "location"),
        node("customer", "customer", "c_custkey", "c_name", "character"), node("supplier", "supplier", "s_suppkey", "s_name", "group"),
        node("part", "part", "p_partkey", "p_name", "item"), node("orders", "order", "o_orderkey", "'Order ' || o_orderkey", "event"),
    ])
    q = lambda a, b: f"(SELECT {a}, {b}, round(sum(l_quantity) / 50, 4) AS w FROM lineitem GROUP BY {a}, {b})"
    edges = " UNION ALL ".join([
        edge("nation", "'nation_' || n_nationkey", "located in", "'region_' || n_regionkey", "1", "n_nationkey"),
        edge("nation", "'region_' || n_regionkey", "contains", "'nation_' || n_nationkey", "1", "n_nationkey"),
        edge("supplier", "'supplier_' || s_suppkey", "located in", "'nation_' || s_nationkey", "1", "s_suppkey"),
        edge("customer", "'customer_' || c_custkey", "lives in", "'nation_' || c_nationkey", "1", "c_custkey"),
        edge("orders", "'customer_' || o_custkey", "participates in", "'order_' || o_orderkey", "1", "o_orderkey"),
        edge("orders", "'order_' || o_orderkey", "involves", "'customer_' || o_custkey", "1", "o_orderkey"),
        edge(q("l_orderkey", "l_partkey"), "'order_' || l_orderkey", "affects", "'part_' || l_partkey", "w", "l_orderkey"),
        edge(q("l_suppkey", "l_partkey"), "'supplier_' || l_suppkey", "provides", "'part_' || l_partkey", "w", "l_suppkey"),
        edge("(SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders) WHERE nx IS NOT NULL", "'order_' || o_orderkey", "precedes", "'order_' || nx", "1", "o_orderkey"),
    ])
    return f"nodes AS ({nodes}), edges AS ({edges})"


#: CTEs ``nodes`` and ``edges`` of the same graph, for the SQL of queries over it.
STAR = _sql()
