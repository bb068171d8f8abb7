"""Whole builds of graph tables: entities first, names first, mentions first.

Replies of models come in as parsed tables (see ``responses`` and ``extraction``), so a build
is joins and grouping only. ``resolve`` maps nodes (graph_id, id, ord, name, type, ...) to
members (graph_id, id, leader); ``by_name`` is the plainest, ``resolution.clusters`` over
``resolution.similar_pairs`` another. Event impacts follow with ``temporal``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import extraction as E
from tessera.operators import resolution as R
from tessera.operators.graph import Graph

Resolve = Callable[[DataFrame], DataFrame]
_KEY = ["graph_id", "id"]


def by_name(nodes: DataFrame) -> DataFrame:
    """Members: nodes of one type and lower-case name follow the first of them."""
    keyed = nodes.select("graph_id", "type", F.lower(F.trim("name")).alias("key"), "id", "ord")
    first = keyed.groupBy("graph_id", "type", "key").agg(F.min_by("id", "ord").alias("leader"))
    return keyed.join(first, ["graph_id", "type", "key"]).select(*_KEY, "leader")


def _nodes(rows: DataFrame) -> DataFrame:
    """entity_nodes with the columns that merging needs."""
    empty = F.create_map().cast("map<string,string>")
    has = lambda c, other: F.coalesce(c, other) if c in rows.columns else other
    return rows.withColumns({"ord": F.struct(*E.ORDER), "base_description": has("description", F.lit("")), "base_attributes": has("attributes", empty), "chunks": F.array("chunk_id")})


def _merged(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> Graph:
    merged = R.combine(nodes.drop("chunk_id").withColumnRenamed("chunks", "chunk_id"), members)
    return Graph(merged, R.remap_edges(edges, members))


def from_entities(entities: DataFrame, relations: DataFrame, resolve: Resolve = by_name, missing: DataFrame | None = None) -> Graph:
    """Described entities become nodes, those of a completion (``missing``, same columns) too; relations
    join them by name within their chunk; similar nodes are merged and edges follow."""
    nodes = E.entity_nodes(entities)
    if missing is not None:
        nodes = nodes.unionByName(E.complete_entities(nodes, missing), allowMissingColumns=True)
    nodes = _nodes(nodes)
    return _merged(nodes, E.relation_edges(relations, nodes), resolve(nodes))


def from_names(names: DataFrame, found: DataFrame, relations: DataFrame, resolve: Resolve = by_name) -> Graph:
    """Names are merged first; found entities (name, type, description) then describe them, or add
    nodes of their own; relations join names in the whole graph. names: an entity's columns without
    description. Nodes: graph_id, id, name, type, description, chunk_id."""
    named = _nodes(E.entity_nodes(names.select("graph_id", *E.ORDER, "name", "type")))
    members = resolve(named)
    known = R.combine(named.drop("chunk_id").withColumnRenamed("chunks", "chunk_id"), members)
    alias = named.join(members, _KEY).select("graph_id", *E.ORDER, "name", F.col("leader").alias("id"))
    key = F.lower(F.trim("name")).alias("key")
    ids = alias.groupBy("graph_id", key).agg(F.min_by("id", F.struct(*E.ORDER)).alias("known_id"))
    told = found.withColumn("key", F.lower(F.trim("name"))).join(ids, ["graph_id", "key"], "left")
    told = told.withColumn("id", F.coalesce("known_id", X.create_id(F.col("name")))).where("id <> ''")
    nodes = E.enrich_nodes(known.select(*_KEY, "name", "type", F.lit("").alias("description")), told)
    places = alias.select(*_KEY, *E.ORDER, "name").unionByName(told.select(*_KEY, *E.ORDER, "name"))
    chunks = places.groupBy(*_KEY).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_id"))
    return Graph(nodes.join(chunks, _KEY), E.relation_edges(relations, places, per_chunk=False))


def from_mentions(mentions: DataFrame, found: DataFrame, relations: DataFrame, resolve: Resolve = by_name) -> Graph:
    """from_names on fused mentions: graph_id, chunk_id, text, type; within a chunk in order of their texts."""
    place = F.row_number().over(Window.partitionBy("graph_id", "chunk_id").orderBy("text", "type"))
    return from_names(mentions.select("graph_id", "chunk_id", place.alias("pos"), F.col("text").alias("name"), "type"), found, relations, resolve)
