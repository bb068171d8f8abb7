"""Graph tables: nodes, edges and headers keyed by graph_id, and what is done to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Display colours.
COLOURS = {"character": "#ff6b6b", "group": "#ffa94d", "location": "#4dabf7", "environment_element": "#69db7c", "item": "#f783ac", "event": "#9775fa"}
NODE_KEY, EDGE_KEY = ["graph_id", "id"], ["graph_id", "source", "target", "relation"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    header: DataFrame | None = None


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables, those of ``new`` in place of old ones with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def put_nodes(g: Graph, new: DataFrame) -> Graph:
    return Graph(latest(g.nodes, new, NODE_KEY), g.edges, g.header)


def put_edges(g: Graph, new: DataFrame) -> Graph:
    """Edges without an end are dropped; the same (source, target, relation) is overwritten."""
    return Graph(g.nodes, latest(g.edges, new.where("source is not null and target is not null"), EDGE_KEY), g.header)


def node_by_name(g: Graph, requests: DataFrame) -> DataFrame:
    """requests: graph_id, name. The first node (least id) of that exact name."""
    hit = g.nodes.join(requests.distinct(), ["graph_id", "name"])
    return hit.groupBy("graph_id", "name").agg(F.min("id").alias("id"))


def by_id(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: graph_id, id; requests without a row give nulls."""
    return requests.join(rows, ["graph_id", "id"], "left")


def edges_between(g: Graph, pairs: DataFrame) -> DataFrame:
    return g.edges.join(pairs.select("graph_id", "source", "target").distinct(), ["graph_id", "source", "target"], "left_semi")


def neighbours(g: Graph, nodes: DataFrame) -> DataFrame:
    """nodes: graph_id, id. Distinct out-neighbours as (graph_id, id, neighbour)."""
    out = nodes.select("graph_id", F.col("id").alias("source")).join(g.edges, ["graph_id", "source"])
    return out.select("graph_id", F.col("source").alias("id"), F.col("target").alias("neighbour")).distinct()


def _update(rows: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    new = changes.select("graph_id", "id", *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(new, ["graph_id", "id"], "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def update_nodes(g: Graph, changes: DataFrame) -> Graph:
    """Name, description, attributes, states and chunks are replaced where given; the type stays."""
    fields = [f for f in ("name", "base_description", "base_attributes", "states", "chunk_id") if f in changes.columns and f in g.nodes.columns]
    return Graph(_update(g.nodes, changes, fields), g.edges, g.header)


def update_edges(g: Graph, changes: DataFrame) -> Graph:
    """Ends, relation, weight, times and chunk are replaced where given; the description stays."""
    fields = [f for f in ("source", "target", "relation", "weight", "time_start_event", "time_end_event", "chunk_id") if f in changes.columns and f in g.edges.columns]
    return Graph(g.nodes, _update(g.edges, changes, fields), g.header)


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Nodes go together with the edges that touch them."""
    gone = ids.select("graph_id", "id").distinct()
    edges = g.edges
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("id", end), ["graph_id", end], "left_anti")
    return Graph(g.nodes.join(gone, NODE_KEY, "left_anti"), edges.select(*g.edges.columns), g.header)


def remove_edges(g: Graph, ids: DataFrame) -> Graph:
    return Graph(g.nodes, g.edges.join(ids.select("graph_id", "id").distinct(), NODE_KEY, "left_anti"), g.header)


def repair_dangling(g: Graph) -> Graph:
    """Ends without a node get a placeholder node with an empty chunk list."""
    ends = g.edges.select("graph_id", F.explode(F.array("source", "target")).alias("id")).where("id is not null").distinct()
    lost = ends.join(g.nodes.select("graph_id", "id"), NODE_KEY, "left_anti")
    made = lost.select("graph_id", "id", F.col("id").alias("name"), F.lit("item").alias("type"), F.lit("Auto-created missing node").alias("base_description"), F.array().cast("array<bigint>").alias("chunk_id"))
    return Graph(g.nodes.unionByName(made, allowMissingColumns=True), g.edges.where("source is not null and target is not null"), g.header)


def merge_diff(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(graph_id, id, action): insert, update or keep for every id of both tables."""
    a, b = old.select(*NODE_KEY, F.struct(*fields).alias("__a")), new.select(*NODE_KEY, F.struct(*fields).alias("__b"))
    action = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull() | F.col("__a").eqNullSafe(F.col("__b")), "keep").otherwise("update")
    return a.join(b, NODE_KEY, "full_outer").select(*NODE_KEY, action.alias("action"))


def next_chunk_id(g: Graph) -> DataFrame:
    """(graph_id, next_id): one past the greatest chunk id of nodes and edges; an empty list counts as 0."""
    own = g.nodes.select("graph_id", F.coalesce(F.array_max("chunk_id"), F.lit(0)).alias("c")).unionByName(g.edges.select("graph_id", F.coalesce("chunk_id", F.lit(0)).alias("c")))
    return own.groupBy("graph_id").agg((F.max("c") + 1).alias("next_id"))


def nodes_in_chunks(g: Graph, chunks: DataFrame | None = None) -> DataFrame:
    rows = g.nodes.select("graph_id", F.explode("chunk_id").alias("chunk"), "id")
    return rows if chunks is None else rows.join(chunks, ["graph_id", "chunk"])


def visual_nodes(g: Graph) -> DataFrame:
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return g.nodes.select("graph_id", "id", "name", "type", F.coalesce(colours[F.col("type")], F.lit("#cccccc")).alias("colour"))


def visual_edges(g: Graph) -> DataFrame:
    return g.edges.select("graph_id", "id", "relation", "source", "target", "weight", F.greatest(F.lit(1.0), "weight").alias("width"))


def legend(g: Graph) -> DataFrame:
    return g.nodes.select("graph_id", "type").distinct().withColumn("title", F.concat(F.upper(F.substring("type", 1, 1)), F.expr("substring(type, 2)"), F.lit("s")))


def put_header(headers: DataFrame, new: DataFrame, order: str = "version") -> DataFrame:
    """One header a graph, the latest by ``order``."""
    w = Window.partitionBy("graph_id").orderBy(F.col(order).desc())
    return headers.unionByName(new, allowMissingColumns=True).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
