"""Sources and sinks: text, CSV, graph snapshots, GraphML, conversations, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import Graph

STATE = "struct<sid:string,current_description:string,current_attributes:map<string,string>,time_start_event:string,time_end_event:string>"
NODE = f"struct<id:string,name:string,type:string,base_description:string,description:string,base_attributes:map<string,string>,attributes:map<string,string>,states:array<{STATE}>,chunk_id:array<bigint>>"
EDGE = "struct<id:string,source:string,target:string,relation:string,description:string,weight:double,time_start_event:string,time_end_event:string,chunk_id:bigint>"
SNAPSHOT = f"graph_id string, connected_document string, connected_embedding string, vector_store struct<type:string,info:map<string,string>>, nodes array<{NODE}>, edges array<{EDGE}>"


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: source, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def load_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One document a row: source, row_index, text. Without ``columns`` a line ``column: value`` for every column;
    with them their values, nulls left out, a line each. A missing column is an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := set(columns or []) - set(rows.columns):
        raise ValueError(f"no column {sorted(missing)} in {path}")
    named = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in rows.columns]
    text = F.concat_ws("\n", *(columns or named))
    rows = rows.select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("m"), text.alias("text"))
    # such files are not split: a file's rows have consecutive numbers from its first one on
    first = rows.groupBy("source").agg(F.min("m").alias("first"))
    return rows.join(first, "source").select("source", (F.col("m") - F.col("first")).alias("row_index"), "text")


def from_strings(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select("doc_id", F.col(text).alias("text"), F.lit("string").alias("source"))


def load_folder(spark: SparkSession, path: str) -> DataFrame:
    """.csv files by row, all others as text."""
    csv = load_csv(spark, f"{path}/*.csv").drop("row_index")
    plain = spark.read.text(f"{path}/*", wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")).where("not lower(source) like '%.csv'")
    return csv.unionByName(plain)


def read_graph(spark: SparkSession, path: str, lines: bool = False) -> Graph:
    """Snapshots (one JSON object a file, or a line) of any version: nodes, edges and header by graph_id (default: the file)."""
    raw = spark.read.json(path, schema=SNAPSHOT, multiLine=not lines).withColumn("graph_id", F.coalesce("graph_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)))
    n = raw.select("graph_id", F.explode("nodes").alias("n"))
    empty = F.create_map().cast("map<string,string>")
    nodes = n.select("graph_id", "n.id", "n.name", "n.type", F.coalesce("n.base_description", "n.description").alias("base_description"), F.coalesce("n.base_attributes", "n.attributes", empty).alias("base_attributes"), F.coalesce("n.states", F.array().cast(f"array<{STATE}>")).alias("states"), F.coalesce("n.chunk_id", F.array().cast("array<bigint>")).alias("chunk_id"))
    edges = raw.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return Graph(nodes, edges, raw.select("graph_id", "connected_document", "connected_embedding", "vector_store"))


def write_graph(g: Graph, path: str) -> None:
    """The native form: nodes and edges as Parquet, by graph."""
    g.nodes.write.partitionBy("graph_id").mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.partitionBy("graph_id").mode("overwrite").parquet(f"{path}/edges")


def export_graph(g: Graph, most: int = 1_000_000) -> DataFrame:
    """(graph_id, value): one JSON snapshot a graph. A graph of more than ``most`` nodes and edges does not fit a
    row: it is refused, and ``write_graph`` is the form for it."""
    size = lambda rows: rows.groupBy("graph_id").count()
    large = size(g.nodes).union(size(g.edges)).groupBy("graph_id").agg(F.sum("count").alias("n")).where(F.col("n") > most)
    if large.limit(1).count():
        raise ValueError(f"graph {large.first()['graph_id']} has more than {most} nodes and edges")
    gather = lambda rows, name: rows.groupBy("graph_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "graph_id"])).alias(name))
    both = gather(g.nodes, "nodes").join(gather(g.edges, "edges"), "graph_id", "full_outer")
    return both.select("graph_id", F.to_json(F.struct("graph_id", "nodes", "edges")).alias("value"))


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """Nodes and edges of GraphML files, their data keys as a map."""
    item = "data array<struct<_VALUE:string,_key:string>>"
    data = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {item}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {item}").load(path)
    return Graph(nodes.select(F.col("_id").alias("id"), data.alias("data")), edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"), data.alias("data")))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Conversation files: conv_id (the file, unless given), graph_path, topic, turn, role, text."""
    schema = "conv_id bigint, graph_path string, current_topic_summary string, messages array<struct<role:string,content:string>>"
    raw = spark.read.json(path, schema=schema, multiLine=False)
    rows = raw.select("conv_id", "graph_path", F.col("current_topic_summary").alias("topic"), F.posexplode("messages").alias("turn", "m"))
    return rows.select("conv_id", "graph_path", "topic", "turn", "m.role", F.col("m.content").alias("text"))


def write_chats(messages: DataFrame, path: str) -> None:
    """One line a conversation, its messages in turn order."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = messages.groupBy("conv_id", "graph_path").agg(F.transform(order, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    rows.write.mode("overwrite").json(path)


def normal_path(path):
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def chats_of_graphs(chats: DataFrame, graphs: DataFrame) -> DataFrame:
    """chats: conv_id, graph_path; graphs: graph_path. Conversations of each graph, paths compared in normal form."""
    a = chats.withColumn("key", normal_path(F.col("graph_path")))
    return graphs.select(normal_path(F.col("graph_path")).alias("key")).distinct().join(a, "key").drop("key")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    results.write.mode("overwrite").json(f"{path}/json")
