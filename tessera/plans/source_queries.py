"""Queries over sources, sinks, response tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import responses as P
from tessera.operators import vectors as V
from tessera.plans.graph_queries import W
from tessera.plans.registry import query, table
from tessera.plans.star_graph import star_graph
from tessera.plans.text_queries import _window as window_sql
from tessera.runtime import Scratch, delete, in_slice, scratch, slices, write
from tessera.sources import files as S
from tessera.streaming import incremental as I

_CUSTOMER = ["c_custkey", "c_name", "c_mktsegment"]


def _customer_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "customer_csv")
    table(spark, sf_dir, "customer").select(*_CUSTOMER).write.option("header", True).csv(path)
    return path


@query("SELECT 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment AS text FROM customer")
def src_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_csv(spark, _customer_csv(spark, sf_dir)).select("text")


@query("SELECT concat_ws(chr(10), c_name, c_mktsegment) AS text FROM customer")
def src_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_csv(spark, _customer_csv(spark, sf_dir), ["c_name", "c_mktsegment"]).select("text")


@query("SELECT doc_id, text, 'string' AS source FROM documents")
def src_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_strings(table(spark, sf_dir, "documents"))


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """Eight text files with all passages of the benchmark, in order of their ids: a folder a file."""
    path = scratch(spark, "texts")
    rows = table(spark, sf_dir, "benchmark").select("text", "item_id", (F.col("item_id") % 8).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "item_id").select("text", "part").write.partitionBy("part").text(path)
    return path


_FILES = "SELECT item_id % 8 AS part, string_agg(text || chr(10), '' ORDER BY item_id) AS text FROM benchmark GROUP BY 1"


@query("SELECT 'node' AS kind, 'customer_' || c_custkey AS a, NULL AS b, c_name AS value FROM customer UNION ALL SELECT 'edge', 'customer_' || c_custkey, 'nation_' || c_nationkey, c_mktsegment FROM customer")
def src_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the nations they live in, written as GraphML parts and read again."""
    path = scratch(spark, "graphml")
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    node = F.format_string('<node id="customer_%d"><data key="d0">%s</data></node>', "c_custkey", safe(F.col("c_name")))
    edge = F.format_string('<edge source="customer_%d" target="nation_%d"><data key="d1">%s</data></edge>', "c_custkey", "c_nationkey", safe(F.col("c_mktsegment")))
    part = (F.col("c_custkey") % 4).alias("part")
    rows = table(spark, sf_dir, "customer").select(part, F.lit(1).alias("place"), F.concat_ws("\n", node, edge).alias("value"))
    parts = rows.select("part").distinct()
    ends = parts.select("part", F.lit(0), F.lit("<graphml><graph>")).union(parts.select("part", F.lit(2), F.lit("</graph></graphml>")))
    rows.union(ends).repartition("part").sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").text(path)
    g = S.read_graphml(spark, path)
    nodes = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("data")["d0"].alias("value"))
    return nodes.union(g.edges.select(F.lit("edge"), "source", "target", F.col("data")["d1"]))


@query(f"SELECT part, length(text) AS size, md5(text) AS digest FROM ({_FILES})")
def src_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.load_text(spark, _text_files(spark, sf_dir) + "/*/*.txt")
    return found.select(F.regexp_extract("source", r"part=(\d+)/", 1).cast("long").alias("part"), F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


@query(f"""SELECT 'txt' AS kind, md5(text) AS digest FROM ({_FILES}) UNION ALL
  SELECT 'csv', md5('s_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || s_name) FROM supplier""")
def src_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text_files(spark, sf_dir)
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(f"{path}/part=csv")
    return S.load_folder(spark, f"{path}/*").select(F.regexp_extract("source", r"\.([a-z]+)$", 1).alias("kind"), F.md5("text").alias("digest"))


@query("""SELECT 'node' AS kind, c_custkey::VARCHAR AS graph_id, 'customer_' || c_custkey AS id, c_name AS value FROM customer UNION ALL
  SELECT 'node', o_custkey::VARCHAR, 'order_' || o_orderkey, 'Order ' || o_orderkey FROM orders UNION ALL
  SELECT 'edge', o_custkey::VARCHAR, 'customer_' || o_custkey || ' participates in order_' || o_orderkey, 'it participates in' FROM orders""")
def src_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph a customer - the customer and its orders - written as one snapshot each, and read again."""
    path = scratch(spark, "snapshot")
    g = star_graph(spark, sf_dir)
    edges = g.edges.where("relation = 'participates in'").withColumn("graph_id", F.regexp_extract("source", r"_(\d+)$", 1))
    owner = edges.select("graph_id", F.col("target").alias("id"))
    people = g.nodes.where("type = 'character'").withColumn("graph_id", F.regexp_extract("id", r"_(\d+)$", 1))
    events = g.nodes.where("type = 'event'").drop("graph_id").join(owner, "id")
    S.export_graph(S.Graph(people.unionByName(events), edges)).select("value").write.text(path)
    back = S.read_graph(spark, path, lines=True)
    nodes = back.nodes.select(F.lit("node").alias("kind"), "graph_id", "id", F.col("name").alias("value"))
    return nodes.unionByName(back.edges.select(F.lit("edge").alias("kind"), "graph_id", "id", F.col("description").alias("value")))


@query(W + "SELECT id, source, target, relation, weight FROM edges")
def snk_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "graph")
    S.write_graph(star_graph(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/edges").select("id", "source", "target", "relation", "weight")


def _with_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("graph_path", F.concat(F.lit("./graphs\\g"), F.col("conv_id") % 5, F.lit(".json")))


def _chat_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "chats")
    S.write_chats(_with_graph(spark, sf_dir), path)
    return path


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations")
def src_chat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_chats(spark, _chat_files(spark, sf_dir)).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, './graphs' || chr(92) || 'g' || (conv_id % 5) || '.json' AS graph_path, count(*) AS messages, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def snk_chat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read_chats(spark, _chat_files(spark, sf_dir)).groupBy("conv_id", "graph_path")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("t")))), lambda x: x["t"])
    return rows.agg(F.count("*").alias("messages"), F.md5(F.array_join(said, "\n")).alias("digest"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 IN (1, 3)")
def src_chat_by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = spark.createDataFrame([("graphs/g1.json",), (".\\graphs\\g3.json",)], "graph_path string")
    return S.chats_of_graphs(_with_graph(spark, sf_dir).select("conv_id", "graph_path").distinct(), graphs).select("conv_id")


@query("SELECT unnest(['csv', 'json']) AS kind, doc_id, quality, toxic FROM labels")
def snk_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark, "results"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    S.write_results(rows, path)
    csv = spark.read.option("header", True).schema(rows.schema).csv(f"{path}/csv").withColumn("kind", F.lit("csv"))
    return csv.unionByName(spark.read.schema(rows.schema).json(f"{path}/json").withColumn("kind", F.lit("json")))


# responses: an order is a chunk; its kind of reply cycles by key
_ORDER_NODES = "SELECT l_orderkey AS chunk_id, p_name AS name, p_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem JOIN part ON p_partkey = l_partkey"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("pos"), F.col("p_name").alias("name"))
    node = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: F.struct(x["name"].alias("name"), F.lit("item").alias("type")))
    body = rows.groupBy("k").agg(node.alias("nodes"))
    j = F.to_json(F.struct("nodes", F.array(F.struct(F.lit("a").alias("node1"), F.lit("b").alias("node2"), F.lit("knows").alias("relation"), F.lit("x").alias("weight"))).alias("edges")))
    kind = F.col("k") % 4
    raw = F.when(kind == 0, j).when(kind == 1, F.concat(F.lit("<reasoning>so {it} goes</reasoning>\n```json\n"), j, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), F.regexp_replace(j, r'^\{"nodes":', '{ // the nodes\n"nodes": /* all */ '), F.lit(" # done"))).otherwise(F.substring(j, 1, 30))
    return body.select(F.lit("g0").alias("graph_id"), F.col("k").alias("chunk_id"), F.lit("extraction").alias("kind"), raw.alias("raw"))


@query(f"""SELECT chunk_id, CASE WHEN chunk_id % 4 <> 3 THEN replace('{{"nodes":[' || string_agg('{{"name":"' || name || '","type":"item"}}', ',' ORDER BY pos) || '],"edges":[{{"node1":"a","node2":"b","relation":"knows","weight":"x"}}]}}', ' ', '') END AS json
  FROM ({_ORDER_NODES}) GROUP BY chunk_id""")
def resp_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired JSON, white space apart."""
    return P.repair(_responses(spark, sf_dir)).select("chunk_id", F.regexp_replace("json", r"\s", "").alias("json"))


@query("SELECT DISTINCT l_orderkey AS chunk_id FROM lineitem WHERE l_orderkey % 4 = 3")
def resp_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quarantine(P.repair(_responses(spark, sf_dir))).select("chunk_id")


@query(f"SELECT chunk_id, pos, name FROM ({_ORDER_NODES}) WHERE chunk_id % 4 <> 3")
def resp_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extraction(P.repair(_responses(spark, sf_dir)))[0].select("chunk_id", "pos", "name")


@query("SELECT DISTINCT l_orderkey AS chunk_id, 'knows' AS relation_from1to2, 'related_to' AS relation_from2to1, 1.0::DOUBLE AS weight FROM lineitem WHERE l_orderkey % 4 <> 3")
def resp_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extraction(P.repair(_responses(spark, sf_dir)))[1].select("chunk_id", "relation_from1to2", "relation_from2to1", "weight")


def _ready(spark: SparkSession, sf_dir: str, json) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("g0").alias("graph_id"), F.col("p_partkey").alias("chunk_id"), json.alias("json"))


@query("SELECT p_partkey AS chunk_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS base_description FROM part")
def resp_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merged(_ready(spark, sf_dir, F.to_json(F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("base_description"))))).select("chunk_id", "name", "base_description")


@query("SELECT p_partkey AS chunk_id, p_name AS name, 'unknown' AS type FROM part")
def resp_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.array(F.struct(F.col("p_name").alias("name")))
    json = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(item.alias("entities")))).otherwise(F.to_json(F.struct(item.alias("missing_entities"))))
    return P.completion(_ready(spark, sf_dir, json))[0].select("chunk_id", "name", "type")


@query("SELECT p_partkey AS chunk_id, p_name AS event_name, p_brand AS id, p_type AS description FROM part")
def resp_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.struct(F.col("p_brand").alias("id"), F.col("p_type").alias("description"))
    json = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("event_name"), F.array(hit).alias("affected_nodes"))).alias("events")))
    return P.impacts(_ready(spark, sf_dir, json))[0].select("chunk_id", "event_name", "id", "description")


@query("SELECT p_partkey AS chunk_id, CASE p_partkey % 3 WHEN 0 THEN 'no name' WHEN 1 THEN 'unknown type' END AS reason FROM part WHERE p_partkey % 3 < 2")
def resp_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(k == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(k == 1, "spaceship").otherwise("item").alias("type"))
    return P.validate(rows)[1].select("chunk_id", "reason")


@query("SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS lower_name, p_type AS upper_name FROM part")
def resp_time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.time_bounds(_ready(spark, sf_dir, F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("lower_event"), F.col("p_type").alias("upper_event"))))).drop("graph_id")


@query("SELECT p_partkey AS chunk_id, p_partkey % 2 = 0 AS is_new_topic, p_name AS summary FROM part")
def resp_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.topic(_ready(spark, sf_dir, F.to_json(F.struct((F.col("p_partkey") % 2 == 0).alias("is_new_topic"), F.col("p_name").alias("topic_summary"))))).drop("graph_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN upper(p_name) END AS raw, CASE WHEN p_partkey % 7 <> 0 THEN 'ok' ELSE 'failed' END AS status FROM part")
def udf_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shout(prompts: list[str]) -> list[str]:
        if any(p.startswith("!") for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    prompt = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("!"), "p_name")).otherwise(F.col("p_name"))
    return models.generate(table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt")), shout).select("p_partkey", "raw", "status")


@query("SELECT o_orderkey, upper(o_orderpriority || ' ' || o_orderstatus) AS raw, 'ok' AS status FROM orders")
def udf_generate_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal prompts of many orders are asked once; the second run finds all replies stored."""
    prompts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("prompt"))
    path = scratch(spark, "replies")
    models.generate_stored(prompts, lambda asked: [p.upper() for p in asked], path, round_prompts=8)

    def refuse(asked: list[str]) -> list[str]:
        raise ValueError("asked again")

    return models.generate_stored(prompts, refuse, path).select("o_orderkey", "raw", "status")


# streams ----------------------------------------------------------------------------------------
def _drain(stream: DataFrame, each, where: str, mode: str = "append") -> None:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True)
    q = writer.start()
    q.awaitTermination()


@query(f"SELECT c.conv_id, coalesce(w.n, 0) AS n, coalesce(w.context, '') AS context FROM (SELECT DISTINCT conv_id FROM conversations WHERE role IN ('user', 'assistant')) c LEFT JOIN ({window_sql('1024', 'conversations')}) w USING (conv_id)")
def stream_chat_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last window of every conversation, its messages arriving as a stream of files."""
    where = scratch(spark, "stream")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows.repartition(4, "turn").write.parquet(f"{where}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    _drain(I.chat_window(stream, 1024), lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{where}/out"), where, "update")
    return spark.read.parquet(f"{where}/out").groupBy("conv_id").agg(F.max_by(F.struct("n", "context"), "batch").alias("x")).select("conv_id", "x.n", "x.context")


@query("SELECT 'order_' || o_orderkey AS id, o_orderpriority AS name FROM orders UNION ALL SELECT 'customer_' || o_custkey || ' made order_' || o_orderkey, o_orderstatus FROM orders")
def stream_graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges in one stream, some with an earlier name that a later row replaces."""
    where = scratch(spark, "merge")
    o = table(spark, sf_dir, "orders")
    order, none = F.concat(F.lit("order_"), "o_orderkey"), F.lit(None).cast("string")
    node = o.select(F.lit("g0").alias("graph_id"), order.alias("id"), none.alias("source"), none.alias("target"), none.alias("relation"), F.col("o_orderpriority").alias("name"), F.lit(1).alias("ord"))
    edge = o.select(F.lit("g0").alias("graph_id"), none.alias("id"), F.concat(F.lit("customer_"), "o_custkey").alias("source"), order.alias("target"), F.lit("made").alias("relation"), F.col("o_orderstatus").alias("name"), F.lit(1).alias("ord"))
    rows = node.unionByName(edge)
    early = rows.where("coalesce(id, target) like '%1'").withColumn("name", F.lit("early")).withColumn("ord", F.lit(0))
    rows.unionByName(early).repartition(2, "id", "target").write.parquet(f"{where}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    seen: list[int] = []
    nodes, edges = I.merge_into(f"{where}/nodes", compact_every=2), I.merge_edges_into(f"{where}/edges", compact_every=2)

    def each(batch: DataFrame, n: int) -> None:
        nodes.put(batch.where("id is not null"), n)
        edges.put(batch.where("id is null"), n)
        seen.append(n)

    _drain(stream, each, where)
    made = edges.read(spark, max(seen)).select(F.concat_ws(" ", "source", "relation", "target").alias("id"), "name")
    return nodes.read(spark, max(seen)).select("id", "name").unionByName(made)


@query(W + "SELECT id, name AS document, length(name)::FLOAT AS size FROM nodes WHERE type <> 'item' UNION ALL SELECT id, source || ' ' || relation || ' ' || target, length(source || ' ' || relation || ' ' || target)::FLOAT FROM edges WHERE relation <> 'involves'")
def stream_vec_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of three versions of the graph: one without groups and with other names for events, the whole
    graph, one without items and one kind of edges. Their changes arrive as a stream of files."""
    where = scratch(spark, "sync")
    lines = table(spark, sf_dir, "lineitem").count()
    n, files = slices(lines), 2 * max(1, lines // 16_000_000)  # as many files a slice
    g, key = star_graph(spark, sf_dir), ["graph_id", "id"]
    own = lambda df, k: df.where(in_slice(key, k, n))
    name = F.when(F.col("type") == "event", "old").otherwise(F.col("name"))
    with Scratch(spark) as work:
        all_nodes = work.keep(g.nodes.select(*key, "name", "type"), "nodes")
        all_edges = work.gather((own(g.edges, k).select(*key, "source", "relation", "target") for k in range(n)), "edges")
        versions = [(all_nodes.where("type <> 'group'").withColumn("name", name), all_edges), (all_nodes, all_edges), (all_nodes.where("type <> 'item'"), all_edges.where("relation <> 'involves'"))]
        kept = None
        for version, (nodes, edges) in enumerate(versions):
            documents = V.index_documents(nodes, edges)
            for k in range(n):
                feed = I.changes(None if kept is None else own(kept, k), own(documents, k), version)
                write(feed.repartition(files, "id").sortWithinPartitions("id"), f"{where}/in", "append")
            kept = documents
        work.drop(all_nodes, all_edges)
        embed = lambda d: V.embed(d, lambda texts: [[float(len(t))] for t in texts])
        index = I.SyncedIndex(f"{where}/index", embed, compact_every=2, passes=n)
        seen: list[int] = []

        def each(batch: DataFrame, number: int) -> None:
            index.put(batch, number)
            seen.append(number)

        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", files * n).option("cleanSource", "delete")
        _drain(stream.parquet(f"{where}/in"), each, where)
        parts = (index.read(spark, max(seen), k, ["document", "embedding"]) for k in range(index.table.passes))
        found = work.gather((p.select("id", "document", F.col("embedding")[0].alias("size")) for p in parts), "index")
        delete(spark, where)
        return work.release(found)
