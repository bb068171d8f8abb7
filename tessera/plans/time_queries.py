"""Queries over time, entity resolution, vector indexes and retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import merge as M
from tessera.operators import resolution as R
from tessera.operators import retrieval as Q
from tessera.operators import temporal as T
from tessera.operators import vectors as V
from tessera.operators.graph import Graph
from tessera.plans.graph_queries import W, lexical_sql, tokens_sql
from tessera.plans.registry import query, table
from tessera.plans.star_graph import star_graph
from tessera.runtime import Scratch, in_slice, scratch, slices, submit

#: Levels of orders, without recursion: an order's place among its customer's.
_LEVELS = "SELECT 'order_' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS level FROM orders"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return T.event_levels(g.nodes.where("type = 'event'"), g.edges.where("relation = 'precedes'"))


@query(_LEVELS)
def tmp_event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).drop("graph_id")


@query("""SELECT o_orderkey AS chunk, 1::BIGINT AS events, count(DISTINCT l_partkey) AS others, count(DISTINCT l_partkey) AS edges, 'Order ' || o_orderkey AS first_event,
  coalesce(max('order_' || o_orderkey || ' affects part_' || l_partkey), '') AS last_edge FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def tmp_impact_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a chunk: itself as event, its parts, and the edges to them."""
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    node = lambda df, chunk, ident, name, kind: df.select(F.lit("g0").alias("graph_id"), F.array(chunk).alias("chunk_id"), ident.alias("id"), name.alias("name"), F.lit(kind).alias("type"))
    events = node(table(spark, sf_dir, "orders"), "o_orderkey", named("order_", "o_orderkey"), named("Order ", "o_orderkey"), "event")
    parts = node(pairs, "l_orderkey", named("part_", "l_partkey"), named("Part ", "l_partkey"), "item")
    edges = pairs.select(F.lit("g0").alias("graph_id"), F.concat(named("order_", "l_orderkey"), F.lit(" affects "), named("part_", "l_partkey")).alias("id"), F.col("l_orderkey").alias("chunk_id"))
    sizes = [F.size(c).cast("long").alias(c) for c in ("events", "others", "edges")]
    return T.impact_inputs(events.unionByName(parts), edges).select("chunk", *sizes, F.col("events")[0].alias("first_event"), F.coalesce(F.array_max("edges"), F.lit("")).alias("last_edge"))


@query("SELECT event_id, 'order_' || o_orderkey AS node FROM events JOIN orders ON o_orderkey = event_id * 2")
def tmp_impact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    impacts = table(spark, sf_dir, "events").select(F.lit("g0").alias("graph_id"), F.col("event_id").alias("key"), F.concat(F.lit("Order "), F.col("event_id") * 2).alias("event_name"))
    return T.match_impacts(impacts, star_graph(spark, sf_dir).nodes).select(F.col("key").alias("event_id"), F.col("event_id").alias("node"))


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("customer_"), F.col("user_id") + 1).alias("node"), F.struct("ts", "event_id").alias("ord"), F.concat(F.lit("Event "), "event_id").alias("event"), F.col("event_type").alias("description"))


_NODE_EVENTS = "SELECT 'customer_' || (user_id + 1) AS node, ts, event_id, 'Event ' || event_id AS event, event_type AS d FROM events"


@query(f"SELECT node, d AS description, event AS start, lead(event) OVER (PARTITION BY node ORDER BY ts, event_id) AS \"end\" FROM ({_NODE_EVENTS})")
def tmp_append_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.append_states(_impacts(spark, sf_dir))


# a fold over lists: each impact closes the first open state and takes the place of its description's, or is put behind
_STATE_FOLD = """list_reduce(list([{'d': d, 'a': attributes, 'st': coalesce(st, event), 'en': en, 'ev': event, 'k': k, 'sid': k || '0'}] ORDER BY ts, event_id),
  lambda acc, x: list_concat(
    list_transform(list_transform(acc, lambda s, i: CASE WHEN x[1].en IS NULL AND i = list_position(list_transform(acc, lambda t: t.en IS NULL), true)
        THEN {'d': s.d, 'a': s.a, 'st': s.st, 'en': x[1].ev, 'ev': s.ev, 'k': s.k, 'sid': s.sid} ELSE s END),
      lambda s: CASE WHEN s.d = x[1].d THEN {'d': s.d, 'a': x[1].a, 'st': x[1].st, 'en': x[1].en, 'ev': x[1].ev, 'k': x[1].k, 'sid': x[1].k || len(acc)} ELSE s END),
    CASE WHEN len(list_filter(acc, lambda s: s.d = x[1].d)) > 0 THEN acc[1:0]
      ELSE [{'d': x[1].d, 'a': x[1].a, 'st': x[1].st, 'en': x[1].en, 'ev': x[1].ev, 'k': x[1].k, 'sid': x[1].k || len(acc)}] END))"""


@query(f"""WITH x AS (SELECT 'customer_' || (user_id + 1) AS node, ts, event_id, 'Event ' || event_id AS event, event_type || ' ' || event_id % 3 AS d, event_type AS attributes, 'event_' || event_id || '_customer_' || (user_id + 1) || '_' AS k,
    CASE WHEN event_id % 11 = 0 THEN 'Event ' || (event_id - 5) END AS st, CASE WHEN event_id % 7 = 0 THEN 'Event ' || (event_id + 100) END AS en FROM events)
  SELECT node, place, s.sid AS sid, s.d AS description, s.a AS attributes, s.st AS start, s.en AS "end" FROM (SELECT node, unnest(range(len(l))) AS place, unnest(l) AS s FROM (SELECT node, {_STATE_FOLD} AS l FROM x GROUP BY node))""")
def tmp_apply_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some impacts have a start or an end of their own; descriptions come again."""
    n = F.col("event_id")
    named = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    impacts = table(spark, sf_dir, "events").select(
        named("customer_", F.col("user_id") + 1).alias("node"), F.struct("ts", "event_id").alias("ord"), named("event_", n).alias("event_id"), named("Event ", n).alias("event"), F.concat_ws(" ", "event_type", n % 3).alias("description"),
        F.create_map(F.lit("kind"), F.col("event_type")).alias("attributes"), F.when(n % 11 == 0, named("Event ", n - 5)).alias("start"), F.when(n % 7 == 0, named("Event ", n + 100)).alias("end"),
    )
    return T.apply_states(impacts).withColumn("attributes", F.col("attributes")["kind"])


def _timed_edges(spark: SparkSession, sf_dir: str, name: Column | None = None) -> DataFrame:
    """Orders as rows that last until their customer's next order, by an id of their own or ``name``."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ident = lambda c: F.concat(F.lit("order_"), c.cast("string"))
    own = name if name is not None else F.concat(F.lit("e"), "o_orderkey")
    start, end = ident(F.col("o_orderkey")).alias("time_start_event"), ident(F.lead("o_orderkey").over(w)).alias("time_end_event")
    return table(spark, sf_dir, "orders").select(F.lit("g0").alias("graph_id"), own.alias("id"), F.col("o_orderpriority").alias("description"), start, end)


_TIMED = "SELECT 'e' || o_orderkey AS id, o_orderpriority AS description, 'order_' || o_orderkey AS s, 'order_' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders"


@query(f"SELECT e.id, coalesce(nullif(d, ''), description) AS description, coalesce(i.st, e.s) AS time_start_event, e.t AS time_end_event FROM ({_TIMED}) e LEFT JOIN (SELECT 'e' || (user_id + 1) AS id, max_by(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, event_id) AS d, max_by('Event ' || event_id, event_id) AS st FROM events GROUP BY user_id) i USING (id)")
def tmp_apply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    imp = table(spark, sf_dir, "events").select(F.lit("g0").alias("graph_id"), F.concat(F.lit("e"), F.col("user_id") + 1).alias("id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("description"), F.concat(F.lit("Event "), "event_id").alias("start"), F.lit(None).cast("string").alias("end"))
    return T.apply_edge_impacts(_timed_edges(spark, sf_dir), imp).select("id", "description", "time_start_event", "time_end_event")


@query("SELECT event_id AS query_id, 'order_' || o.o_orderkey AS lower, 'order_' || p.o_orderkey AS upper FROM events LEFT JOIN orders o ON o.o_orderkey = event_id LEFT JOIN orders p ON p.o_orderkey = event_id * 3")
def tmp_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.lit("g0").alias("graph_id"), F.concat(F.lit("Order "), "event_id").alias("lower_name"), F.concat(F.lit("Order "), F.col("event_id") * 3).alias("upper_name"))
    return T.bounds(q, star_graph(spark, sf_dir).nodes).select("query_id", "lower", "upper")


_RANGES = "(SELECT query_id, CASE WHEN query_id % 4 <> 2 THEN query_id % 7 + 1 END AS l, CASE WHEN query_id % 4 <> 3 THEN query_id % 5 + 2 END AS r FROM (SELECT DISTINCT conv_id AS query_id FROM conversations))"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, q = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id")).distinct(), F.col("query_id")
    return asked.select(F.lit("g0").alias("graph_id"), "query_id", F.when(q % 4 != 2, q % 7 + 1).alias("left"), F.when(q % 4 != 3, q % 5 + 2).alias("right"))


@query(f"""WITH lv AS ({_LEVELS}), top AS (SELECT max(level) AS m FROM lv), q AS (SELECT query_id, least(coalesce(l, 0), coalesce(r, m)) AS lo, greatest(coalesce(l, 0), coalesce(r, m)) AS hi FROM {_RANGES}, top)
  SELECT query_id, count(*) AS states, min(e.id) AS first, max(e.id) AS last FROM ({_TIMED}) e LEFT JOIN lv a ON a.id = e.s LEFT JOIN lv b ON b.id = e.t, top, q WHERE coalesce(b.level, m) >= lo AND coalesce(a.level, 0) <= hi GROUP BY query_id""")
def tmp_filter_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of levels a conversation, over the states of all customers."""
    states = _timed_edges(spark, sf_dir).select("graph_id", F.col("id").alias("node"), F.col("time_start_event").alias("start"), F.col("time_end_event").alias("end"))
    ranges = _ranges(spark, sf_dir)
    return T.count_within(states, _levels(spark, sf_dir), ranges)


_LAST_ORDER = """SELECT *, lead('Order ' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS closed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS level,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS latest FROM orders"""


@query(f"""WITH o AS ({_LAST_ORDER}), st AS (SELECT 'customer_' || o.o_custkey AS node, o.o_orderpriority AS description, o.level AS a, coalesce(p.level, (SELECT max(level) FROM o)) AS b FROM o LEFT JOIN o p ON p.o_custkey = o.o_custkey AND 'Order ' || p.o_orderkey = o.closed WHERE o.latest = 1),
  q AS (SELECT query_id, least(coalesce(l, 0), coalesce(r, m)) AS lo, greatest(coalesce(l, 0), coalesce(r, m)) AS hi FROM {_RANGES}, (SELECT max(level) AS m FROM o))
  SELECT query_id, node, description FROM st JOIN q ON b >= lo AND a <= hi""")
def tmp_states_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: orders put states on their customers, orders are levelled, and the conversations' ranges of
    levels ask for states, whose times are names of orders."""
    ident = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    impacts = table(spark, sf_dir, "orders").select(
        ident("customer_", "o_custkey").alias("node"), F.struct("o_orderdate", "o_orderkey").alias("ord"), ident("order_", "o_orderkey").alias("event_id"), ident("Order ", "o_orderkey").alias("event"),
        F.col("o_orderpriority").alias("description"), none.alias("attributes"), none.alias("start"), none.alias("end"),
    )
    events = star_graph(spark, sf_dir).nodes.where("type = 'event'").select("graph_id", "id", "name")
    states = T.apply_states(impacts).withColumn("graph_id", F.lit("g0"))
    ranges = _ranges(spark, sf_dir)
    return T.states_within(states, _levels(spark, sf_dir), ranges, events).select("query_id", "node", "description")


@query(f"WITH lv AS ({_LEVELS}) SELECT e.id FROM ({_TIMED}) e LEFT JOIN lv a ON a.id = e.s WHERE coalesce(a.level, 0) <= 3")
def tmp_edges_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges_as_of(_timed_edges(spark, sf_dir), _levels(spark, sf_dir), 3).select("id")


@query(f"WITH lv AS ({_LEVELS}) SELECT e.id, CASE WHEN b.level < 2 THEN '(before ' || e.t || ')' ELSE '' END AS mark FROM ({_TIMED}) e LEFT JOIN lv a ON a.id = e.s LEFT JOIN lv b ON b.id = e.t WHERE coalesce(a.level, 0) <= 5")
def tmp_before_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges_as_of(_timed_edges(spark, sf_dir), _levels(spark, sf_dir), 5, 2).select("id", "mark")


# entity resolution ------------------------------------------------------------------------------
def _typed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("g0").alias("graph_id"), F.col("label").cast("string").alias("type"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding")


_SIM = "SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


@query("SELECT p_brand AS type, lower(trim(p_name)) AS key, min('part_' || p_partkey) AS id, count(*) AS members FROM part GROUP BY 1, 2")
def er_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.lit("g0").alias("graph_id"), F.concat(F.lit("part_"), "p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"), F.array(F.col("p_partkey") % 7).alias("chunk_id"))
    return R.merge_exact(nodes).select("type", "key", "id", "members")


@query(f"SELECT a, b, round(sim, 6) AS similarity FROM ({_SIM}) WHERE sim >= 0.2")
def er_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.similar_pairs(_typed_vectors(spark, sf_dir), 0.2).select("a", "b", F.round("similarity", 6).alias("similarity"))


_NAMED = "SELECT vec_id, label, embedding, 'Vector ' || (vec_id % 40) || ' of ' || label AS name FROM embeddings"


@query(f"""SELECT a, b, round(s, 5) AS similarity FROM (SELECT a.vec_id AS a, b.vec_id AS b, 0.6 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.3 * {lexical_sql('a.name', 'b.name')}
    + 0.1 * CASE WHEN lower(a.name) <> lower(b.name) AND (contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name))) THEN 0.9 ELSE 1.0 END AS s
  FROM ({_NAMED}) a JOIN ({_NAMED}) b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE s >= 0.5""")
def er_hybrid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("string")
    name = F.concat(F.lit("Vector "), F.col("vec_id") % 40, F.lit(" of "), label)
    nodes = table(spark, sf_dir, "embeddings").select(F.lit("g0").alias("graph_id"), label.alias("type"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), name.alias("name"), "embedding")
    return R.hybrid_pairs(nodes, 0.5).select("a", "b", F.round("similarity", 5).alias("similarity"))


def _clustered(spark: SparkSession, sf_dir: str, best: bool) -> DataFrame:
    nodes = _typed_vectors(spark, sf_dir)
    return R.clusters(nodes, R.similar_pairs(nodes, 0.2), best)


_FIT = f"""WITH RECURSIVE sim AS MATERIALIZED (SELECT a, b, sim FROM ({_SIM}) WHERE sim >= 0.2),
  item AS MATERIALIZED (SELECT vec_id AS id, coalesce(near, []) AS near, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings LEFT JOIN (SELECT b, list(a ORDER BY {{order}}) AS near FROM sim GROUP BY b) ON b = vec_id),
  fold AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS leader, []::BIGINT[] AS leaders UNION ALL
  SELECT n.i, n.id, coalesce(n.hit, n.id), CASE WHEN n.hit IS NULL THEN list_append(n.leaders, n.id) ELSE n.leaders END
  FROM (SELECT item.i, item.id, f.leaders, list_filter(item.near, lambda x: list_contains(f.leaders, x))[1] AS hit FROM fold f JOIN item ON item.i = f.i + 1) n)
  SELECT id, leader FROM fold WHERE id IS NOT NULL"""


@query(_FIT.format(order="a"))
def er_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, False).select("id", "leader")


@query(_FIT.format(order="sim DESC, a"))
def er_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, True).select("id", "leader")


@query(f"""WITH f AS MATERIALIZED ({_FIT.format(order='a')}), n AS (SELECT leader AS id, count(*) AS members, min(f.id) AS first, max(f.id) AS last FROM f GROUP BY leader)
  SELECT n.id, members, first, last, 'vector ' || last AS base_description, (SELECT count(*) FROM f JOIN embeddings v ON v.vec_id = f.id + 1 WHERE f.leader = n.id) AS edges_out,
  (SELECT count(*) FROM f JOIN embeddings v ON v.vec_id = f.id - 1 WHERE f.leader = n.id) AS edges_in FROM n""")
def g_merge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as nodes in three extractions, merged one after another into a graph of versions."""
    rows = table(spark, sf_dir, "embeddings")
    ends = rows.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first()
    part = F.least(F.floor((F.col("vec_id") - ends["a"]) * 3 / (ends["b"] - ends["a"] + 1)), F.lit(2))
    number, g = F.col("vec_id"), F.lit("g0").alias("graph_id")
    name = F.concat(F.lit("v"), number.cast("string")).alias("name")
    nodes = rows.select(g, number.alias("id"), number.alias("ord"), name, F.col("label").cast("string").alias("type"), F.concat(F.lit("vector "), number.cast("string")).alias("base_description"), F.create_map().cast("map<string,string>").alias("base_attributes"), F.array("vec_id").alias("chunk_id"), part.alias("part"))
    pairs = rows.select(F.col("vec_id").alias("source")).join(rows.select((F.col("vec_id") - 1).alias("source")), "source", "left_semi")
    edges = pairs.select(g, F.concat(F.lit("e"), F.col("source").cast("string")).alias("id"), "source", (F.col("source") + 1).alias("target"), F.lit("next").alias("relation"), F.col("source").alias("chunk_id"))
    vectors = rows.select(number.alias("id"), "embedding")
    store = M.GraphStore(spark, scratch(spark, "graph"))
    similar = lambda n: R.similar_pairs(n.join(vectors, "id"), 0.2, only="fresh")
    for k in range(3):
        # an edge comes with the later one of its ends
        own = edges.join(nodes.select(F.col("id").alias("target"), "part"), "target").where(F.col("part") == k).drop("part")
        store.merge(Graph(nodes.where(F.col("part") == k).drop("part"), own.select(*edges.columns)), similar)
    done = store.read()
    ends_of = lambda c: done.edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(f"edges_{'out' if c == 'source' else 'in'}"))
    own = done.nodes.select("id", F.size("chunk_id").cast("long").alias("members"), F.array_min("chunk_id").alias("first"), F.array_max("chunk_id").alias("last"), "base_description")
    return own.join(ends_of("source"), "id", "left").join(ends_of("target"), "id", "left").fillna(0, ["edges_out", "edges_in"])


@query("""SELECT p_brand AS id, count(*) AS members, min_by(p_name, (-length(p_name), CASE WHEN regexp_matches(p_name, '^[A-Z]') THEN 0 ELSE 1 END, lower(p_name))) AS name, max_by(p_type, p_partkey) AS base_description,
  max_by(p_partkey, p_partkey)::VARCHAR AS last_key, md5(string_agg(p_type, '|' ORDER BY p_partkey)) AS states, min((p_partkey % 10) / 10.0)::DOUBLE AS merge_similarity FROM part GROUP BY p_brand""")
def er_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    attributes = F.create_map(F.lit("last"), key, F.col("p_brand"), F.lit("x")).alias("base_attributes")
    state = F.array(F.struct(F.col("p_type").alias("current_description"))).alias("states")
    nodes = p.select(F.lit("g0").alias("graph_id"), key.alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.lit("item").alias("type"), F.col("p_type").alias("base_description"), attributes, F.array(F.col("p_partkey") % 7).alias("chunk_id"), state)
    members = nodes.select("graph_id", "id").join(p.select(key.alias("id"), F.col("p_brand").alias("leader"), (F.col("p_partkey") % 10 / 10).alias("similarity")), "id")
    told = F.md5(F.array_join(F.transform("states", lambda s: s["current_description"]), "|"))
    out = R.combine(nodes, members).withColumn("states", told)
    return out.select("id", F.size("merged_from").cast("long").alias("members"), "name", "base_description", F.col("base_attributes")["last"].alias("last_key"), "states", "merge_similarity")


@query(W + ", m AS (SELECT id, CASE WHEN type = 'item' THEN 'part_' || (CAST(replace(id, 'part_', '') AS BIGINT) % 10) ELSE id END AS leader FROM nodes WHERE type <> 'location') SELECT e.id, a.leader AS source, b.leader AS target FROM edges e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target".replace("CAST(replace(id, 'part_', '') AS BIGINT)", "TRY_CAST(replace(id, 'part_', '') AS BIGINT)"))
def er_remap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    leader = F.when(F.col("type") == "item", F.concat(F.lit("part_"), F.regexp_replace("id", "part_", "").try_cast("long") % 10)).otherwise(F.col("id"))
    members = g.nodes.where("type <> 'location'").select("graph_id", "id", leader.alias("leader"))
    remapped = lambda edges: R.remap_edges(edges, members).select("id", "source", "target")
    n = slices(table(spark, sf_dir, "lineitem").count())
    if n == 1:
        return remapped(g.edges)
    with Scratch(spark) as work:  # rows of one id are in one slice
        return work.release(work.gather((remapped(g.edges.where(in_slice(["graph_id", "id"], k, n))) for k in range(n)), "edges"))


# vector index -----------------------------------------------------------------------------------
def _index(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(f"vec_id % 2 = {int(odd)}").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("document"))


@query(W + "SELECT id, name AS document, type AS node_type, NULL AS relation FROM nodes UNION ALL SELECT id, source || ' ' || relation || ' ' || target, NULL, relation FROM edges")
def vec_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return V.index_documents(g.nodes, g.edges).select("id", "document", F.col("metadata")["node_type"].alias("node_type"), F.col("metadata")["relation"].alias("relation"))


@query("SELECT p_partkey, p_name AS document, length(p_name)::FLOAT AS size, (list_sum(list_transform(string_split(p_name, ''), lambda c: unicode(c))) % 97)::FLOAT AS mark FROM part")
def vec_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("document"))
    done = V.embed(rows, lambda texts: [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts])
    return done.select("p_partkey", "document", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("mark"))


@query("SELECT vec_id AS id FROM embeddings")
def vec_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ids(_index(spark, sf_dir, False).unionByName(_index(spark, sf_dir, True)))


@query("SELECT vec_id AS id, label::VARCHAR AS document FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label::VARCHAR FROM embeddings WHERE vec_id % 2 = 1")
def vec_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _index(spark, sf_dir, False), _index(spark, sf_dir, True)
    return V.add(a, b.unionByName(a)).select("id", "document")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE label::VARCHAR END AS document FROM embeddings")
def vec_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _index(spark, sf_dir, False).unionByName(_index(spark, sf_dir, True))
    return V.upsert(a, a.where("id % 3 = 0").withColumn("document", F.lit("new"))).select("id", "document")


@query("SELECT vec_id AS id FROM embeddings WHERE label <> 3")
def vec_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _index(spark, sf_dir, False).unionByName(_index(spark, sf_dir, True))
    return V.delete(a, a.where("document = '3'")).select("id")


@query(W + "SELECT id, type FROM nodes WHERE type IN ('group', 'location')")
def vec_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return V.index_documents(g.nodes, g.edges).join(g.nodes.where("type in ('group', 'location')").select("id"), "id").select("id", F.col("metadata")["node_type"].alias("type"))


@query(W + "SELECT id, CASE WHEN type = 'item' THEN 'delete' WHEN type = 'group' THEN 'insert' WHEN type = 'event' THEN 'update' ELSE 'keep' END AS action FROM nodes UNION ALL SELECT id, 'keep' FROM edges")
def vec_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    now = V.index_documents(g.nodes.where("type <> 'item'"), g.edges)
    old = V.index_documents(g.nodes.where("type <> 'group'").withColumn("name", F.when(F.col("type") == "event", "old").otherwise(F.col("name"))), g.edges)
    return V.sync_plan(now, old).select("id", "action")


_TOP = """SELECT q.vec_id AS query_id, d.vec_id AS id, d.label, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS distance
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0"""


def _hits(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine", metadata: list[str] | None = None) -> DataFrame:
    """Every row whose id is divisible by 50 asks all rows but its own."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return V.top_k(e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), k, metric, metadata=metadata, skip_own=True)


@query(f"SELECT query_id, id, round(distance, 6) AS distance, r AS rank, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM ({_TOP})) WHERE r <= 5")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 5, metadata=["label"]).withColumn("distance", F.round("distance", 6))


@query(f"SELECT query_id, id, round(distance, 6) AS distance, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM ({_TOP})) WHERE r <= 5")
def vec_topk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours out of a stored index: first two cells a query, then those that may hold nearer rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = V.StoredIndex.build(e, scratch(spark, "index"), cells=16)
    found = index.search(e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 6, probes=2).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank).where("rank <= 5").withColumn("distance", F.round("distance", 6))


@query(f"SELECT query_id, string_agg('chunk ' || id, chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM ({_TOP})) WHERE r <= 3 GROUP BY query_id")
def vec_chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("chunk "), "vec_id").alias("text"))
    return V.chunk_context(_hits(spark, sf_dir, 3, "euclidean"), chunks)


# retrieval --------------------------------------------------------------------------------------
_COUNT = "(SELECT count(*) FROM customer)"
#: A hit stands for a customer, a nation, a region, or an edge from a customer to a nation.
_HIT = f"""hit AS MATERIALIZED (SELECT query_id, 1 - distance AS score, CASE id % 4 WHEN 3 THEN 'edge' ELSE 'node' END AS type,
  CASE id % 4 WHEN 0 THEN 'customer_' || (1 + id % {_COUNT}) WHEN 1 THEN 'nation_' || (id % 25) WHEN 2 THEN 'region_' || (id % 5) END AS id,
  'customer_' || (1 + id % {_COUNT}) AS source, 'nation_' || (id % 25) AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM ({_TOP})) WHERE r <= 5)"""
_ENTRY = f"""{_HIT}, ent AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, score, unnest(CASE type WHEN 'edge' THEN [source, target] ELSE [id] END) AS id FROM hit WHERE score >= 0)
  WHERE id IN (SELECT id FROM nodes) GROUP BY query_id, id))"""
_NEAR = """near AS MATERIALIZED (SELECT e.query_id, g.target AS id, min(g.weight) AS score, min_by(g.source, e.rank) AS owner FROM ent e JOIN edges g ON g.source = e.id
  WHERE NOT EXISTS (SELECT 1 FROM ent x WHERE x.query_id = e.query_id AND x.id = g.target) GROUP BY e.query_id, g.target)"""
_G = W.rstrip().replace("nodes AS (", "nodes AS MATERIALIZED (", 1).replace("edges AS (", "edges AS MATERIALIZED (", 1)


def _entry_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    named = lambda kind, key: F.concat(F.lit(f"{kind}_"), key.cast("string"))
    kind, customer, nation = F.col("id") % 4, named("customer", F.col("id") % n + 1), named("nation", F.col("id") % 25)
    node = F.when(kind == 0, customer).when(kind == 1, nation).when(kind == 2, named("region", F.col("id") % 5))
    return _hits(spark, sf_dir, 5).select("query_id", (1 - F.col("distance")).alias("score"), F.when(kind == 3, "edge").otherwise("node").alias("type"), customer.alias("source"), nation.alias("target"), node.alias("id"))


def _entries(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    return Q.entry_nodes(_entry_hits(spark, sf_dir), nodes, 0.0)


@dataclass
class _Asked:
    """The graph and the entries of all questions, each written once."""

    nodes: DataFrame
    edges: DataFrame
    entries: DataFrame
    work: Scratch


@contextmanager
def _asking(spark: SparkSession, sf_dir: str) -> Iterator[_Asked]:
    g = star_graph(spark, sf_dir)
    with Scratch(spark) as work:
        nodes = work.keep(g.nodes, "nodes")
        yield _Asked(nodes, work.keep(g.edges, "edges"), work.keep(_entries(spark, sf_dir, nodes), "entries"), work)


@query(f"{_G}, {_ENTRY} SELECT query_id, id, round(score, 6) AS score, rank FROM ent")
def ret_entry_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, star_graph(spark, sf_dir).nodes).withColumn("score", F.round("score", 6))


@query(f"{_G}, {_ENTRY}, {_NEAR} SELECT * FROM near")
def ret_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _asking(spark, sf_dir) as a:
        return a.work.release(Q.expand(a.entries, a.edges, a.nodes)[0])


_PAIRED = "SELECT a.query_id, a.id AS start, b.id AS stop FROM ent a JOIN ent b ON a.query_id = b.query_id AND a.rank < b.rank"


@query(f"{_G}, {_ENTRY} {_PAIRED}")
def ret_entry_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.entry_pairs(_entries(spark, sf_dir, star_graph(spark, sf_dir).nodes))


_PATHS = f"""WITH RECURSIVE {_G[5:]}, {_ENTRY}, deg AS MATERIALIZED (SELECT source, count(*) AS d FROM edges GROUP BY source), st AS ({_PAIRED}),
  walk AS (SELECT query_id, start, stop, start AS here, [start] AS ns, []::VARCHAR[] AS es, 1.0::DOUBLE AS score, 0 AS n FROM st UNION ALL
  SELECT w.query_id, w.start, w.stop, e.target, list_append(w.ns, e.target), list_append(w.es, e.id), 0.7 * w.score / d, n + 1
  FROM walk w JOIN edges e ON e.source = w.here JOIN deg ON deg.source = w.here WHERE w.here <> w.stop AND n < 5 AND NOT list_contains(w.ns, e.target) AND 0.7 * w.score / d >= 0.01),
  pth AS MATERIALIZED (SELECT query_id, start, stop, ns, es, score FROM walk WHERE here = stop)"""


@query(f"{_PATHS} SELECT query_id, start, stop, array_to_string(ns, '>') AS way, round(score, 6) AS score FROM pth")
def ret_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _asking(spark, sf_dir) as a:
        found = Q.paths(Q.entry_pairs(a.entries), a.edges)
        return a.work.release(found.select("query_id", "start", "stop", F.array_join("nodes", ">").alias("way"), F.round("score", 6).alias("score")))


_PATH_TEXT = """nm AS (SELECT p.*, row_number() OVER (PARTITION BY query_id, start, stop ORDER BY es DESC) AS number FROM pth p),
  ptx AS MATERIALIZED (SELECT query_id, start, stop, number, any_value(score) AS score, string_agg(t, ' - ' ORDER BY i) AS text FROM (
  SELECT query_id, start, stop, number, score, 2 * i AS i, n.name AS t FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM nm) x JOIN nodes n ON n.id = x.ns[x.i] UNION ALL
  SELECT query_id, start, stop, number, score, 2 * i + 1, e.relation FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i FROM nm) x JOIN edges e ON e.id = x.es[x.i])
  GROUP BY query_id, start, stop, number)"""


@query(f"{_PATHS}, {_PATH_TEXT} SELECT query_id, start, stop, number, text FROM ptx")
def ret_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _asking(spark, sf_dir) as a:
        found = Q.path_texts(Q.paths(Q.entry_pairs(a.entries), a.edges), a.nodes, a.edges)
        return a.work.release(found.select("query_id", "start", "stop", "number", "text"))


_PATH_NODES = """pnd AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, score, unnest(ns) AS id FROM pth) p
  WHERE NOT EXISTS (SELECT 1 FROM ent x WHERE x.query_id = p.query_id AND x.id = p.id) AND NOT EXISTS (SELECT 1 FROM near x WHERE x.query_id = p.query_id AND x.id = p.id) GROUP BY query_id, id)"""
_SCORED = ["query_id", "id", "score"]


_ORDER_ENTRY = """ent AS MATERIALIZED (SELECT o_custkey AS query_id, 'order_' || o_orderkey AS id, 1.0 / i AS score, CASE i WHEN 1 THEN 1 ELSE 2 END AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i IN (1, 4))"""


@query(f"{_PATHS.replace(_ENTRY, _ORDER_ENTRY).replace('>= 0.01', '>= 0.0005')}, {_NEAR}, {_PATH_NODES} SELECT query_id, id, round(score, 6) AS score FROM pnd")
def ret_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question a customer, about its first and fourth order: what leads from one to the other is found
    along ways that are less likely than elsewhere, and most of it is no neighbour of either."""
    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    asked = table(spark, sf_dir, "orders").withColumn("i", order).where("i in (1, 4)")
    asked = asked.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("order_"), "o_orderkey").alias("id"), F.expr("1.0D / i").alias("score"), F.when(F.col("i") == 1, 1).otherwise(2).alias("rank"))
    g, n = star_graph(spark, sf_dir), slices(table(spark, sf_dir, "lineitem").count())
    with Scratch(spark) as work:
        entries = work.keep(asked, "entries")
        edges = work.gather((g.edges.where(in_slice(["id"], k, n)).select("source", "target", "weight") for k in range(n)), "edges")
        ids = entries.select(F.col("id").alias("source")).distinct()
        own = work.gather((edges.where(in_slice(["source"], k, n)).join(ids.where(in_slice(["source"], k, n)), "source", "left_semi") for k in range(n)), "own")
        candidates = entries.select(*_SCORED).unionByName(Q.nearest(entries, own).select(*_SCORED))
        found = Q.paths(Q.entry_pairs(entries), edges, floor=0.0005, parts=n, edge_ids=False)
        return work.release(Q.path_nodes(found, candidates).withColumn("score", F.round("score", 6)))


def _texts_sql(candidates: str, about: str = "n.base_description", more: str = "") -> str:
    said = f"n.name || '. ' || {about}"
    return f"txt AS MATERIALIZED (SELECT c.query_id, c.id, c.score, {said} AS text, {tokens_sql(said)} AS tokens FROM ({candidates}) c JOIN nodes n ON n.id = c.id {more})"


_BOTH = "SELECT query_id, id, score FROM ent UNION ALL SELECT query_id, id, score FROM near"


@query(f"{_G}, {_ENTRY}, {_NEAR}, {_texts_sql(_BOTH)} SELECT query_id, id, text, tokens FROM txt")
def ret_node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _asking(spark, sf_dir) as a:
        near, _ = Q.expand(a.entries, a.edges, a.nodes)
        return a.work.release(Q.node_texts(a.entries.select(*_SCORED).unionByName(near.select(*_SCORED)), a.nodes).drop("score"))


@query("SELECT conv_id AS query_id, history, 500 - 100 * history::INT AS nodes, 300 - 100 * history::INT AS edges, 200 - 100 * history::INT AS paths, 300 * history::INT AS events FROM (SELECT DISTINCT conv_id, unnest([true, false]) AS history FROM conversations)")
def ret_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    parts = [Q.budgets(asked, 1000, h).withColumnRenamed("history", "events").withColumn("history", F.lit(h)) for h in (True, False)]
    return parts[0].unionByName(parts[1])


@query(f"""WITH RECURSIVE it AS (SELECT conv_id AS q, turn, {tokens_sql('text')} AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations), fold AS (SELECT q, i, turn, tok <= 300 AS ok, CASE WHEN tok <= 300 THEN 300 - tok ELSE 300 END AS rest FROM it WHERE i = 1
  UNION ALL SELECT it.q, it.i, it.turn, it.tok <= f.rest, CASE WHEN it.tok <= f.rest THEN f.rest - it.tok ELSE f.rest END FROM fold f JOIN it ON it.q = f.q AND it.i = f.i + 1) SELECT q AS query_id, turn::VARCHAR AS id FROM fold WHERE ok""")
def ret_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    items = c.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("id"), F.col("turn").cast("double").alias("score"), X.tokens(F.col("text")).alias("tokens"), "text")
    return Q.pack(items, c.select(F.col("conv_id").alias("query_id"), F.lit(300).alias("budget")).distinct()).select("query_id", "id")


@query(f"{_G}, {_ENTRY} SELECT e.query_id, g.id FROM ent e JOIN edges g ON g.source = e.id JOIN (SELECT query_id, target AS id FROM ent JOIN edges ON source = ent.id WHERE relation IN ('lives in', 'located in') UNION SELECT query_id, id FROM ent) k ON k.query_id = e.query_id AND k.id = g.target GROUP BY e.query_id, g.id")
def ret_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _asking(spark, sf_dir) as a:
        out = a.entries.select("query_id", F.col("id").alias("source")).join(a.edges, "source").select("query_id", "source", "target", "id", "relation")
        packed = a.entries.select("query_id", "id").unionByName(out.where("relation in ('lives in', 'located in')").select("query_id", F.col("target").alias("id")))
        return a.work.release(Q.between_packed(out, packed).select("query_id", "id").distinct())


_ORDERED = "SELECT o_custkey AS query_id, 'Order ' || o_orderkey AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS level FROM orders"


def _customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = F.concat(F.lit("Order "), "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(w).alias("level"), name.alias("id"), name.alias("text"))


def _history_sql(events: str, budget: int, seed: int = 7) -> str:
    """events: query_id, level, id, text."""
    return f"""SELECT query_id, string_agg(text, chr(10) ORDER BY i) AS text FROM (
  SELECT *, sum(tok) OVER (PARTITION BY query_id) - coalesce(sum(CASE WHEN middle THEN tok ELSE 0 END) OVER (PARTITION BY query_id ORDER BY CASE WHEN middle THEN 0 ELSE 1 END, md5('{seed}' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
  FROM (SELECT *, i > 1 AND i < n AS middle FROM (SELECT *, {tokens_sql('text')} AS tok, row_number() OVER (PARTITION BY query_id ORDER BY level, id) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM ({events})))) WHERE NOT middle OR left_ <= {budget} GROUP BY query_id"""


@query("SELECT o_custkey AS query_id, string_agg('Order ' || o_orderkey, chr(10) ORDER BY o_orderdate, o_orderkey) AS text FROM orders GROUP BY o_custkey")
def ret_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.history(_customer_events(spark, sf_dir), 10_000)


@query(_history_sql(f"SELECT *, text AS id FROM ({_ORDERED})", 20))
def ret_history_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.history(_customer_events(spark, sf_dir), 20)


_UPPER, _LOWER = 3, 1


def _timed(edges: DataFrame) -> DataFrame:
    """An order's edges start with it; 'participates in' ends with the customer's next order."""
    order = F.when(F.col("source").startswith("order_"), F.col("source")).when(F.col("target").startswith("order_"), F.col("target"))
    next_ = edges.where("relation = 'precedes'").select(F.col("source").alias("__o"), F.col("target").alias("__n"))
    rows = edges.withColumn("time_start_event", order).join(next_, (F.col("time_start_event") == F.col("__o")) & (F.col("relation") == "participates in"), "left")
    return rows.withColumn("time_end_event", F.col("__n")).drop("__o", "__n")


def _world(nodes: DataFrame, levels: DataFrame, queries: DataFrame) -> DataFrame:
    """One history a graph, for all its queries."""
    events = nodes.where("type = 'event'").join(levels.select("id", "level"), "id")
    said = F.concat_ws(". ", "name", F.col("base_attributes")["time"], "base_description")
    told = Q.history(events.select(F.col("graph_id").alias("query_id"), "id", "level", said.alias("text")), 300, few_queries=True).withColumnRenamed("query_id", "graph_id")
    return queries.withColumn("graph_id", F.lit("g0")).join(told, "graph_id").select("query_id", F.lit(0).alias("place"), "text")


@contextmanager
def _asking_near(spark: SparkSession, sf_dir: str, graph: Graph) -> Iterator[_Asked]:
    """As _asking, but of the graph only what is within five steps, a path's most, of any question's entries."""
    with Scratch(spark) as work:
        hits = work.keep(_entry_hits(spark, sf_dir), "hits")
        ids = work.keep(hits.select(F.explode(F.array("id", "source", "target")).alias("id")).where("id is not null").distinct(), "ids")
        known = work.keep(graph.nodes.select("id").join(Q.few(ids), "id", "left_semi"), "known")
        entries = work.keep(Q.entry_nodes(hits, known, 0.0), "entries")
        reached = Q.few(Q.reachable(entries, graph.edges, 5, work))
        nodes = work.keep(graph.nodes.join(reached, "id", "left_semi"), "nodes")
        yield _Asked(nodes, work.keep(graph.edges.join(reached.withColumnRenamed("id", "source"), "source", "left_semi"), "edges"), entries, work)


def _context(spark: SparkSession, sf_dir: str, timed: bool) -> DataFrame:
    g = star_graph(spark, sf_dir)
    with Scratch(spark) as own, ThreadPoolExecutor(2) as pool:
        before = own.keep(g.edges.where("relation = 'precedes'"), "before")
        graph = Graph(g.nodes, before.unionByName(g.edges.where("relation <> 'precedes'")))
        # levels and the history beside the paths, which only wait for them if times are asked
        levels = submit(pool, lambda: T.event_levels(g.nodes.where("type = 'event'"), before))
        with _asking_near(spark, sf_dir, graph) as a:
            return _packed(spark, sf_dir, timed, g, a, levels, pool)


def _packed(spark: SparkSession, sf_dir: str, timed: bool, g: Graph, a: _Asked, levels: Future[DataFrame], pool: ThreadPoolExecutor) -> DataFrame:
    queries = a.entries.select("query_id").distinct()
    world = submit(pool, lambda: a.work.keep(_world(g.nodes, levels.result(), queries), "world"))
    edges, states = a.edges, None
    if timed:
        rows = a.work.keep(_timed(a.edges), "rows")
        times = a.work.keep(rows.select(F.explode(F.array("time_start_event", "time_end_event")).alias("id")).where("id is not null").distinct(), "times")
        known = a.work.keep(levels.result().join(Q.few(times), "id", "left_semi"), "known")
        edges = a.work.keep(T.edges_as_of(rows, known, _UPPER, _LOWER), "timed")
        own = _timed_edges(spark, sf_dir, F.concat(F.lit("customer_"), "o_custkey")).withColumnsRenamed({"id": "node", "time_start_event": "start", "time_end_event": "end"})
        ranges = queries.select(F.lit("g0").alias("graph_id"), "query_id", F.lit(_LOWER).alias("left"), F.lit(_UPPER).alias("right"))
        wanted = a.entries.select(F.col("id").alias("node")).distinct()
        states = T.states_within(own.join(wanted, "node", "left_semi"), levels.result(), ranges)
    near, texts = Q.expand(a.entries, edges, a.nodes)
    near = a.work.keep(near, "near")
    found = a.work.keep(Q.paths(Q.entry_pairs(a.entries), edges), "paths")
    candidates = a.entries.select(*_SCORED).unionByName(near.select(*_SCORED))
    candidates = candidates.unionByName(Q.path_nodes(found, candidates))
    shares = Q.budgets(queries, 1000, True)
    share = lambda name: shares.select("query_id", F.col(name).alias("budget"))
    nodes = a.work.keep(Q.pack(Q.node_texts(candidates, a.nodes, states), share("nodes")), "packed")
    item = lambda name, score: [F.concat_ws(" ", *name).alias("id"), F.col(score).alias("score"), X.tokens(F.col("text")).alias("tokens"), "text"]
    lines = Q.between_packed(texts, nodes).select("query_id", *item(["source", "target"], "weight"))
    ways = Q.between_packed(Q.path_texts(found, a.nodes, edges), nodes, ("start", "stop")).select("query_id", *item(["start", "stop", "number"], "score"))
    packed_ways = submit(pool, lambda: a.work.keep(Q.pack(ways, share("paths")), "ways"))
    lines = a.work.keep(Q.pack(lines, share("edges")), "lines")
    blocks = {"NODES": nodes, "EDGES": lines, "PATHS": packed_ways.result(), "HISTORY": world.result()}
    return a.work.release(Q.context(blocks, queries))


def _pack_sql(name: str, items: str, budget: int) -> str:
    """Greedy packing of items (query_id, id, score, tokens, text), as lists of (id, x)."""
    return f"""{name} AS MATERIALIZED (SELECT query_id, list_reduce(list({{'t': tokens, 'id': id, 'x': text}} ORDER BY -score, id, tokens, text),
  lambda acc, x: CASE WHEN x.t <= acc.l THEN {{'l': acc.l - x.t, 'k': list_append(acc.k, {{'id': x.id, 'x': x.x}})}} ELSE acc END,
  {{'l': {budget}::BIGINT, 'k': []::STRUCT(id VARCHAR, x VARCHAR)[]}}).k AS k FROM ({items}) GROUP BY query_id)"""


def _context_sql(timed: bool) -> str:
    graph, state, about, mark = _PATHS, "", "n.base_description", "''"
    if timed:
        first = "CASE WHEN source LIKE 'order_%' THEN source WHEN target LIKE 'order_%' THEN target END"
        graph = graph.replace("edges AS MATERIALIZED (", "every AS MATERIALIZED (", 1).replace(f", {_HIT}", f""", lv AS MATERIALIZED ({_LEVELS}),
  nxt AS (SELECT source AS o, target AS n FROM every WHERE relation = 'precedes'),
  edges AS MATERIALIZED (SELECT v.*, CASE WHEN z.level < {_LOWER} THEN '(before ' || n || ')' ELSE '' END AS mark FROM (SELECT *, {first} AS s FROM every) v
    LEFT JOIN nxt ON nxt.o = v.s AND v.relation = 'participates in' LEFT JOIN lv y ON y.id = v.s LEFT JOIN lv z ON z.id = nxt.n WHERE coalesce(y.level, 0) <= {_UPPER}), {_HIT}""", 1)
        state = f""", top AS (SELECT max(level) AS m FROM lv), st8 AS (SELECT 'customer_' || o.o_custkey AS node, string_agg(e.description, ' ' ORDER BY e.s, e.description) AS told
  FROM ({_TIMED}) e JOIN orders o ON 'e' || o.o_orderkey = e.id LEFT JOIN lv a ON a.id = e.s LEFT JOIN lv b ON b.id = e.t, top
  WHERE coalesce(b.level, m) >= least({_LOWER}, {_UPPER}) AND coalesce(a.level, 0) <= {_UPPER} GROUP BY 1)"""
        about, mark = "coalesce(st.told, n.base_description)", "edges.mark"
    texts = _texts_sql(f"{_BOTH} UNION ALL SELECT query_id, id, score FROM pnd", about, "LEFT JOIN st8 st ON st.node = c.id AND EXISTS (SELECT 1 FROM ent x WHERE x.id = c.id)" if timed else "")
    marked = f"trim({mark} || ' ' || a.name || ' ' || edges.relation || ' ' || b.name || '. ' || edges.description)" if timed else "a.name || ' ' || edges.relation || ' ' || b.name || '. ' || edges.description"
    line = f"""SELECT query_id, source || ' ' || target AS id, weight AS score, text, {tokens_sql('text')} AS tokens FROM (
  SELECT e.query_id, source, target, weight, {marked} AS text, row_number() OVER (PARTITION BY e.query_id, source, target ORDER BY weight DESC, edges.id) AS r
  FROM ent e JOIN edges ON source = e.id JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE NOT EXISTS (SELECT 1 FROM ent x WHERE x.query_id = e.query_id AND x.id = target)) t
  WHERE r = 1 AND (query_id, source) IN (SELECT * FROM held) AND (query_id, target) IN (SELECT * FROM held)"""
    way = f"""SELECT query_id, start || ' ' || stop || ' ' || number AS id, score, text, {tokens_sql('text')} AS tokens FROM ptx
  WHERE (query_id, start) IN (SELECT * FROM held) AND (query_id, stop) IN (SELECT * FROM held)"""
    events = f"""SELECT 'g0' AS query_id, n.id, level, n.name || '. ' || strftime(o_orderdate, '%Y-%m-%d') || '. ' || n.base_description AS text
  FROM nodes n JOIN ({_LEVELS}) l ON l.id = n.id JOIN orders ON 'order_' || o_orderkey = n.id"""
    said = lambda k: f"coalesce(array_to_string(list_transform({k}.k, lambda x: x.x), chr(10)), '')"
    return f"""{graph}{state}, {_NEAR}, {_PATH_NODES}, {_PATH_TEXT}, {texts}, {_pack_sql('pn', 'SELECT * FROM txt', 400)}, held AS MATERIALIZED (SELECT query_id, unnest(k).id AS id FROM pn),
  {_pack_sql('pe', line, 200)}, {_pack_sql('pp', way, 100)}, world AS ({_history_sql(events, 300)})
  SELECT q.query_id, 'NODES:' || chr(10) || {said('pn')} || chr(10) || chr(10) || 'EDGES:' || chr(10) || {said('pe')} || chr(10) || chr(10) || 'PATHS:' || chr(10) || {said('pp')} || chr(10) || chr(10) || 'HISTORY:' || chr(10) || w.text AS context
  FROM (SELECT DISTINCT query_id FROM ent) q LEFT JOIN pn USING (query_id) LEFT JOIN pe USING (query_id) LEFT JOIN pp USING (query_id), world w"""


@query(_context_sql(False))
def ret_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, False)


@query(_context_sql(True))
def ret_context_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ret_context between two levels: edges that have begun, marked where they ended before, and nodes' states."""
    return _context(spark, sf_dir, True)
