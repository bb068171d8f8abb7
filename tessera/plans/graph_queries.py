"""Queries over graph tables and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.plans.registry import query, table
from tessera.plans.star_graph import STAR, star_graph

W = f"WITH {STAR} "


@query(W + "SELECT id, name, type, CASE type WHEN 'character' THEN '#ff6b6b' WHEN 'group' THEN '#ffa94d' WHEN 'location' THEN '#4dabf7' WHEN 'environment_element' THEN '#69db7c' WHEN 'item' THEN '#f783ac' WHEN 'event' THEN '#9775fa' ELSE '#cccccc' END AS colour FROM nodes")
def feed_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visual_nodes(star_graph(spark, sf_dir)).drop("graph_id")


@query(W + "SELECT id, relation, source, target, weight, greatest(1.0, weight)::DOUBLE AS width FROM edges")
def feed_visual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visual_edges(star_graph(spark, sf_dir)).drop("graph_id")


@query(W + "SELECT DISTINCT type, upper(left(type, 1)) || substr(type, 2) || 's' AS title FROM nodes")
def feed_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.legend(star_graph(spark, sf_dir)).drop("graph_id")


@query(W + "SELECT max(c) + 1 AS next_id FROM (SELECT chunk AS c FROM nodes UNION ALL SELECT chunk_id FROM edges)")
def chunk_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.next_chunk_id(star_graph(spark, sf_dir)).drop("graph_id")


@query(W + "SELECT chunk, type, count(*) AS n, min(id) AS first_id FROM nodes GROUP BY chunk, type")
def ext_nodes_in_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return G.nodes_in_chunks(g).join(g.nodes.select("id", "type"), "id").groupBy("chunk", "type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(W + "SELECT id, CASE WHEN type = 'location' THEN upper(name) ELSE name END AS name, type FROM nodes WHERE id <> 'region_0' UNION ALL SELECT 'region_new', 'NEW', 'location' UNION ALL SELECT id, upper(name), type FROM nodes WHERE id = 'region_0'")
def g_put_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    new = g.nodes.where("type = 'location'").withColumn("name", F.upper("name"))
    extra = g.nodes.where("id = 'region_0'").select("graph_id", F.lit("region_new").alias("id"), F.lit("NEW").alias("name"), "type", "base_description", "base_attributes", "chunk_id")
    return G.put_nodes(g, new.unionByName(extra)).nodes.select("id", "name", "type")


@query(W + "SELECT source, target, relation, CASE WHEN relation = 'located in' THEN 2.0 ELSE weight END::DOUBLE AS weight FROM edges")
def g_put_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    new = g.edges.where("relation = 'located in'").withColumn("weight", F.lit(2.0))
    return G.put_edges(g, new.unionByName(new.withColumn("target", F.lit(None).cast("string")))).edges.select("source", "target", "relation", "weight")


@query(W + "SELECT n.name, min(n.id) AS id FROM nodes n WHERE n.name IN (SELECT p_name FROM part) GROUP BY n.name")
def g_node_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = table(spark, sf_dir, "part").select(F.lit("g0").alias("graph_id"), F.col("p_name").alias("name"))
    return G.node_by_name(star_graph(spark, sf_dir), ask).drop("graph_id")


@query(W + "SELECT r.id, n.name, n.type FROM (SELECT 'order_' || event_id AS id FROM events) r LEFT JOIN nodes n ON n.id = r.id")
def g_node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = table(spark, sf_dir, "events").select(F.lit("g0").alias("graph_id"), F.concat(F.lit("order_"), F.col("event_id").cast("string")).alias("id"))
    return G.by_id(star_graph(spark, sf_dir).nodes, ask).select("id", "name", "type")


@query(W + "SELECT r.id, e.relation, e.weight FROM (SELECT 'customer_' || o_custkey || ' participates in order_' || (o_orderkey + o_orderkey % 2) AS id FROM orders) r LEFT JOIN edges e ON e.id = r.id")
def g_edge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = table(spark, sf_dir, "orders").select(F.lit("g0").alias("graph_id"), F.expr("concat('customer_', o_custkey, ' participates in order_', o_orderkey + o_orderkey % 2)").alias("id"))
    return G.by_id(star_graph(spark, sf_dir).edges, ask).select("id", "relation", "weight")


@query(W + "SELECT 'node' AS kind, type AS label, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY relation")
def g_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    a = g.nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("label")).agg(F.count("*").alias("n"))
    return a.unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("label")).agg(F.count("*").alias("n")))


@query(W + "SELECT e.id, e.weight FROM edges e WHERE (e.source, e.target) IN (SELECT 'supplier_' || l_suppkey, 'part_' || l_partkey FROM lineitem)")
def g_edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.lit("g0").alias("graph_id"), F.concat(F.lit("supplier_"), "l_suppkey").alias("source"), F.concat(F.lit("part_"), "l_partkey").alias("target"))
    return G.edges_between(star_graph(spark, sf_dir), pairs).select("id", "weight")


@query(W + "SELECT DISTINCT source AS id, target AS neighbour FROM edges WHERE source LIKE 'customer%'")
def g_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return G.neighbours(g, g.nodes.where("type = 'character'")).drop("graph_id")


@query(W + "SELECT id, CASE WHEN type = 'event' THEN name || '!' ELSE name END AS name, type FROM nodes")
def g_update_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    change = g.nodes.where("type = 'event'").select("graph_id", "id", F.concat("name", F.lit("!")).alias("name"))
    return G.update_nodes(g, change).nodes.select("id", "name", "type")


@query(W + "SELECT id, description, CASE WHEN relation = 'affects' THEN weight + 1 ELSE weight END AS weight FROM edges")
def g_update_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    change = g.edges.where("relation = 'affects'").select("graph_id", "id", (F.col("weight") + 1).alias("weight"))
    return G.update_edges(g, change).edges.select("id", "description", "weight")


@query(W + "SELECT id, source, target FROM edges WHERE source NOT LIKE 'part%' AND target NOT LIKE 'part%' AND relation <> 'involves'")
def g_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    g = G.remove_edges(g, g.edges.where("relation = 'involves'"))
    return G.remove_nodes(g, g.nodes.where("type = 'item'")).edges.select("id", "source", "target")


@query(W + "SELECT type, base_description = 'Auto-created missing node' AS made, count(*) AS n FROM (SELECT type, base_description FROM nodes WHERE type <> 'location' UNION ALL SELECT 'item', 'Auto-created missing node' FROM (SELECT DISTINCT id FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM nodes WHERE type <> 'location'))) GROUP BY 1, 2")
def g_repair_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    fixed = G.repair_dangling(G.Graph(g.nodes.where("type <> 'location'"), g.edges))
    return fixed.nodes.groupBy("type", (F.col("base_description") == "Auto-created missing node").alias("made")).agg(F.count("*").alias("n"))


@query(W + "SELECT id, CASE WHEN type = 'group' THEN 'insert' WHEN type = 'item' THEN 'update' ELSE 'keep' END AS action FROM nodes")
def g_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    new = g.nodes.where("type in ('group', 'item', 'event')").withColumn("base_description", F.when(F.col("type") == "item", "changed").otherwise(F.col("base_description")))
    return G.merge_diff(g.nodes.where("type <> 'group'"), new, ["name", "type", "base_description"]).drop("graph_id")


@query("SELECT o_orderpriority AS graph_id, max(o_orderkey) AS version, 'doc ' || max(o_orderkey) AS connected_document FROM orders GROUP BY o_orderpriority")
def g_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("graph_id"), F.col("o_orderkey").alias("version"), F.concat(F.lit("doc "), "o_orderkey").alias("connected_document"))
    return G.put_header(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"))


_TOKENS = r"coalesce(list_sum(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]'), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9]+') THEN greatest(1, round_even(length(x) / 3.5, 0)) WHEN regexp_full_match(x, '[А-Яа-яЁё]+') THEN greatest(1, round_even(length(x) / 2.4, 0)) ELSE 1 END)), 0)::BIGINT"


def tokens_sql(expr: str) -> str:
    return _TOKENS.format(expr)


@query(r"SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(p_name, '[^A-Za-zА-Яа-я\s]', '', 'g')), '\s+', '_', 'g')) AS id FROM part")
def fn_create_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.create_id(F.col("p_name")).alias("id"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^["'']+|["'']+$', '', 'g'), '^(a|an|the)\s+', '', 'i'), '\s+', ' ', 'g')) AS name FROM documents""")
def fn_clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_name(F.col("text")).alias("name"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^A-Za-zА-Яа-яЁё\s]', '', 'g')) AS digest FROM documents")
def fn_clean_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_string(F.col("text"))).alias("digest"))


@query(f"SELECT conv_id, turn, {tokens_sql('text')} AS tokens FROM conversations")
def fn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def fn_tokens_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))


# Fixed values that the SQL of fn_span_reject is held to; the library states its own.
_PRONOUNS = "i you he she it we they me him her us them my your his its our their".split()
_ABSTRACT = (
    "world fact history details event gameplay while stuff thing part place time way day night life system process state scene finish "
    "finishes cutie dear ancient greatest little angel"
).split()
_LINKS = "of|and|or|but|in|on|at|to|for|with|by|from|into|upon|without"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_SPANS = r"""SELECT doc_id, p, array_to_string(list_slice(w, 1 + p, 1 + p + p % 4), ' ') AS span
  FROM (SELECT doc_id, w, unnest(range(0, len(w), 5)) AS p FROM (SELECT doc_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM documents))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every fifth word of the whole text a span of one to four words: doc_id, p, span."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where("w is not null")
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 5).cast("int"))).alias("k"))
    p = F.col("k") * 5
    return rows.select("doc_id", p.alias("p"), F.array_join(F.slice("w", p + 1, p % 4 + 1), " ").alias("span"))


@query(rf"""SELECT doc_id, reason, count(*) AS spans FROM (SELECT doc_id, CASE WHEN length(low) < 2 THEN 'too_short' WHEN len(list_intersect(w, {_PRONOUNS})) > 0 AND len(w) > 1 THEN 'contains_pronoun' WHEN low IN {_in(_ABSTRACT)} THEN 'abstract_noun'
  WHEN regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])({_LINKS})([^\p{{L}}\p{{N}}_]|$)') THEN 'contains_preposition' END AS reason
  FROM (SELECT doc_id, low, list_distinct(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+')) AS w FROM (SELECT doc_id, lower(trim(span)) AS low FROM ({_SPANS})))) GROUP BY doc_id, reason""")
def fn_span_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).select("doc_id", X.span_reject(F.col("span")).alias("reason"))
    return rows.groupBy("doc_id", "reason").agg(F.count("*").alias("spans"))


@query(rf"""SELECT doc_id, label, count(*) AS spans, min(text) AS first, max(text) AS last FROM (SELECT doc_id, CASE WHEN ok THEN t END AS text, CASE WHEN ok THEN lab END AS label FROM (SELECT *, NOT (length(t) < 2 OR regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^\s*$') OR regexp_matches(t, '(?i)^({X.STOP_SPANS})$')
  OR (lab = 'character' AND n > 3 AND NOT regexp_matches(t, '(^|\s)\p{{Lu}}\p{{Ll}}*(\s|$)')) OR (lab = 'environment_element' AND length(t) < 4)) AS ok FROM (SELECT doc_id, t, len(regexp_extract_all(t, '\S+')) AS n,
  CASE WHEN l = 'location' AND regexp_matches(lower(t), 'key|book|note') THEN 'item' WHEN l = 'location' AND regexp_matches(lower(t), 'cat|demon|girl|boy|mom|dad') THEN 'character' ELSE l END AS lab
  FROM (SELECT doc_id, list_element(['location', 'character', 'environment_element'], 1 + CAST((doc_id + p) % 3 AS INT)) AS l, regexp_replace(span, '^[[:punct:] —–]+|[[:punct:] —–]+$', '', 'g') AS t FROM ({_SPANS}))))) GROUP BY doc_id, label""")
def fn_span_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("location"), F.lit("character"), F.lit("environment_element")), ((F.col("doc_id") + F.col("p")) % 3 + 1).cast("int"))
    rows = _spans(spark, sf_dir).select("doc_id", X.span_clean(F.col("span"), label).alias("s")).select("doc_id", "s.text", "s.label")
    return rows.groupBy("doc_id", "label").agg(F.count("*").alias("spans"), F.min("text").alias("first"), F.max("text").alias("last"))


# Fixed values that the SQL of these queries is held to; the library states its own.
_TYPE_OF = {
    "character": "character", "group": "group", "location": "location", "environment_element": "environment_element", "item": "item", "event": "event",
    "location_element": "location", "place": "location", "person": "character", "human": "character", "env_element": "environment_element",
    "natural_feature": "environment_element", "thing": "item", "weapon": "item", "x": "item",
}
_LABEL_OF = {
    "PERSON": "group", "CHARACTER": "character", "CHAR": "character", "HERO": "character", "ORG": "group", "GROUP": "group", "FACTION": "group",
    "GPE": "location", "LOC": "location", "FAC": "location", "LOCATION": "location", "PRODUCT": "item", "ITEM": "item", "OBJECT": "item", "ANIMAL": "item",
    "EVENT": "event", "ACTION": "event", "ENV": "environment_element", "ENV_ELEMENT": "environment_element", "NONE": None, "DATE": None,
}
_LEXICON = {
    "character:names": "maria john anna mister miss mr mrs ms dr sir lord lady",
    "character:roles": "girl boy woman man child daughter son mother father mom dad brother sister friend stranger hero villain",
    "item:animals": "cat dog bird horse wolf bear rabbit fox demon angel",
    "item:objects": "notebook book key sword rock bed door window lamp torch potion coin gem ring map compass",
    "item:rooms": "bedroom kitchen bathroom hall cellar attic room",
    "environment_element:parts": "wall ceiling floor path trail entrance exit stairs roof chimney fence gate corner",
    "event:nominalizations": "battle arrival departure death meeting fight journey wedding funeral ceremony attack rescue discovery",
}
_NAMES = [w for words in _LEXICON.values() for w in words.split()] + ["sea", "tree"]


def _said_sql(names: list[str]) -> str:
    """Every fifth word of the texts, three in four of them replaced by a name in capitals or between blanks."""
    own = f"list_element({names}, CAST(1 + (doc_id + p // 5) % {len(names)} AS INT))"
    return f"SELECT doc_id, CASE p // 5 % 4 WHEN 0 THEN upper({own}) WHEN 1 THEN ' ' || {own} || ' ' WHEN 2 THEN {own} ELSE span END AS said FROM ({_SPANS})"


def _said(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    at, which = F.floor(F.col("p") / 5), F.floor(F.col("p") / 5) % 4
    own = F.element_at(F.array(*map(F.lit, names)), ((F.col("doc_id") + at) % len(names) + 1).cast("int"))
    said = F.when(which == 0, F.upper(own)).when(which == 1, F.concat(F.lit(" "), own, F.lit(" "))).when(which == 2, own).otherwise(F.col("span"))
    return _spans(spark, sf_dir).select("doc_id", said.alias("said"))


def _cases(values: dict[str, str | None]) -> str:
    return " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if v else "NULL") for k, v in values.items())


@query(f"SELECT doc_id, CASE lower(trim(said, ' ')) {_cases(_TYPE_OF)} ELSE 'item' END AS type, count(*) AS n FROM ({_said_sql(list(_TYPE_OF))}) GROUP BY ALL")
def fn_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir, list(_TYPE_OF)).select("doc_id", X.entity_type(F.col("said")).alias("type"))
    return rows.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE upper(said) {_cases(_LABEL_OF)} END AS type, count(*) AS n FROM ({_said_sql(list(_LABEL_OF))}) GROUP BY ALL")
def fn_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir, list(_LABEL_OF)).select("doc_id", X.label_type(F.col("said"), {"person": "group"}).alias("type"))
    return rows.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


_KINDS = " ".join(f"WHEN low IN {_in(words.split())} THEN '{kind}'" for kind, words in _LEXICON.items())


@query(f"""SELECT doc_id, coalesce(split_part(k, ':', 1), 'location') AS type, coalesce('lexicon_override:' || split_part(k, ':', 2), 'no_override') AS reason, count(*) AS n
  FROM (SELECT doc_id, CASE {_KINDS} END AS k FROM (SELECT doc_id, lower(trim(said, ' ')) AS low FROM ({_said_sql(_NAMES)}))) GROUP BY ALL""")
def fn_type_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir, _NAMES).select("doc_id", X.type_correct(F.col("said"), F.lit("location")).alias("t"))
    return rows.groupBy("doc_id", "t.type", "t.reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > length(p_type) THEN p_name WHEN length(p_name) < length(p_type) THEN p_type WHEN regexp_matches(p_name, '^[A-Z]') AND NOT regexp_matches(p_type, '^[A-Z]') THEN p_name WHEN NOT regexp_matches(p_name, '^[A-Z]') AND regexp_matches(p_type, '^[A-Z]') THEN p_type WHEN lower(p_name) <= lower(p_type) THEN p_name ELSE p_type END AS name FROM part")
def fn_pick_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.pick_name(F.col("p_name"), F.col("p_type")).alias("name"))


_PAIRS = "SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"), F.col("label").alias("lb"))
    return a.select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("la")).join(b, "vec_id")


@query(f"SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS similarity FROM ({_PAIRS})")
def fn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_pairs(spark, sf_dir).select("vec_id", F.round(X.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


def lexical_sql(a: str, b: str) -> str:
    words = lambda v: rf"list_distinct(regexp_extract_all(lower(trim({v})), '[\p{{L}}\p{{N}}_]+'))"
    return f"((1 - levenshtein(lower(trim({a})), lower(trim({b}))) / greatest(length(trim({a})), length(trim({b})), 1)) + len(list_intersect({words(a)}, {words(b)})) / greatest(1, len(list_distinct(list_concat({words(a)}, {words(b)}))))) / 2"


@query(f"SELECT p_partkey, round({lexical_sql('p_name', 'p_type')}, 6) AS similarity FROM part")
def fn_lexical_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.lexical_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query(f"SELECT vec_id, round(0.6 * list_cosine_similarity(x, y) + 0.3 * {lexical_sql('na', 'nb')} + 0.1 * (CASE WHEN la <> lb THEN 0.0 WHEN na <> nb AND (contains(na, nb) OR contains(nb, na)) THEN 0.9 ELSE 1.0 END), 5) AS similarity FROM (SELECT *, 'item ' || vec_id AS na, 'item ' || (vec_id % 10) AS nb FROM ({_PAIRS}))")
def fn_hybrid_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.concat(F.lit("item "), "vec_id"), F.concat(F.lit("item "), F.col("vec_id") % 10)
    sim = X.hybrid_similarity(a, b, F.col("la"), F.col("lb"), X.cosine(F.col("x"), F.col("y")))
    return _vector_pairs(spark, sf_dir).select("vec_id", F.round(sim, 5).alias("similarity"))


@query("SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE text END, chr(10) || ' ') AS body FROM conversations")
def fn_answer_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```xml\n<Answer >"), t, F.lit("</answer> tail\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<reasoning>why\n</reasoning>\n"), t)).otherwise(F.concat(F.lit("\n<answer>"), t))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.answer_body(raw, "answer").alias("body"))


@query(r"SELECT 'd' || doc_id AS id, greatest(0.0, least(1.0, coalesce(try_cast(regexp_extract(text, '([0-9]*\.?[0-9]+)', 1) AS DOUBLE), 0.0))) AS score FROM documents UNION ALL SELECT 'e' || event_id, greatest(0.0, least(1.0, round(value, 2))) FROM events")
def fn_score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of every document, and replies that say one."""
    said = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.concat(F.lit("Score: "), F.format_string("%.2f", "value"), F.lit(" of 1")).alias("text"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(said)
    return rows.select("id", X.score_parse(F.col("text")).alias("score"))


@query(r"SELECT doc_id, count(g)::BIGINT AS n, md5(coalesce(string_agg(g, '|' ORDER BY i), '')) AS digest FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) ELSE [NULL] END) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents))) GROUP BY doc_id")
def fn_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.ngrams(F.col("text"), 3)
    return table(spark, sf_dir, "documents").select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))
