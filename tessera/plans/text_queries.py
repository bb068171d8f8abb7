"""Queries over chunks, conversations, metrics, annotations, extraction and response tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.functions import text as X
from tessera.operators import annotation as A
from tessera.operators import build as B
from tessera.operators import chunking as K
from tessera.operators import conversations as C
from tessera.operators import evaluation as V
from tessera.operators import extraction as E
from tessera.operators.graph import Graph
from tessera.plans.graph_queries import W, tokens_sql
from tessera.plans.registry import query, table
from tessera.plans.star_graph import star_graph

docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")
talks = lambda spark, sf_dir: table(spark, sf_dir, "conversations")

_FIXED = "SELECT doc_id, CAST(pos AS INT) AS pos, substr(text, CAST(pos * 450 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 50) / 450) AS BIGINT)))) AS pos FROM documents WHERE length(text) > 0)"


@query(f"SELECT doc_id, pos, md5(text) AS digest FROM ({_FIXED})")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_fixed(docs(spark, sf_dir)).select("doc_id", "pos", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) + 99 AS chunk_id FROM ({_FIXED})")
def chunk_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.number(K.split_fixed(docs(spark, sf_dir)).select("doc_id", "pos"), 100).select("doc_id", "pos", "chunk_id")


def _split_sql() -> str:
    """Parts by lists of strings, level by level; from every part on, the end of a chunk and the start of the next one
    by prefix sums; then the chain of these from every text's start."""
    rows = "SELECT doc_id, [text] AS ps FROM documents WHERE length(text) > 0"
    for sep in ("chr(10) || chr(10)", "chr(10)", "' '"):
        cut = f"string_split(p, {sep})"
        cut = f"list_transform({cut}, lambda x, i: x || CASE WHEN i < len({cut}) THEN {sep} ELSE '' END)"
        rows = f"SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 500 THEN [p] ELSE {cut} END)) AS ps FROM ({rows})"
    cut = "list_transform(range(0, (length(p) + 499) // 500), lambda k: substr(p, k * 500 + 1, 500))"
    rows = f"SELECT doc_id, list_filter(flatten(list_transform(ps, lambda p: {cut})), lambda p: p <> '') AS ps FROM ({rows})"
    return f"""WITH RECURSIVE parts AS (SELECT doc_id, unnest(list_transform(ps, lambda p: length(p))) AS n, generate_subscripts(ps, 1) AS i FROM ({rows})),
  placed AS MATERIALIZED (SELECT *, c1 - n AS c0, lead(c1) OVER (PARTITION BY doc_id ORDER BY i) AS c2
    FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c1 FROM parts)),
  ends AS (SELECT a.doc_id, a.c0 AS s, b.c1 AS e, CASE WHEN b.c2 IS NOT NULL THEN greatest(b.c1 - 50, b.c2 - 500) END AS again
    FROM placed a ASOF JOIN placed b ON a.doc_id = b.doc_id AND a.c0 + 500 >= b.c1),
  jump AS MATERIALIZED (SELECT x.doc_id, x.s, x.e, y.c0 AS next FROM ends x ASOF LEFT JOIN placed y ON x.doc_id = y.doc_id AND x.again <= y.c0),
  chain AS (SELECT doc_id, 0 AS pos, s, e, next FROM jump WHERE s = 0
    UNION ALL SELECT j.doc_id, c.pos + 1, j.s, j.e, j.next FROM chain c JOIN jump j ON j.doc_id = c.doc_id AND j.s = c.next)
  SELECT doc_id, pos, (e - s)::INT AS size, md5(substr(text, s + 1, e - s)) AS digest FROM chain JOIN documents USING (doc_id)"""


@query(_split_sql())
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split(docs(spark, sf_dir)).select("doc_id", "pos", F.length("text").alias("size"), F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')")
def chat_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accepted(talks(spark, sf_dir)).select("conv_id", "turn", "role")


@query(f"SELECT conv_id, sum({tokens_sql('text')})::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_totals(talks(spark, sf_dir))


def _window(budget: str, frm: str) -> str:
    line = "CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text"
    return f"SELECT conv_id, count(*) AS n, string_agg({line}, chr(10) ORDER BY turn) AS context FROM (SELECT *, sum({tokens_sql('text')}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM {frm} WHERE role <> 'system') WHERE used <= {budget} GROUP BY conv_id"


@query(_window("1024", "conversations"))
def chat_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.window(talks(spark, sf_dir), F.lit(1024))


_TOPICS = "(SELECT conv_id, text AS topic FROM conversations WHERE turn = 0)"
_TOPIC_TOKENS = tokens_sql("'Topic: ' || topic")
_WITH_TOPIC = f"(SELECT c.*, {_TOPIC_TOKENS} AS tt FROM conversations c JOIN {_TOPICS} USING (conv_id))"


@query(f"SELECT w.conv_id, w.n, 'Topic: ' || t.topic || chr(10) || w.context AS context FROM ({_window('1500 - tt', _WITH_TOPIC)}) w JOIN {_TOPICS} t USING (conv_id)")
def chat_window_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talks(spark, sf_dir)
    return C.topic_window(rows, rows.where("turn = 0").select("conv_id", F.col("text").alias("topic")), 1500)


@query("SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic FROM conversations")
def chat_topic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.topic_states(talks(spark, sf_dir).select("conv_id", "turn", (F.col("turn") % 3 == 0).alias("is_new_topic"), F.col("text").alias("summary")))


_GRAMS = r"SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents))) GROUP BY doc_id, g"


@query(f"SELECT d.doc_id, round(coalesce(v, 0), 6) AS score FROM documents d LEFT JOIN (SELECT doc_id, count(*) / sum(c) AS v FROM ({_GRAMS}) GROUP BY doc_id) USING (doc_id)")
def ev_distinct_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(V.distinct_n(F.col("text")), 6).alias("score"))


@query(f"SELECT d.doc_id, round(coalesce(v, 0), 6) AS score FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (c > 1) / sum(c) AS v FROM ({_GRAMS}) GROUP BY doc_id) USING (doc_id)")
def ev_repetition_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(V.repetition_n(F.col("text")), 6).alias("score"))


_EV = f"(SELECT doc_id AS task_id, source AS pipeline, 'distinct_2' AS metric, v AS score FROM (SELECT d.doc_id, d.source, coalesce(v, 0) AS v FROM documents d LEFT JOIN (SELECT doc_id, count(*) / sum(c) AS v FROM ({_GRAMS}) GROUP BY doc_id) USING (doc_id)) UNION ALL SELECT doc_id, source, 'score', 0.5 FROM documents)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    tasks = d.select(F.col("doc_id").alias("task_id"), F.array(F.lit("distinct_2"), F.lit("score")).alias("metric"))
    responses = d.select(F.col("doc_id").alias("task_id"), F.col("source").alias("pipeline"), F.col("text").alias("response"))
    return V.run(tasks, responses, {"distinct_2": V.distinct_n, "score": lambda r: V.X.score_parse(F.concat(F.lit("0.5 "), r))})


@query(f"SELECT task_id, pipeline, metric, round(score, 6) AS score FROM {_EV}")
def ev_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"SELECT pipeline, metric, round(avg(score), 6) AS mean_score, count(*) AS n FROM {_EV} GROUP BY pipeline, metric")
def ev_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(_results(spark, sf_dir))


@query("""SELECT source AS pipeline, round(avg(score), 6) AS mean_score, count(*) AS n, count(*) FILTER (score IS NULL) AS failed FROM (SELECT source,
  CASE WHEN length(text) % 50 = 0 THEN 0 ELSE least(1.0, (length(text) - length(replace(text, 'a', ''))) % 130 / 100.0) END AS score FROM documents) GROUP BY source""")
def ev_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge as a user model: a prompt a response, its reply parsed. This one rates by how many a's it reads,
    says nothing of some responses and more than it should of others."""
    d = docs(spark, sf_dir)

    def judge(prompts: list[str]) -> list[str]:
        said = []
        for p in prompts:
            text = p.split("\n", 1)[1]
            said.append("I cannot say." if len(text) % 50 == 0 else f"I rate it {text.count('a') % 130 / 100:.2f}, not 0.3")
        return said

    prompt = F.concat(F.lit("How consistent is this response?\n"), F.coalesce("text", F.lit("")))
    replies = models.generate(d.select("source", prompt.alias("prompt")), judge).select(F.col("source").alias("pipeline"), X.score_parse(F.col("raw")).alias("score"), "status")
    return replies.groupBy("pipeline").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"), F.count(F.when(F.col("status") != "ok", 1)).alias("failed"))


@query("SELECT l_orderkey, l_linenumber, s AS start, e AS \"end\" FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 3 THEN l_linenumber END AS s, CAST(l_quantity AS INT) AS e FROM lineitem) WHERE s IS NOT NULL AND s < e")
def ann_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("l_linenumber") % 4 == 3, F.lit("x")).otherwise(F.col("l_linenumber").cast("string"))
    raw = F.array(F.struct(start.alias("start"), F.col("l_quantity").cast("int").cast("string").alias("end"), F.col("l_returnflag").alias("label")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(A.normalise(raw)).alias("x")).select("l_orderkey", "l_linenumber", "x.start", "x.end")


_SPAN_ROWS = "SELECT l_orderkey AS k, CAST(l_partkey % 90 AS INT) AS s, CAST(l_partkey % 90 + l_quantity AS INT) AS e, l_returnflag AS label FROM lineitem"


@query(f"""WITH RECURSIVE spans AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s - e, s, e, label) AS i FROM ({_SPAN_ROWS})),
  keep AS (SELECT k, i, [{{'s': s, 'e': e}}] AS kept, s, e, TRUE AS ok FROM spans WHERE i = 1 UNION ALL
  SELECT x.k, x.i, CASE WHEN c.ok THEN list_append(r.kept, {{'s': x.s, 'e': x.e}}) ELSE r.kept END, x.s, x.e, c.ok FROM keep r JOIN spans x ON x.k = r.k AND x.i = r.i + 1,
  LATERAL (SELECT len(list_filter(r.kept, lambda y: y.s < x.e AND x.s < y.e)) = 0 AS ok) c) SELECT k, s AS start, e AS "end" FROM keep WHERE ok""")
def ann_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("l_partkey") % 90).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(at.alias("start"), (at + F.col("l_quantity")).cast("int").alias("end"), F.col("l_returnflag").alias("label"))).alias("xs"))
    return rows.select("k", F.explode(A.without_overlap(F.col("xs"))).alias("x")).select("k", "x.start", "x.end")


_AT = "1 + CAST(doc_id * 7919 % greatest(1, length(text) - 7) AS BIGINT)"


@query(f"""SELECT doc_id, CASE WHEN strpos(text, w) > 0 THEN strpos(text, w) - 1 WHEN strpos(lower(text), lower(w)) > 0 THEN strpos(lower(text), lower(w)) - 1 END AS start
  FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN translate(substr(text, {_AT}, 8), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN doc_id % 3 = 1 THEN substr(text, {_AT}, 8) ELSE '#none#' END AS w FROM documents)""")
def ann_reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight characters from a place that the id picks in the whole text, as they are or in capitals."""
    at = (F.col("doc_id") * 7919 % F.greatest(F.lit(1), F.length("text") - 7) + 1).cast("int")
    own, kind = F.substring("text", at, F.lit(8)), F.col("doc_id") % 3
    said = F.when(kind == 0, F.translate(own, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(kind == 1, own).otherwise("#none#")
    return docs(spark, sf_dir).select("doc_id", A.reanchor(F.col("text"), said).alias("start"))


# extraction: an order is a chunk, its parts are entities, consecutive lines are relations
_ENT = "SELECT l_orderkey AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, p_name AS name, p_type AS ptype, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey"
_BASE = r"lower(regexp_replace(trim(regexp_replace({0}, '[^A-Za-zА-Яа-я\s]', '', 'g')), '\s+', '_', 'g'))"
_ENTN = f"SELECT *, base || CASE WHEN k = 1 THEN '' ELSE '_' || (k - 1) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY chunk_id, pos) AS k FROM (SELECT *, {_BASE.format('name')} AS base FROM ({_ENT})))"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.select(F.lit("g0").alias("graph_id"), F.col("l_orderkey").alias("chunk_id"), F.row_number().over(w).alias("pos"), F.col("p_name").alias("name"), F.lit("item").alias("type"), F.col("p_type").alias("description"), F.col("l_quantity").alias("q"))


def _relations(e: DataFrame) -> DataFrame:
    nxt = e.select("chunk_id", (F.col("pos") - 1).alias("pos"), F.col("name").alias("node2"))
    return e.join(nxt, ["chunk_id", "pos"]).select("graph_id", "chunk_id", "pos", F.col("name").alias("node1"), "node2", F.lit("came before").alias("relation_from1to2"), F.lit("came after").alias("relation_from2to1"), F.lit("").alias("description"), F.col("q").alias("weight"))


@query(f"SELECT chunk_id, pos, id FROM ({_ENTN})")
def ext_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entity_nodes(_entities(spark, sf_dir)).select("chunk_id", "pos", "id")


@query(f"SELECT base AS base_id, count(*) AS n, max(id) AS last FROM ({_ENTN}) GROUP BY base")
def ext_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entity_nodes(_entities(spark, sf_dir).drop("description")).groupBy("base_id").agg(F.count("*").alias("n"), F.max("id").alias("last"))


_REL = f"SELECT a.chunk_id, a.pos, a.name AS n1, b.name AS n2, a.q AS w FROM ({_ENT}) a JOIN ({_ENT}) b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1"
_EDGES = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk_id DESC, pos DESC, dir DESC) AS last FROM (
  SELECT chunk_id, pos, fid AS id, i1 AS source, i2 AS target, 0 AS dir FROM firsts UNION ALL SELECT chunk_id, pos, {_BASE.format("n2 || ' came after ' || n1 || ' edge'")}, i2, i1, 1 FROM firsts)) WHERE last = 1"""


@query(f"""WITH ent AS ({_ENTN}), nm AS (SELECT chunk_id, name, max_by(id, pos) AS id FROM ent GROUP BY chunk_id, name), rel AS ({_REL}),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY chunk_id, pos) AS r FROM (SELECT rel.*, x.id AS i1, y.id AS i2, {_BASE.format("n1 || ' came before ' || n2 || ' edge'")} AS fid FROM rel JOIN nm x ON x.chunk_id = rel.chunk_id AND x.name = n1 JOIN nm y ON y.chunk_id = rel.chunk_id AND y.name = n2)) WHERE r = 1)
  SELECT id, source, target, chunk_id FROM ({_EDGES})""")
def ext_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return E.relation_edges(_relations(e), E.entity_nodes(e)).select("id", "source", "target", "chunk_id")


@query(f"WITH f AS (SELECT {_BASE.format('name')} AS id, max_by(ptype, chunk_id * 100 + pos) AS d, max_by(name, chunk_id * 100 + pos) AS nm FROM ({_ENT}) GROUP BY 1), k AS (SELECT {_BASE.format('p_name')} AS id, min(p_name) AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT coalesce(k.id, f.id) AS id, coalesce(k.name, f.nm) AS name, coalesce(f.d, 'old') AS description FROM k FULL JOIN f ON k.id = f.id")
def ext_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _entities(spark, sf_dir).withColumn("id", X.create_id(F.col("name")))
    known = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").groupBy(X.create_id(F.col("p_name")).alias("id")).agg(F.min("p_name").alias("name"))
    known = known.select(F.lit("g0").alias("graph_id"), "id", "name", F.lit("item").alias("type"), F.lit("old").alias("description"))
    return E.enrich_nodes(known, found).select("id", "name", "description")


_LEX = "SELECT unnest(['the', 'of', 'la', 'die', 'que']) AS word, unnest(['item', 'item', 'location', 'group', 'event']) AS type"
_MEN = rf"SELECT doc_id, CAST(p - 1 AS INT) AS pos, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents))"


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("the", "item"), ("of", "item"), ("la", "location"), ("die", "group"), ("que", "event")], "word string, type string")


@query(f"SELECT doc_id, pos, word, type FROM ({_MEN}) JOIN ({_LEX}) USING (word)")
def ext_mentions_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lexicon_mentions(docs(spark, sf_dir), _lexicon(spark)).select("doc_id", "pos", "word", "type")


_NER = "SELECT o_orderkey AS chunk_id, p_name AS text, 'item' AS type, l_linenumber % 2 = 0 AS proper, l_linenumber % 3 = 0 AS confirmed FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
_FUSE = f"""SELECT * FROM (SELECT chunk_id, text, type, round(CASE WHEN ner IS NULL THEN rule WHEN rules > 0 THEN greatest(ner, least(0.85, ner + 0.05 * rules)) ELSE ner END, 4) AS confidence, CASE WHEN ner IS NULL THEN 'rule' WHEN rules > 0 THEN 'ner+rule' ELSE 'ner' END AS source
  FROM (SELECT chunk_id, text, type, max(ner) AS ner, max(rule) AS rule, count(rule) AS rules FROM (SELECT chunk_id, lower(text) AS text, type, CAST(0.6 + CASE WHEN proper THEN 0.1 ELSE 0 END + CASE WHEN confirmed THEN 0.1 ELSE 0 END AS DOUBLE) AS ner, NULL::DOUBLE AS rule FROM ({_NER}) WHERE chunk_id % 3 <> 0
  UNION ALL SELECT chunk_id, lower(text), type, NULL, CASE WHEN proper THEN 0.65 ELSE 0.60 END FROM ({_NER}) WHERE chunk_id % 2 = 0) GROUP BY chunk_id, text, type)) WHERE confidence >= 0.6 AND length(text) BETWEEN 2 AND 50"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("chunk_id"), F.col("p_name").alias("text"), F.lit("item").alias("type"), (F.col("l_linenumber") % 2 == 0).alias("proper"), (F.col("l_linenumber") % 3 == 0).alias("confirmed"))
    return E.fuse_mentions(rows.where("chunk_id % 3 <> 0"), rows.where("chunk_id % 2 = 0"))


@query(f"SELECT chunk_id, text, confidence, source FROM ({_FUSE})")
def ext_mentions_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).drop("type")


@query(f"SELECT {_BASE.format('text')} AS id, text AS name, count(DISTINCT chunk_id) AS chunks, max(confidence) AS confidence FROM ({_FUSE}) GROUP BY text")
def ext_mentions_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mention_nodes(_fused(spark, sf_dir)).select("id", "name", F.size("chunk_id").cast("long").alias("chunks"), "confidence")


@query(f"SELECT o.o_orderkey AS chunk_id, 'Text fragment:' || chr(10) || o.o_orderpriority || chr(10) || chr(10) || 'Entities in chunk:' || chr(10) || coalesce(string_agg(DISTINCT p_name, ', ' ORDER BY p_name), '') AS prompt FROM orders o LEFT JOIN (SELECT chunk_id, name AS p_name FROM ({_ENT}) WHERE pos > 1) ON chunk_id = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderpriority")
def ext_prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("text"))
    return E.prompt_rows(chunks, _entities(spark, sf_dir).where("pos > 1").select("chunk_id", "name"))


_BUILT = "SELECT 'node' AS kind, id, name, description, chunks FROM built UNION ALL SELECT 'edge', id, source, target, chunk_id FROM joined"
_ONCE = f"said AS MATERIALIZED ({_ENT}), rel AS MATERIALIZED (SELECT a.chunk_id, a.pos, a.name AS n1, b.name AS n2, a.q AS w FROM said a JOIN said b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1)"
_FIRSTS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY chunk_id, pos) AS r FROM (SELECT rel.*, x.id AS i1, y.id AS i2, {_BASE.format("n1 || ' came before ' || n2 || ' edge'")} AS fid FROM rel JOIN nm x ON {{x}}x.name = n1 JOIN nm y ON {{y}}y.name = n2)) WHERE r = 1"


def _built(g: Graph, description: str) -> DataFrame:
    nodes = g.nodes.select(F.lit("node").alias("kind"), "id", "name", F.col(description).alias("description"), F.size("chunk_id").cast("long").alias("chunks"))
    return nodes.union(g.edges.select(F.lit("edge"), "id", "source", "target", "chunk_id"))


_ORD = "chunk_id * 100 + pos"


@query(f"""WITH {_ONCE}, ent AS MATERIALIZED ({_ENTN.replace(_ENT, "SELECT * FROM said")}), lead AS MATERIALIZED (SELECT lower(trim(name)) AS key, min_by(id, {_ORD}) AS id, min_by(name, (-length(name), CASE WHEN regexp_matches(name, '^[A-Z]') THEN 0 ELSE 1 END, lower(name))) AS name, max_by(ptype, {_ORD}) AS description, count(DISTINCT chunk_id) AS chunks FROM ent GROUP BY 1),
  led AS MATERIALIZED (SELECT ent.id AS own, lead.id FROM ent JOIN lead ON key = lower(trim(ent.name))), nm AS MATERIALIZED (SELECT chunk_id, name, max_by(id, pos) AS id FROM ent GROUP BY chunk_id, name),
  firsts AS MATERIALIZED ({_FIRSTS.format(x="x.chunk_id = rel.chunk_id AND ", y="y.chunk_id = rel.chunk_id AND ")}),
  built AS (SELECT * FROM lead), joined AS (SELECT e.id, a.id AS source, b.id AS target, e.chunk_id FROM ({_EDGES}) e JOIN led a ON a.own = e.source JOIN led b ON b.own = e.target) {_BUILT}""")
def g_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return _built(B.from_entities(e, _relations(e)), "base_description")


_NAMED = f"""WITH {_ONCE}, ent AS MATERIALIZED (SELECT *, base || CASE WHEN k = 1 THEN '' ELSE '_' || (k - 1) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY chunk_id, pos) AS k FROM (SELECT *, {_BASE.format('name')} AS base FROM ({{names}})))),
  lead AS (SELECT lower(trim(name)) AS key, min_by(id, {_ORD}) AS id, min_by(name, (-length(name), CASE WHEN regexp_matches(name, '^[A-Z]') THEN 0 ELSE 1 END, lower(name))) AS name FROM ent GROUP BY 1),
  told AS MATERIALIZED (SELECT t.chunk_id, t.pos, t.name, t.ptype, coalesce(lead.id, {_BASE.format('t.name')}) AS id FROM said t LEFT JOIN lead ON key = lower(trim(t.name))),
  places AS MATERIALIZED (SELECT chunk_id, pos, ent.name, lead.id FROM ent JOIN lead ON key = lower(trim(ent.name)) UNION ALL SELECT chunk_id, pos, name, id FROM told),
  nm AS MATERIALIZED (SELECT name, max_by(id, {_ORD}) AS id FROM places GROUP BY name), firsts AS MATERIALIZED ({_FIRSTS.format(x="", y="")}),
  f AS (SELECT id, max_by(name, {_ORD}) AS name, max_by(ptype, {_ORD}) AS description FROM told GROUP BY id),
  built AS (SELECT id, coalesce(lead.name, f.name) AS name, coalesce(f.description, '') AS description, chunks FROM lead FULL JOIN f USING (id) JOIN (SELECT id, count(DISTINCT chunk_id) AS chunks FROM places GROUP BY id) USING (id)),
  joined AS (SELECT id, source, target, chunk_id FROM ({_EDGES})) {_BUILT}"""


@query(_NAMED.format(names=f"SELECT chunk_id, pos, name FROM ({_ENT})"))
def g_build_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return _built(B.from_names(e, e, _relations(e)), "description")


@query(_NAMED.format(names=f"SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY text) AS pos, text AS name FROM ({_FUSE})"))
def g_build_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return _built(B.from_mentions(_fused(spark, sf_dir).withColumn("graph_id", F.lit("g0")), e, _relations(e)), "description")


@query(f"WITH have AS ({_ENTN.replace('lineitem', '(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)')}), used AS (SELECT base, count(*) AS u FROM have GROUP BY base) SELECT chunk_id, pos, m.base || CASE WHEN k - 1 + coalesce(u, 0) = 0 THEN '' ELSE '_' || (k - 1 + coalesce(u, 0)) END AS id FROM ({_ENTN.replace('lineitem', '(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)')}) m LEFT JOIN used USING (base)")
def cmp_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return E.complete_entities(E.entity_nodes(e.where("chunk_id % 2 = 0")), e.where("chunk_id % 2 = 1")).select("chunk_id", "pos", "id")


@query(W + """, m AS (SELECT DISTINCT 'customer_' || (user_id + 1) AS s, 'order_' || event_id AS t FROM events), ok AS (SELECT * FROM m WHERE s IN (SELECT id FROM nodes) AND t IN (SELECT id FROM nodes) AND s || ' participates in ' || t NOT IN (SELECT id FROM edges))
  SELECT s || ' participates in ' || t AS id, s AS source, t AS target FROM ok UNION ALL SELECT t || ' involves ' || s, t, s FROM ok""")
def cmp_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    missing = table(spark, sf_dir, "events").select(F.lit("g0").alias("graph_id"), F.col("event_id").alias("pos"), F.concat(F.lit("customer_"), F.col("user_id") + 1).alias("source"), F.concat(F.lit("order_"), "event_id").alias("target"), F.lit("participates in").alias("relation"), F.lit("involves").alias("back"))
    return E.complete_relations(g.edges, g.nodes, missing).select("id", "source", "target")
