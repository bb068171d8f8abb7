"""Extraction results to node and edge tables.

Entities: graph_id, chunk_id, pos, name, type, description, attributes. Relations: graph_id,
chunk_id, pos, node1, node2, relation_from1to2, relation_from2to1, description, weight.
Order is always (chunk_id, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

ORDER = ["chunk_id", "pos"]


def entity_nodes(entities: DataFrame, taken: DataFrame | None = None, bucket_chunks: int = 1024) -> DataFrame:
    """One node an entity; a base id met again gets _1, _2, ... in order. ``taken``: graph_id, base_id, used.

    Numbers are counted in two steps - within ``bucket_chunks`` consecutive chunks, and over the
    buckets before - so a name that is everywhere is not one task."""
    key = ["graph_id", "base_id"]
    rows = entities.withColumn("base_id", X.create_id(F.col("name"))).where("base_id <> ''")
    rows = rows.withColumn("__bucket", F.floor(F.col("chunk_id") / bucket_chunks))
    counts = rows.groupBy(*key, "__bucket").agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*key, "__bucket", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    if taken is not None:
        before = before.join(taken, key, "left").withColumn("__before", F.col("__before") + F.coalesce("used", F.lit(0))).drop("used")
    own = F.row_number().over(Window.partitionBy(*key, "__bucket").orderBy(*ORDER)) - 1
    rows = rows.withColumn("n", own).join(before, [*key, "__bucket"]).withColumn("n", F.col("n") + F.col("__before"))
    ident = F.when(F.col("n") == 0, F.col("base_id")).otherwise(F.concat_ws("_", "base_id", F.col("n").cast("string")))
    return rows.withColumn("id", ident).drop("n", "__bucket", "__before")


def relation_edges(relations: DataFrame, nodes: DataFrame, per_chunk: bool = True) -> DataFrame:
    """Forward and reverse edges. Names resolve in the relation's own chunk, the last of equal names;
    the first relation with a forward id wins in the graph."""
    keys = ["graph_id", "chunk_id"] if per_chunk else ["graph_id"]
    names = nodes.groupBy(*keys, "name").agg(F.max_by("id", F.struct(*ORDER)).alias("nid"))
    found = relations
    for end in ("node1", "node2"):
        found = found.join(names.withColumnRenamed("name", end).withColumnRenamed("nid", f"{end}_id"), [*keys, end])
    forward = X.create_id(F.concat_ws(" ", "node1", "relation_from1to2", "node2", F.lit("edge")))
    found = found.withColumn("fid", forward)
    first = Window.partitionBy("graph_id", "fid").orderBy(*ORDER)
    found = found.withColumn("r", F.row_number().over(first)).where("r = 1")
    back = X.create_id(F.concat_ws(" ", "node2", "relation_from2to1", "node1", F.lit("edge")))
    end = lambda i, s, t, r, k: F.struct(i.alias("id"), F.col(s).alias("source"), F.col(t).alias("target"), F.col(r).alias("relation"), F.lit(k).alias("dir"))
    both = found.withColumn("e", F.explode(F.array(end(F.col("fid"), "node1_id", "node2_id", "relation_from1to2", 0), end(back, "node2_id", "node1_id", "relation_from2to1", 1))))
    last = Window.partitionBy("graph_id", "e.id").orderBy(*[F.desc(c) for c in ORDER], F.desc("e.dir"))
    both = both.withColumn("r", F.row_number().over(last)).where("r = 1")
    return both.select("graph_id", "e.id", "e.source", "e.target", "e.relation", "description", "weight", "chunk_id")


def enrich_nodes(known: DataFrame, found: DataFrame) -> DataFrame:
    """known, found: graph_id, id, name, type, description (found also chunk_id, pos). Known nodes keep name
    and type and take the latest description; unknown ids become nodes."""
    latest = found.groupBy("graph_id", "id").agg(F.max_by(F.struct("name", "type", "description"), F.struct(*ORDER)).alias("f"))
    both = known.join(latest, ["graph_id", "id"], "full_outer")
    return both.select("graph_id", "id", F.coalesce("name", "f.name").alias("name"), F.coalesce("type", "f.type").alias("type"), F.coalesce("f.description", "description").alias("description"))


def lexicon_mentions(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """chunks: doc_id, text; lexicon: word, type. One row a word of the text that the lexicon holds."""
    words = chunks.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))).alias("pos", "word"))
    return words.join(lexicon, "word")


def fuse_mentions(tagged: DataFrame, ruled: DataFrame, threshold: float = 0.60, shortest: int = 2, longest: int = 50) -> DataFrame:
    """Mentions of a tagger and of rules, one row a (chunk_id, lower text, type): tagged: chunk_id, text, type,
    proper, confirmed; ruled: chunk_id, text, type, proper."""
    base = F.lit(0.60) + F.col("proper").cast("int") * 0.1 + F.col("confirmed").cast("int") * 0.1
    a = tagged.select("chunk_id", F.lower("text").alias("text"), "type", base.alias("ner"), F.lit(None).cast("double").alias("rule"))
    b = ruled.select("chunk_id", F.lower("text").alias("text"), "type", F.lit(None).cast("double").alias("ner"), F.when(F.col("proper"), 0.65).otherwise(0.60).alias("rule"))
    both = a.unionByName(b).groupBy("chunk_id", "text", "type").agg(F.max("ner").alias("ner"), F.max("rule").alias("rule"), F.count("rule").alias("rules"))
    score = F.when(F.col("ner").isNull(), F.col("rule")).when(F.col("rules") > 0, F.greatest("ner", F.least(F.lit(0.85), F.col("ner") + 0.05 * F.col("rules")))).otherwise(F.col("ner"))
    source = F.when(F.col("ner").isNull(), "rule").when(F.col("rules") > 0, "ner+rule").otherwise("ner")
    kept = both.withColumn("confidence", F.round(score, 4)).withColumn("source", source)
    return kept.where((F.col("confidence") >= threshold) & F.length("text").between(shortest, longest)).select("chunk_id", "text", "type", "confidence", "source")


def mention_nodes(mentions: DataFrame) -> DataFrame:
    """One node a name: first type, all chunks, the source of the most confident mention."""
    order = F.struct("chunk_id", "type")
    best = F.max_by(F.struct("confidence", "source"), F.struct("confidence", -F.col("chunk_id"), "type")).alias("best")
    out = mentions.groupBy("text").agg(F.min_by("type", order).alias("type"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_id"), best)
    return out.select(X.create_id(F.col("text")).alias("id"), F.col("text").alias("name"), "type", "chunk_id", "best.confidence", "best.source")


def prompt_rows(
    chunks: DataFrame, mentions: DataFrame, template: str = "Text fragment:\n%s\n\nEntities in chunk:\n%s", relations: DataFrame | None = None, references: DataFrame | None = None,
) -> DataFrame:
    """chunks: chunk_id, text; mentions: chunk_id, name. One model input a chunk.

    With ``relations`` (chunk_id, source, relation, target) and ``references`` (chunk_id, mention, name: what a
    mention stands for) their lines follow under headings of their own."""
    listed = lambda rows, value, name: rows.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set(value)), name[1]).alias(name[0]))
    out = chunks.join(listed(mentions, F.col("name"), ("names", ", ")), "chunk_id", "left")
    prompt = F.format_string(template, "text", F.coalesce("names", F.lit("")))
    more = (
        ("references", references, "Coreference:", ("mention", " -> ", "name")),
        ("relations", relations, "Relations in chunk:", ("source", " ", "relation", " ", "target")),
    )
    for title, rows, head, line in more:
        if rows is not None:
            said = F.concat(*[F.col(c) if c.strip() and c != " -> " else F.lit(c) for c in line])
            out = out.join(listed(rows, said, (title, "\n")), "chunk_id", "left")
            prompt = F.concat(prompt, F.lit(f"\n\n{head}\n"), F.coalesce(title, F.lit("")))
    return out.select("chunk_id", prompt.alias("prompt"))


def complete_entities(nodes: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing entities as nodes; an id in use gets the next suffix of its base id."""
    stem, tail = F.regexp_replace("id", r"_[0-9]+$", ""), F.regexp_extract("id", r"_([0-9]+)$", 1)
    used = nodes.select("graph_id", stem.alias("base_id"), F.coalesce(tail.try_cast("int"), F.lit(0)).alias("k")).groupBy("graph_id", "base_id").agg((F.max("k") + 1).alias("used"))
    return entity_nodes(missing, used)


def complete_relations(edges: DataFrame, nodes: DataFrame, missing: DataFrame) -> DataFrame:
    """missing: graph_id, pos, source, target, relation, back. Both directions of relations whose ends exist and whose forward id is new."""
    rows = missing.withColumn("id", F.concat_ws(" ", "source", "relation", "target"))
    for end in ("source", "target"):
        rows = rows.join(nodes.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_semi")
    rows = rows.join(edges.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "id").orderBy("pos"))).where("r = 1")
    way = lambda i, s, t, r: F.struct(i.alias("id"), F.col(s).alias("source"), F.col(t).alias("target"), F.col(r).alias("relation"))
    e = F.explode(F.array(way(F.col("id"), "source", "target", "relation"), way(F.concat_ws(" ", "target", "back", "source"), "target", "source", "back")))
    return rows.select("graph_id", e.alias("e")).select("graph_id", "e.*")
