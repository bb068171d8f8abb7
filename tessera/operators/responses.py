"""Model responses to typed rows. Input: graph_id, chunk_id, kind, raw; unreadable ones go to quarantine."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"```json(.*?)```", re.S)
#: A string literal, or a comment to drop.
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|#[^\n]*', re.S)
_TRAILER = re.compile(r'(":\s*"[^"]*")\s*\([^)]*\)')

NODE = "struct<name:string,type:string,base_description:string,base_attributes:map<string,string>>"
EDGE = "struct<node1:string,node2:string,relation:string,relation_from1to2:string,relation_from2to1:string,description:string,weight:string>"


def last_object(text: str) -> str | None:
    """The last balanced {...} at the top level."""
    found, depth, start = None, 0, 0
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                found = text[start : m.end()]
    return found


def without_comments(text: str) -> str:
    return _COMMENT.sub(lambda m: m[1] or "", text)


def readable(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def repair_text(raw: str | None) -> str:
    raw = raw or ""
    if m := _FENCE.search(raw):
        return without_comments(m[1].strip())
    whole = last_object(raw)
    if whole is not None and readable(whole):
        return whole
    start, end = raw.find("{"), raw.rfind("}")
    body = raw[start if start >= 0 else len(raw) : end + 1]
    return _TRAILER.sub(r"\1", without_comments(body))


def repair(responses: DataFrame) -> DataFrame:
    """Adds json: the raw text where it is JSON already, else the repaired one (null if there is no object in it)."""
    good = F.try_parse_json("raw").isNotNull() & F.ltrim("raw").startswith("{")
    clean = responses.where(good).withColumn("json", F.col("raw"))
    rest = responses.where(~F.coalesce(good, F.lit(False)))
    names = [f.name for f in rest.schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fixed = [repair_text(t) for t in pdf["raw"]]
            yield pdf.assign(json=[t if readable(t) else None for t in fixed])[[*names, "json"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", json string"
    return clean.unionByName(rest.mapInPandas(run, schema))


def quarantine(repaired: DataFrame) -> DataFrame:
    return repaired.where("json is null").withColumn("reason", F.lit("no readable object")).drop("json")


def as_list(value: Column, item: str) -> Column:
    """value: JSON text of a list, of one object, or null; items that are no objects are dropped."""
    many, one = F.from_json(value, f"array<string>"), F.from_json(value, item)
    items = F.transform(F.filter(many, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, item))
    return F.when(value.isNull(), F.array().cast(f"array<{item}>")).when(F.ltrim(value).startswith("["), items).when(F.ltrim(value).startswith("{"), F.array(one)).otherwise(F.array().cast(f"array<{item}>"))


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def number_or(value: Column, default: float = 1.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def extraction(repaired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of extraction responses, with chunk_id and pos."""
    rows = repaired.where("json is not null").select("graph_id", "chunk_id", F.get_json_object("json", "$.nodes").alias("n"), F.get_json_object("json", "$.edges").alias("e"))
    nodes = rows.select("graph_id", "chunk_id", F.posexplode(as_list(F.col("n"), NODE)).alias("pos", "x"))
    nodes = nodes.select("graph_id", "chunk_id", "pos", text_or(F.col("x.name"), "").alias("name"), text_or(F.col("x.type"), "item").alias("type"), text_or(F.col("x.base_description"), "").alias("description"), F.coalesce("x.base_attributes", F.create_map().cast("map<string,string>")).alias("attributes"))
    edges = rows.select("graph_id", "chunk_id", F.posexplode(as_list(F.col("e"), EDGE)).alias("pos", "x"))
    edges = edges.select("graph_id", "chunk_id", "pos", "x.node1", "x.node2", F.coalesce("x.relation_from1to2", "x.relation", F.lit("related_to")).alias("relation_from1to2"), text_or(F.col("x.relation_from2to1"), "related_to").alias("relation_from2to1"), text_or(F.col("x.description"), "").alias("description"), number_or(F.col("x.weight")).alias("weight"))
    return nodes, edges


def merged(repaired: DataFrame) -> DataFrame:
    j = lambda k: text_or(F.get_json_object("json", f"$.{k}"), "")
    return repaired.where("json is not null").select("graph_id", "chunk_id", j("name").alias("name"), j("base_description").alias("base_description"), F.coalesce(F.from_json(F.get_json_object("json", "$.base_attributes"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("base_attributes"))


def completion(repaired: DataFrame) -> tuple[DataFrame, DataFrame]:
    pick = lambda a, b: F.coalesce(F.get_json_object("json", f"$.{a}"), F.get_json_object("json", f"$.{b}"))
    rows = repaired.where("json is not null")
    e = rows.select("graph_id", "chunk_id", F.posexplode(as_list(pick("missing_entities", "entities"), NODE)).alias("pos", "x"))
    r = rows.select("graph_id", "chunk_id", F.posexplode(as_list(pick("missing_relations", "relations"), EDGE)).alias("pos", "x"))
    e = e.select("graph_id", "chunk_id", "pos", text_or(F.col("x.name"), "").alias("name"), text_or(F.col("x.type"), "unknown").alias("type"), text_or(F.col("x.base_description"), "").alias("description"))
    r = r.select("graph_id", "chunk_id", "pos", text_or(F.col("x.node1"), "").alias("node1"), text_or(F.col("x.node2"), "").alias("node2"), F.coalesce("x.relation_from1to2", "x.relation", F.lit("related_to")).alias("relation_from1to2"), text_or(F.col("x.relation_from2to1"), "related_to").alias("relation_from2to1"), number_or(F.col("x.weight")).alias("weight"))
    return e, r


_IMPACT = "struct<event_name:string,affected_nodes:string,affected_edges:string>"
_HIT = "struct<id:string,name:string,new_current_description:string,new_description:string,description:string,time_start_event:string,time_end_event:string>"


def impacts(repaired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node impacts, edge impacts): graph_id, event_name, id, description, start, end."""
    events = F.coalesce(F.get_json_object("json", "$.events_with_impact"), F.get_json_object("json", "$.events"))
    rows = repaired.where("json is not null").select("graph_id", "chunk_id", F.posexplode(as_list(events, _IMPACT)).alias("event_pos", "v"))

    def part(field: str, description: str) -> DataFrame:
        x = rows.select("graph_id", "chunk_id", "event_pos", text_or(F.col("v.event_name"), "").alias("event_name"), F.posexplode(as_list(F.col(f"v.{field}"), _HIT)).alias("pos", "x"))
        return x.select("graph_id", "chunk_id", "event_pos", "pos", "event_name", text_or(F.col("x.id"), "").alias("id"), F.coalesce(f"x.{description}", "x.description", F.lit("")).alias("description"), F.col("x.time_start_event").alias("start"), F.col("x.time_end_event").alias("end"))

    return part("affected_nodes", "new_current_description"), part("affected_edges", "new_description")


def validate(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused with a reason)."""
    from tessera.functions.text import ENTITY_TYPES

    reason = F.when(F.trim("name") == "", "no name").when(~F.col("type").isin(ENTITY_TYPES), "unknown type")
    rows = entities.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def time_bounds(repaired: DataFrame) -> DataFrame:
    j = lambda k: F.get_json_object("json", f"$.{k}")
    return repaired.select("graph_id", "chunk_id", j("lower_event").alias("lower_name"), j("upper_event").alias("upper_name"))


def topic(repaired: DataFrame) -> DataFrame:
    j = lambda k: F.get_json_object("json", f"$.{k}")
    return repaired.select("graph_id", "chunk_id", F.coalesce(j("is_new_topic").try_cast("boolean"), F.lit(False)).alias("is_new_topic"), j("topic_summary").alias("summary"))
