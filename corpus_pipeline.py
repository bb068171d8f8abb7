"""A corpus pipeline: every stage reads what its predecessor kept, decides, and hands documents on.

Stages take whole tables of documents: doc_id, text, lang, source, n_chars. Empty tables go
through all of them; nulls, repeated rows and very long texts are treated as each stage says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, langid, mixing, piece_codec, quality
from tessera.llm.common import Scratch, discarding_results, fold, table
from tessera.llm.queries import vocabularies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null and empty texts, texts without letters, scores under the
    calibrated floor. Other nulls do not matter; repeated rows are judged alike. Without anything to learn
    from, everything is rejected."""
    model = langid.fit(docs, fold(5) != 0)
    return langid.predict(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.5 go. Null and empty texts have a score too; null
    ids have no labels and are scored all the same; without labels every document stays."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return quality.predict(docs.select(*COLUMNS), model).where(F.col("score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with its least id, and of several rows of that id the
    least by a hash of the row. Rows with a null id belong to no component, and documents without words link
    with nothing: both stay."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text")).where("component_id = doc_id").select("doc_id").distinct()
    own = docs.select(*COLUMNS)
    order = [F.xxhash64(*COLUMNS), *COLUMNS[1:]]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    kept = own.join(found, "doc_id", "left_semi").withColumn("__first", first).where("__first = 1").select(*COLUMNS)
    return kept.unionByName(own.where("doc_id is null"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself, shard by shard and in the shards' order: a row for every drawn run of a document. Equal
    rows are drawn each for itself; null texts and texts without words are in no draw; null sources are one."""
    own = docs.select(*COLUMNS)
    with Scratch(spark) as work:
        _, draws, _ = mixing.mix(own, work)
        return mixing.mixed_texts(own, work.release(draws)).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back; a null text is empty."""
    done = piece_codec.encode_decode(docs.select(*COLUMNS), vocabularies.path("piece_bpe_32k.model"), keep=["doc_id", "source"], round_trip=True)
    return done.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("pieces", pieces)]

#: Trained classifiers and the library's segmentation are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's documents are written, and those of the stage before deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    with Scratch(spark) as work:
        for name, stage in STAGES:
            with discarding_results(spark):
                docs = work.keep(stage(spark, docs, sf_dir), name)
            if before is not None:
                work.drop(before)
            before = docs
        return work.release(docs)
