"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chat, html_text, jaccard_join, langid, mixing, piece_codec, quality, secret_scan, token_align, token_counts, topk_join, turn_trie
from tessera.llm.common import Scratch, fold, table
from tessera.llm.sql import ORACLE_SQL as ORACLE_SQL

try:
    import public_tokenizers as vocabularies
except ImportError:  # the paths are parameters; only the queries below take the installed files
    vocabularies = None


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as work:
        return work.release(mixing.taken_by_document(*mixing.mix(table(spark, sf_dir, "documents"), work)))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold(5) != 0)
    found = langid.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join.topk_join(table(spark, sf_dir, "embeddings"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = piece_codec.encode_decode(docs, vocabularies.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    found = quality.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = chat.format_conversations(rows)
    return chat.digests(done)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits of its own: a word put in at a third, a run of characters
    taken out at a half, and its source's name put in place of a few characters near the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size = F.coalesce(F.length("text"), F.lit(0))
    put = lambda at, removed, added: F.struct(at.cast("int").alias("at"), removed.cast("int").alias("removed"), added.cast("string").alias("added"))
    edits = F.array(
        put(F.floor(size / 3), F.lit(0), F.concat(F.lit(" revised "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        put(F.floor(size / 2), F.pmod(F.xxhash64("doc_id"), F.lit(40)), F.lit("")),
        put(F.floor(size * 0.9), F.lit(5), F.concat(F.lit(" "), F.coalesce("source", F.lit("?")), F.lit(".\n"))),
    )
    done = token_counts.count_edits(docs.withColumn("edits", edits), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, keep=["doc_id"])
    return done.select("doc_id", "n_tokens", "n_tokens_edited", "n_pre_tokens", "n_re_encoded")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digests(secret_scan.scan(docs), ["doc_id"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as work:
        return token_align.align(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model"), work)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation takes the first turns of the one that starts its block of 20: none to three of them,
    in place of its own."""
    with Scratch(spark) as work:
        own = work.keep(turn_trie.conversations(table(spark, sf_dir, "conversations")), "conversations")
        heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
        n = F.crc32(F.col("conv_id").cast("string")) % 4
        joined = own.join(heads, own.conv_id - own.conv_id % 20 == heads.base, "left").withColumn("n", n.cast("int"))
        none = F.slice("turns", 1, 0)
        turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("n")), F.slice("turns", F.col("n") + 1, F.size("turns")))
        return turn_trie.prefix_trie(joined.select("conv_id", turns.alias("turns")), work)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_language, op3_topk, op4_pieces, op5_quality, op6_main_text, op7_chat, op8_ann, op9_jaccard, op10_token_counts, op11_secrets, op12_alignment, op13_prefix_trie, pipeline)}
