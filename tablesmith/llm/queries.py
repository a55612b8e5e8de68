"""Registered queries of the operators: thin callables ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import (bpe, chat_format, html_style_tree, line_dedup, minhash_dedup, nn_descent, packing, quality_classifier,
                            quality_rules, secret_scan, sharding, token_align, whitening)
from tablesmith.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the adaptive verdict of every document."""
    return quality_rules.adaptive_filter(read(spark, sf_dir, "documents"))


@register
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, one row per piece."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "is_boundary")


#: A conversation whose texts are control strings of other templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@register
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 formatted, then read back from the formatted rows."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    turns = turns.union(extra).withColumn("parts", chat_format.text_parts(F.col("text")))
    return chat_format.conversation_digests(chat_format.format_turns(turns))


@register
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-end vocabulary."""
    coded = bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards that each have the sources' mixture."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.interleave_shards(docs, "source", "doc_id", 16, payload=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of the documents."""
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    kinds = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    base = secret_scan.join_spans(F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS)))
    return found.select("doc_id", *kinds, F.sha2(base, 256).alias("base_sha256"),
                        secret_scan.join_spans(F.col("spans")).alias("spans"))


ORACLES["op6_secret_scan"] = secret_scan.oracle()


@register
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 4-word shingles at 0.8."""
    found = minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@register
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    return quality_classifier.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register
def op1_html_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_style_tree.extract_main_text(read(spark, sf_dir, "pages"))


@register
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found neighbours of every row whose id is divisible by 100."""
    rows = read(spark, sf_dir, "embeddings")
    return nn_descent.nearest_neighbours(rows, rows.filter("vec_id % 100 = 0"))


@register
def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizations of every document aligned, with the corpus-wide support of its links."""
    aligned = token_align.align_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return token_align.link_support(aligned.withColumn("groups_sha256", digest)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    left = line_dedup.drop_frequent_lines(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = line_dedup.oracle()


@register
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the whitened principal components, one row per component."""
    white = whitening.whiten(read(spark, sf_dir, "embeddings"))
    cells = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return white.select("vec_id", "n", "deviation", "identity_error", cells).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
