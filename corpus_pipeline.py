"""The corpus pipeline: quality rules, quality classifier, near-duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and returns the columns of documents
(the last one returns pieces of packed sequences). :func:`run` writes each result as Parquet under the shared
checkpoint folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesmith.llm import minhash_dedup, packing, quality_classifier, quality_rules, secret_scan
from tablesmith.llm.common import cut, read

#: Words per shingle and least similarity in percent of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed ``d0``, ``d1``, ..., so that no name meets an operator's own."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the adaptive thresholds.

    A null, empty or wordless text fails the base test and goes; a null language or source is a group of its own; repeated
    rows share their verdict; extra columns, whatever their names, stay; an empty table stays empty.
    """
    plain, n = _numbered(docs)
    judged = quality_rules.adaptive_filter(plain, n["text"], n["lang"], n["source"], keep=tuple(n.values()))
    return judged.filter("kept").select(*[F.col(d).alias(c) for c, d in n.items()])


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    Every row is scored by its own text, null and empty ones as well, so repeated rows share their verdict; a document without
    a label, or with a null key, is only scored. Without any label all documents stay. Extra columns stay; an
    empty table stays empty.
    """
    plain, n = _numbered(docs)
    rest = tuple(d for c, d in n.items() if c != "doc_id")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias(n["doc_id"]), "quality")
    scored = quality_classifier.score_documents(plain, labels, n["text"], n["doc_id"], keep=rest)
    return scored.filter("predicted = 1").select(*[F.col(d).alias(c) for c, d in n.items()])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the smallest key, a null one last, and the smallest hash of its texts.

    Rows are told apart by key and text, so a key with several texts loses only those that repeat another one, and rows
    that repeat both go as well. A null or wordless text is near nothing; of equal ones under one key one stays. Extra
    columns stay (of the row that is kept); an empty table stays empty.
    """
    plain, n = _numbered(docs)
    doc, text = n["doc_id"], n["text"]
    found = minhash_dedup.near_duplicates(plain, text, doc, SHINGLE, PERCENT, fingerprints=True)
    found = cut(found.select(F.col(doc).alias("k"), "text_hash", "component"), "near-rows")
    first = (found.filter("component is not null").groupBy("component")
             .agg(F.min(F.struct(F.col("k").isNull(), "k", "text_hash")).alias("r")).select("r.k", "r.text_hash"))
    alone = found.filter("component is null").select("k", "text_hash").distinct()
    kept_rows = cut(first.union(alone), "near-kept")
    plain = plain.withColumn("h", F.xxhash64(text))
    kept = plain.join(kept_rows, F.col(doc).eqNullSafe(F.col("k")) & (F.col("h") == F.col("text_hash")), "left_semi")
    repeat = F.row_number().over(W.partitionBy(doc, "h").orderBy(doc))
    return kept.withColumn("r", repeat).filter("r = 1").select(*[F.col(d).alias(c) for c, d in n.items()])


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the text where it changed.

    A null text stays null, an empty one empty; null keys and repeated rows stay; extra columns stay; a text of any
    length is scanned whole; an empty table stays empty.
    """
    plain, n = _numbered(docs)
    clean = secret_scan.redact(plain.withColumn("before", F.col(n["text"])), n["text"], n["doc_id"])
    size = F.when(F.col("before").eqNullSafe(F.col(n["text"])), F.col(n["n_chars"])).otherwise(F.length(n["text"])).cast(docs.schema["n_chars"].dataType)
    return clean.select(*[(size if c == "n_chars" else F.col(d)).alias(c) for c, d in n.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null or empty text is one piece that holds the end id only; a null key is carried through; repeated rows are packed
    each; other columns are left out; an empty table gives no pieces.
    """
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "is_boundary")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: Sketch thresholds, the trained classifier and token ids are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents and return the packed pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
