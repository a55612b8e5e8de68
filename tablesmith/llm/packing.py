"""Concatenate and cut: token streams of all documents laid end to end and cut into fixed windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablesmith.llm.common import cut, steps

#: Split pattern of byte-level BPE vocabularies of this family (a fixed value of the vocabulary file).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_encoder(vocabulary: str) -> tiktoken.Encoding:
    """An encoder with the ids of a byte-level BPE vocabulary file (text of its JSON).

    Rank order and id order are the same in these vocabularies, which is checked; then merging by id is merging by rank.
    """
    spec = json.loads(vocabulary)
    back, vocab = byte_chars(), spec["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(set(merged)) or spec["normalizer"] is not None or not spec["pre_tokenizer"]["use_regex"] \
            or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level BPE vocabulary in merge order")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokenize(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             end_id: int = 1) -> DataFrame:
    """Token ids of every whole text with ``end_id`` after it, and where they lie in their partition.

    Columns: ``part`` (partition), ``before`` (tokens before the document in that partition), ``k0``.. (the ``keep``
    columns), ``n`` and ``ids`` (little-endian unsigned 16- or 32-bit, by vocabulary size). A null text is empty. The
    vocabulary file is read on the driver and broadcast; its size does not grow with the data.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f.simpleString().replace(":", " ", 1) for f in slim.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(vocabulary.value)
        kind = np.uint16 if encoder.max_token_value < 1 << 16 and end_id < 1 << 16 else np.uint32
        part, before, end = TaskContext.get().partitionId(), 0, np.array([end_id], kind)
        for batch in batches:
            for piece in steps(batch, 0):
                ids = [np.concatenate([encoder.encode_to_numpy(t or "", allowed_special="all").astype(kind), end])
                       for t in piece.column(0).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), *piece.columns[1:], pa.array(n),
                     pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["part", "before", *piece.schema.names[1:], "n", "ids"])
                before = int(ends[-1])

    return slim.mapInArrow(run, ", ".join(["part int", "before long", *fields, "n long", "ids binary"]))


def pack(docs: DataFrame, vocabulary_path: str, window: int = 2048, text: str = "text",
         keep: tuple[str, ...] = ("doc_id",), end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of exactly ``window`` tokens (the last one may be shorter).

    First pass: every task tokenizes its texts and counts tokens; the counts per partition (one row each, which bounds
    the broadcast) become partition offsets by a prefix sum. Second pass: a document's global offset gives its windows,
    and a document that crosses a border is cut into one record per window. No row is shuffled.

    One row per piece: the ``keep`` columns, ``start`` (tokens of the document before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence), ``is_boundary`` (the
    document is cut at one end of the piece or both). Nulls: a null text is one piece that holds the end id only; a null
    key is carried through. Repeated rows are packed each. Columns that are not in ``keep`` are ignored, whatever
    their names. An empty table gives an empty result.
    """
    tokens = cut(tokenize(docs, vocabulary_path, text, keep, end_id), "tokens")
    keys = [f"k{i}" for i in range(len(keep))]
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("before")).alias("at"), "n", "ids", *keys)
    fields = [f.simpleString().replace(":", " ", 1) for f in placed.schema.fields[3:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 2):
                at = part.column(0).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                first, last = at // window, (at + n - 1) // window
                pieces = last - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[row]
                start = np.maximum(seq * window - at[row], 0)
                stop = np.minimum((seq + 1) * window - at[row], n[row])
                raw = part.column(2).to_pylist()
                wide = [np.frombuffer(b, np.uint16 if len(b) == 2 * k else np.uint32).astype("<u4") for b, k in zip(raw, n)]
                cuts = [wide[r][a:b].tobytes() for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(take) for c in part.columns[3:]], pa.array(start), pa.array(stop - start),
                     pa.array(cuts, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(at[row] + start - seq * window),
                     pa.array((start > 0) | (stop < n[row]))],
                    [*part.schema.names[3:], "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_boundary"])

    out = placed.mapInArrow(run, ", ".join([*fields, "start long", "length long", "ids binary", "doc_tokens long",
                                            "sequence_id long", "offset long", "is_boundary boolean"]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, keep)],
                      "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_boundary")
