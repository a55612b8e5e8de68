"""Chat formatting over typed content parts: one formatted row per turn, with attachments and loss spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A part of a turn. ``uri`` and the sizes belong to attachments; missing sizes count as 0.
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Marks of the template. Every mark is ``<|name|>``; texts never hold ``<|`` after escaping.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 14, 25, 256


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|``, after any that are there; undone by :func:`unescape`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A turn's content as one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _visit(part: Column) -> Column:
    """What one part becomes: its piece of the formatted turn, and how many tokens a placeholder expands to."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    tokens = (F.when(kind == "image", patches)
              .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
              .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS).otherwise(F.lit(0)))
    placed = kind.isin("image", "audio", "document")
    piece = F.when(placed, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
    return F.struct(placed.alias("placed"), kind.alias("kind"), piece.alias("piece"), part["uri"].alias("uri"),
                    tokens.cast("long").alias("n_tokens"))


def format_turns(turns: DataFrame, parts: str = "parts", conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", learn: str = "assistant") -> DataFrame:
    """Format every turn: ``<|turn|>role<|says|>content<|end|>``; a conversation is its rows' ``formatted`` in turn order.

    A visitor maps the typed parts in order: text is escaped, and an image, audio or document becomes a placeholder. An
    unknown kind is treated as text. Returns ``conv``, ``turn``, ``formatted``,
    ``attachments`` (array of ordinal, kind, uri, expanded token count, position of the placeholder in the row) and
    ``loss`` (spans [start, end) in code points of the row's text pieces that are learned, those of role ``learn``).

    Nulls: role and text count as empty, parts as none, a null conversation or turn is kept as it is. Repeated rows stay
    apart. Other columns are ignored. One pass, no shuffle.
    """
    seen = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), _visit)
    head = F.concat(F.lit(TURN), escape(F.coalesce(F.col(role), F.lit(""))), F.lit(SAYS))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                        (F.coalesce(F.col(role), F.lit("")) == learn).alias("__learn"), head.alias("__head"), seen.alias("__seen"))
    spot = F.struct(F.length("__head").cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("all"))
    spans = F.aggregate("__seen", spot, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"])).alias("at"),
        F.concat(acc["all"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["piece"])).alias("end")))).alias("all")),
        lambda acc: acc["all"])
    rows = rows.withColumn("__spans", spans).withColumn("__both", F.arrays_zip("__seen", "__spans"))
    attached = F.transform(F.filter("__both", lambda x: x["__seen"]["placed"]), lambda x, i: F.struct(
        i.alias("ordinal"), x["__seen"]["kind"].alias("kind"), x["__seen"]["uri"].alias("uri"),
        x["__seen"]["n_tokens"].alias("n_tokens"), x["__spans"]["start"].alias("at")))
    loss = F.transform(F.filter("__both", lambda x: ~x["__seen"]["placed"] & F.col("__learn")), lambda x: x["__spans"])
    body = F.array_join(F.transform("__seen", lambda x: x["piece"]), "")
    return rows.select("conv_id", "turn", F.concat("__head", body, F.lit(END)).alias("formatted"),
                       attached.alias("attachments"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles, texts and learned texts parsed from formatted rows (placeholders left out of the text)."""
    inner = F.expr(f"substring(formatted, {len(TURN) + 1}, length(formatted) - {len(TURN) + len(END)})")
    at = F.expr(f"instr(__inner, '{SAYS}')")
    body = F.expr(f"substring(__inner, __at + {len(SAYS)})")
    learned = F.array_join(F.transform("loss", lambda s: F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")
    return (formatted.withColumn("__inner", inner).withColumn("__at", at)
            .select("conv_id", "turn", unescape(F.expr("substring(__inner, 1, __at - 1)")).alias("role"),
                    unescape(F.regexp_replace(body, r"<\|(image|audio|document)\|>", "")).alias("text"),
                    unescape(learned).alias("learned"), (F.size("loss") > 0).alias("is_learned"),
                    F.length("formatted").cast("long").alias("chars")))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted rows: turn count, digest of roles and texts, loss characters and digest.

    Rows are sorted by conversation and turn (ties by role and text) and hashed as a stream, so a conversation of any
    length needs the memory of one batch.
    """
    rows = read_back(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done: list[list] = []
        conv, open_, key_type = None, None, None

        def out() -> pa.RecordBatch:
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(list(c), key_type if i == 0 else None) for i, c in enumerate(cols)], names)

        def close() -> None:
            n, turns, loss_chars, loss, chars = open_
            done.append([conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for c, role, text, learned, is_learned, chars in zip(
                    *[batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "learned", "is_learned", "chars")]):
                if open_ is None or c != conv:
                    if open_ is not None:
                        close()
                    conv, open_ = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                open_[0] += 1
                open_[1].update(f"{role}\n{text}\n".encode())
                if is_learned:
                    open_[2] += len(learned)
                    open_[3].update(learned.encode())
                open_[4] += chars
            if done:
                yield out()
                done.clear()
        if open_ is not None:
            close()
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")
