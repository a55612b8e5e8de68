"""Cross-tokenizer alignment: two tokenizations of each text are merged in lockstep over all documents of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import cut, steps
from tablesmith.llm.packing import byte_level_encoder

#: Bytes of text per step of a task, and tokens of A after which a long document gets a further lane at its next common end.
TEXT_STEP, LANE = 2 << 20, 1024
#: A pair with at least 1 / HEAVY of all links is heavy: there are at most HEAVY such pairs, which bounds their broadcast.
HEAVY = 1 << 17
#: The bits of a pair key that hold the B id.
SHIFT = np.uint64(32)


class Tokenizers:
    """Both encoders with the bytes of their tokens: A is a byte-level vocabulary, B a piece model with byte fallback."""

    def __init__(self, a_vocabulary: str, b_model: bytes):
        self.a = byte_level_encoder(a_vocabulary)
        self.a_bytes = pa.array([self._a_token(i) for i in range(self.a.max_token_value + 1)], pa.large_binary())
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = pa.array([self._b_token(i) for i in range(self.b.get_piece_size())], pa.large_binary())
        # each id in decimal with its separator inside a group, then with the one after the group's last token
        self.decimal = pa.array([f"{i}{s}" for table, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
                                 for s in marks for i in range(len(table))], pa.large_string())

    def _a_token(self, i: int) -> bytes:
        try:
            return self.a.decode_single_token_bytes(i)
        except KeyError:
            return b""

    def _b_token(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A over space + text and of B over text (which adds the space); control strings are plain text."""
        a = [self.a.encode_to_numpy(" " + t, allowed_special=set(), disallowed_special=()).astype(np.int64) if t else np.zeros(0, np.int64)
             for t in texts]
        b = [np.array(ids, np.int64) if t else np.zeros(0, np.int64) for t, ids in zip(texts, self.b.encode(texts, num_threads=1))]
        return a, b


def _spell(ids: np.ndarray, table: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The joined bytes of all tokens and the offset at which each one ends."""
    spelled = table.take(pa.array(ids))
    ends = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset:spelled.offset + len(ids) + 1]
    return memoryview(spelled.buffers()[2] or b"").cast("B"), ends[1:].astype(np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def tokenize_both(texts: list[str], tok: Tokenizers) -> tuple:
    """(ids, sizes per text, end offsets) of A, the same of B; a text that either does not spell exactly has no tokens."""
    a, b = tok.encode(texts)
    raw = [(" " + t).encode() if t else b"" for t in texts]
    for ids, table in ((a, tok.a_bytes), (b, tok.b_bytes)):
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        spelled, ends = _spell(flat, table)
        bound = np.concatenate([[0], ends])[_starts(sizes)]
        for i, want in enumerate(raw):
            if spelled[bound[i]:bound[i + 1]] != want:
                a[i] = b[i] = np.zeros(0, np.int64)
                raw[i] = b""
    out = []
    for ids, table in ((a, tok.a_bytes), (b, tok.b_bytes)):
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        out += [flat, np.array([len(x) for x in ids], np.int64), _spell(flat, table)[1]]
    return tuple(out)


def merge_lockstep(a_sizes: np.ndarray, a_ends: np.ndarray, b_sizes: np.ndarray, b_ends: np.ndarray,
                   lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A position, B position, is a cut) of every link, in document order; positions count through the whole batch.

    The state holds one A and one B pointer for every lane. Each step emits the link of the two pointers' tokens, emits a
    cut where both end at the same byte, and advances the pointer whose token ends first (both at a cut). Lanes that
    reached their end leave the state. A document starts as one lane; a long one gets a lane more at the first common end
    after every ``lane`` tokens of A, so that a batch takes about as many steps as a lane has tokens and not
    its longest document. Both sides of a document spell the same bytes, so ends count through the batch.
    """
    a_first, b_first = _starts(a_sizes), _starts(b_sizes)
    place = np.searchsorted(b_ends, a_ends)
    common = b_ends[np.minimum(place, max(len(b_ends) - 1, 0))] == a_ends if len(b_ends) else np.zeros(0, bool)
    # the first common end at or after each border; ends of documents are common ends, so lanes never cross documents
    shared = np.flatnonzero(common)
    borders = np.concatenate([np.arange(s + lane - 1, e, lane) for s, e in zip(a_first[:-1], a_first[1:])] or [np.zeros(0, np.int64)])
    chosen = shared[np.minimum(np.searchsorted(shared, borders), max(len(shared) - 1, 0))] if len(shared) else shared
    last = np.unique(np.concatenate([chosen, a_first[1:][a_sizes > 0] - 1])).astype(np.int64)
    a_stop, b_stop = last + 1, place[last] + 1
    pa_, pb = np.concatenate([[0], a_stop[:-1]]).astype(np.int64), np.concatenate([[0], b_stop[:-1]]).astype(np.int64)
    if not len(last):
        pa_, pb = pa_[:0], pb[:0]
    out = pa_ + pb  # a lane has fewer links than tokens, so its links fit behind this place
    links_a, links_b = np.full(len(a_ends) + len(b_ends), -1, np.int64), np.zeros(len(a_ends) + len(b_ends), np.int64)
    cuts = np.zeros(len(links_a), bool)
    while len(pa_):
        end_a, end_b = a_ends[pa_], b_ends[pb]
        links_a[out], links_b[out], cuts[out] = pa_, pb, end_a == end_b
        pa_ = pa_ + (end_a <= end_b)
        pb = pb + (end_b <= end_a)
        out += 1
        alive = pa_ < a_stop
        if not alive.all():
            pa_, pb, out, a_stop = pa_[alive], pb[alive], out[alive], a_stop[alive]
    real = links_a >= 0
    return links_a[real], links_b[real], cuts[real]


def _planes(values: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit numbers, all low bytes first (which compresses better)."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.uint64)


def pack_pairs(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """One document's sorted pair keys and how many links each has."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return _planes(np.concatenate([gaps & np.uint64(0xFFFFFFFF), gaps >> SHIFT, counts.astype(np.uint64)]))


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, counts = _from_planes(raw).reshape(3, -1)
    return np.cumsum(low | (high << SHIFT), dtype=np.uint64), counts.astype(np.int64)


def _doc_pairs(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place per document, keys, counts) of the distinct pairs of each document."""
    distinct, code = np.unique(keys, return_inverse=True)
    both, counts = np.unique(doc * max(len(distinct), 1) + code, return_counts=True)
    owner = both // max(len(distinct), 1)
    return np.searchsorted(owner, np.arange(n + 1)), distinct[both % max(len(distinct), 1)] if len(distinct) else keys, counts


def group_strings(tok: Tokenizers, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: np.ndarray,
                  n_b: np.ndarray) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` per document; ``cut_a`` and ``cut_b`` count the batch's tokens up to each cut."""
    at_a = np.arange(len(a)) + np.concatenate([[0], cut_b])[np.searchsorted(cut_a, np.arange(len(a)), "right")]
    at_b = np.arange(len(b)) + cut_a[np.searchsorted(cut_b, np.arange(len(b)), "right")]
    wide_a, wide_b = len(tok.a_bytes), len(tok.b_bytes)
    pick = np.zeros(len(a) + len(b), np.int64)
    pick[at_a], pick[at_b] = a, b + 2 * wide_a
    pick[at_a[cut_a - 1]] += wide_a
    pick[at_b[cut_b - 1]] += wide_b
    text = tok.decimal.take(pa.array(pick))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[:len(pick) + 1]
    raw = memoryview(text.buffers()[2] or b"").cast("B")
    bounds = offsets[_starts(n_a + n_b)].tolist()
    return pa.array([bytes(raw[s:max(e - 1, s)]).decode() for s, e in zip(bounds, bounds[1:])], pa.string())


def align_tokens(docs: DataFrame, a_vocabulary: str, b_model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 links: bool = False) -> DataFrame:
    """Both tokenizations of every text and how their tokens lie over each other.

    One row per document: the ``keep`` columns; ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (pairs of tokens that
    share a byte); ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids between the ends that both share; ``pairs``: the distinct
    linked id pairs with their numbers of links (:func:`unpack_pairs`); with ``links`` also ``links_a`` and ``links_b``, the
    token positions of every link. A reads a space and the text, B the text (it adds the space); strings of special tokens
    are plain text.

    A null or empty text, or one that either vocabulary does not spell byte by byte, has no tokens: zeros, empty
    strings. A null key is carried through, repeated rows are aligned each, columns that are not in ``keep`` are ignored
    whatever their names, an empty table gives an empty result. The two files are read on the driver and broadcast.
    """
    sc = docs.sparkSession.sparkContext
    with open(a_vocabulary, encoding="utf-8") as f, open(b_model, "rb") as g:
        files = sc.broadcast((f.read(), g.read()))
    slim = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f.simpleString().replace(":", " ", 1) for f in slim.schema.fields[1:]]
    names = [*slim.columns[1:], "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", *(["links_a", "links_b"] if links else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers(*files.value)
        for batch in batches:
            for part in steps(batch, 0, TEXT_STEP):
                texts = [t or "" for t in part.column(0).to_pylist()]
                a, n_a, a_ends, b, n_b, b_ends = tokenize_both(texts, tok)
                at_a, at_b, cuts = merge_lockstep(n_a, a_ends, n_b, b_ends)
                first = _starts(n_a)
                doc = np.searchsorted(first, at_a, "right") - 1
                n = len(texts)
                bounds, keys, counts = _doc_pairs((a[at_a].astype(np.uint64) << SHIFT) | b[at_b].astype(np.uint64), doc, n)
                blobs = [pack_pairs(keys[s:e], counts[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                groups = group_strings(tok, a, b, at_a[cuts] + 1, at_b[cuts] + 1, n_a, n_b)
                columns = [pa.array(n_a), pa.array(n_b), pa.array(np.bincount(doc[cuts], minlength=n).astype(np.int64)),
                           pa.array(np.bincount(doc, minlength=n).astype(np.int64)), groups, pa.array(blobs, pa.binary())]
                if links:
                    stops = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(stops), pa.array(at - _starts(size)[doc]))
                                for at, size in ((at_a, n_a), (at_b, n_b))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names)

    more = ["links_a array<long>", "links_b array<long>"] if links else []
    out = slim.mapInArrow(run, ", ".join([*fields, "n_a long", "n_b long", "n_groups long", "n_links long", "groups string", "pairs binary", *more]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep):])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of every id pair of the corpus: ``key`` (A id in the upper, B id in the lower 32 bits), ``links`` and ``best``
    (no other A id has more links with the same B id). Written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0, TEXT_STEP):
                found = [unpack_pairs(raw) for raw in part.column(0).to_pylist()]
                keys, code = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                if len(keys):
                    sums = np.bincount(code, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], ["key", "links"])

    counts = aligned.select("pairs").mapInArrow(run, "key long, links long").groupBy("key").agg(F.sum("links").alias("links"))
    counts = cut(counts.withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))), "pair-counts")
    most = counts.groupBy(F.col("b").alias("mb")).agg(F.max("links").alias("most"))
    return cut(counts.join(most, F.col("b") == F.col("mb")).select("key", "links", (F.col("links") == F.col("most")).alias("best")), "pairs")


def link_support(aligned: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of :func:`align_tokens` with ``n_best`` (links whose pair is the most frequent one of its B id, ties included)
    and ``count_sum`` (sum over the links of their pairs' links in the corpus) in place of ``groups`` and ``pairs``.

    A pair with at least 1 / ``heavy`` of all links is looked up in a broadcast table, which holds ``heavy`` rows at most
    whatever the corpus; only the other pairs of a document are shuffled to meet their counts, and none of them is hot.
    """
    spark = aligned.sparkSession
    stored = cut(aligned.drop("groups").withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = pair_counts(stored)
    total = pairs.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
    is_heavy = F.col("links") * heavy >= total
    top = pairs.filter(is_heavy).orderBy("key").toArrow()
    table = spark.sparkContext.broadcast(tuple(top.column(i).to_numpy() for i in range(3)))

    def split(raw: list[bytes]):
        found = [unpack_pairs(r) for r in raw]
        owner = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        keys = np.concatenate([k for k, _ in found]).astype(np.int64)
        place = np.minimum(np.searchsorted(table.value[0], keys), max(len(table.value[0]) - 1, 0))
        hit = table.value[0][place] == keys if len(table.value[0]) else np.zeros(len(keys), bool)
        return owner, keys, np.concatenate([c for _, c in found]), place, hit

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1, TEXT_STEP):
                owner, keys, counts, place, hit = split(part.column(1).to_pylist())
                owner, counts, place, n = owner[hit], counts[hit], place[hit], part.num_rows
                sums = np.zeros((2, n), np.int64)
                if len(place):
                    np.add.at(sums[0], owner, counts * table.value[2][place])
                    np.add.at(sums[1], owner, counts * table.value[1][place])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[0]), pa.array(sums[1])], ["row", "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1, TEXT_STEP):
                owner, keys, counts, _, hit = split(part.column(1).to_pylist())
                rows = part.column(0).to_numpy()[owner[~hit]]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys[~hit]), pa.array(counts[~hit])], ["row", "key", "k"])

    blobs = stored.select("row", "pairs")
    first = blobs.mapInArrow(known, "row long, n_best long, count_sum long")
    met = blobs.mapInArrow(rest, "row long, key long, k long").join(pairs.filter(~is_heavy), "key")
    second = met.select("row", F.when(F.col("best"), F.col("k")).otherwise(0).alias("n_best"), (F.col("k") * F.col("links")).alias("count_sum"))
    sums = (first.unionByName(second).groupBy(F.col("row").alias("r"))
            .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    plain = [c for c in stored.columns if c not in ("row", "pairs")]
    return stored.drop("pairs").join(sums, F.col("row") == F.col("r")).select(*plain, "n_best", "count_sum")
