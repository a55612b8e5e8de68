"""MinHash near-duplicates with sequential Bayesian verification and an exact check of the survivors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import connected_components, cut, steps, word_codes

#: Bands of ROWS minima each. A pair at the threshold of 0.8 misses all bands with probability
#: (1 - 0.8^6)^42 = 2.9e-6, one at 0.9 with 2e-14.
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
#: Signature positions that one verification step compares.
STEP = 36
#: A pair is pruned when the posterior probability of reaching the threshold falls below this.
MISS = 1e-6
SEED = 20240229
#: Rounds that test one centre per bucket before the remaining pairs of a bucket are compared in blocks.
STAR_ROUNDS = 2
#: Bits of a set's parity sketch, and members of a bucket in one block.
PARITY_BITS = 4096
BLOCK = 2048

_rng = np.random.default_rng(SEED)
MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts in a row, and how many each text has.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer words than ``size`` has its whole sequence as
    one shingle, one without words has none.
    """
    codes, words, counts = word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)
    flat = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    start = np.cumsum(counts) - counts
    acc = np.zeros(max(len(flat) - size + 1, 0), np.uint64)
    for k in range(size):
        acc = _mix(acc * ODD + flat[k:len(flat) - size + 1 + k])
    sets = []
    for s, n in zip(start.tolist(), counts.tolist()):
        if n >= size:
            sets.append(np.unique(acc[s:s + n - size + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for w in flat[s:s + n]:
                one = _mix(one * ODD + w)
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(x) for x in sets], np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash signatures (32-bit minima) of non-empty sets laid in a row."""
    begin = np.cumsum(sizes) - sizes
    x = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], begin)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different in every band."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        key = _mix(key * ODD + sig.reshape(len(sig), BANDS, ROWS)[:, :, r])
    return key.view(np.int64)


def parity_sketches(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set, the parity of its elements in each of ``PARITY_BITS`` hash cells.

    Common elements cancel in the exclusive or of two sketches, so its set bits are a lower bound of the number of
    elements that only one of the sets has.
    """
    cells, ends = (flat & np.uint64(PARITY_BITS - 1)).astype(np.int64), np.cumsum(sizes)
    return [np.packbits((np.bincount(cells[e - n:e], minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()
            for e, n in zip(ends.tolist(), sizes.tolist())]


def fewest_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each verification step, the least number of equal signature bytes with which a pair may go on.

    The posterior of a pair's similarity after m of n equal positions is Beta(m + 1, n - m + 1) under a uniform prior; a
    byte of a minimum agrees by chance once in 256, so the threshold is that of the byte's agreement. The pair is
    pruned when the posterior probability of at least the threshold is below ``miss``.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        total, m = 0.0, 0
        for i in range(n + 2):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(t) + (n + 1 - i) * math.log(1 - t))
            if total >= miss:
                m = i
                break
        out.append(m)
    return out


def _prints(flat: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128-bit fingerprint of every set; None for an empty one."""
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(flat[e - n:e].tobytes()) if n else None for e, n in zip(ends.tolist(), sizes.tolist())]


def _classes(docs: DataFrame, text: str, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their set's fingerprint and size, one row per distinct non-empty set with its band keys)."""
    slim = docs.select(F.col(text).alias("t"), F.col(key).alias("doc"), F.xxhash64(text).alias("h"))
    kind = dict(slim.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                flat, sizes = shingle_sets(part.column(0), size)
                some = sizes > 0
                keys = band_keys(signatures(flat, sizes[some])) if some.any() else np.zeros((0, BANDS), np.int64)
                offsets = np.r_[0, np.cumsum(some * BANDS)].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(_prints(flat, sizes), pa.binary()), pa.array(sizes), bands],
                                                 ["doc", "h", "fp", "n", "bands"])

    every = cut(slim.mapInArrow(run, f"doc {kind}, h long, fp binary, n long, bands array<long>"), "shingled")
    classes = (every.filter("fp is not null").groupBy("fp")
               .agg(F.min("doc").alias("doc"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    return every.select("doc", "h", "fp", "n"), cut(classes, "set-classes")


def _members(docs: DataFrame, wanted: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """For each wanted class the text of its smallest document (matched by the fingerprint) and what verification needs."""
    rows = docs.select(F.col(text).alias("t"), F.col(key).alias("doc")).filter(F.col("t").isNotNull())
    rows = rows.join(wanted, F.col("doc").eqNullSafe(F.col("d"))).select("t", "node", "fp", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                flat, sizes = shingle_sets(part.column(0), size)
                same = np.array([a == b for a, b in zip(_prints(flat, sizes), part.column(2).to_pylist())], bool)
                part, flat, sizes = part.filter(pa.array(same)), flat[np.repeat(same, sizes)], sizes[same]
                if part.num_rows:
                    sig = (signatures(flat, sizes) & np.uint32(255)).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1), part.column(0), part.column(3), pa.array(sizes), pa.array([x.tobytes() for x in sig], pa.binary()),
                         pa.array(parity_sketches(flat, sizes), pa.binary())], ["node", "t", "bands", "n", "sig", "par"])

    out = rows.mapInArrow(run, "node long, t string, bands array<long>, n long, sig binary, par binary")
    return cut(out.dropDuplicates(["node"]), "class-members")


def _survivors(n: list[np.ndarray], sig: list[np.ndarray], par: list[np.ndarray], percent: int, least: list[int]) -> np.ndarray:
    """Positions of the pairs that pass the size bound, the sequential signature comparison and the parity bound.

    The arrays hold both sides of the pairs row by row; a side with one row is compared with all rows of the other.
    """
    rows = max(len(n[0]), len(n[1]))
    pick = lambda x, i: x if len(x) < rows else x[i]
    alive = np.flatnonzero(np.broadcast_to(100 * np.minimum(*n) >= percent * np.maximum(*n), rows))
    same = np.zeros(rows, np.int64)
    for i, m in enumerate(least):
        cols = slice(i * STEP, (i + 1) * STEP)
        same[alive] += (pick(sig[0][:, cols], alive) == pick(sig[1][:, cols], alive)).sum(axis=1)
        alive = alive[same[alive] >= m]
    apart = np.bitwise_count(pick(par[0], alive) ^ pick(par[1], alive)).sum(axis=1, dtype=np.int64)
    return alive[apart * (100 + percent) <= (pick(n[0], alive) + pick(n[1], alive)) * (100 - percent)]


def _columns(batch: pa.RecordBatch, n: str, sig: str, par: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = lambda c, width: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width)
    return batch.column(n).to_numpy(zero_copy_only=False), raw(sig, HASHES), raw(par, PARITY_BITS // 8).view(np.uint64)


def _prune(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that survive the size bound and the sequential comparison of signature batches."""
    side = lambda s: members.select(F.col("node").alias(s), *[F.col(c).alias(c + s) for c in ("n", "sig", "par")])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    least = fewest_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _columns(batch, "na", "siga", "para"), _columns(batch, "nb", "sigb", "parb")
            yield batch.select(["a", "b"]).take(pa.array(_survivors(*[list(x) for x in zip(left, right)], percent, least)))

    return rows.mapInArrow(run, "a long, b long")


def _compare_buckets(state: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs among all members of a bucket that lie in different components.

    A bucket's members are dealt into blocks by hash, every pair of blocks is one unit of bounded size, and only survivors
    leave it. A pair that shares several buckets is compared in the first of them only.
    """
    size = state.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = state.join(size, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    rows = rows.select("band", "root", "node", "block", F.explode(spread).alias("u")).select("band", "root", "node", "block", "u.i", "u.j")
    rows = rows.join(members.select("node", "bands", "n", "sig", "par"), "node")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    least = fewest_matches(percent / 100)

    def compare(unit: pa.RecordBatch) -> tuple[list[int], list[int]]:
        n, sig, par = _columns(unit, "n", "sig", "par")
        node, root, block = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "block"))
        bands = unit.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        here = int(np.flatnonzero(bands[0] == unit.column("band")[0].as_py())[0])
        crossed = unit.column("i")[0] != unit.column("j")[0]
        found: tuple[list[int], list[int]] = ([], [])
        for x in range(len(node) - 1):
            other = np.flatnonzero(root[x + 1:] != root[x]) + x + 1
            if crossed:
                other = other[block[other] != block[x]]
            other = other[~(bands[other, :here] == bands[x, :here]).any(axis=1)]
            if len(other):
                left = [v[x:x + 1] for v in (n, sig, par)]
                kept = other[_survivors(*[list(v) for v in zip(left, (n[other], sig[other], par[other]))], percent, least)]
                found[0].extend([int(node[x])] * len(kept))
                found[1].extend(node[kept].tolist())
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            a, b = compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "i", "j")])
            starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1] if batch.num_rows else []
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                now = tuple(keys[:, s].tolist())
                if held and now != key:
                    yield from close()
                    held.clear()
                key = now
                held.append(batch.slice(s, e - s))
        if held:
            yield from close()

    return rows.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold: 100 * intersection >= percent * union."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("t").alias(f"t{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("ta", "tb", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in steps(batch, 0):
                for part in steps(half, 1):
                    left, right = pc.unique(part.column("ta")), pc.unique(part.column("tb"))
                    both = pa.concat_arrays([left, right])
                    flat, sizes = shingle_sets(both, size)
                    ends = np.cumsum(sizes)
                    sets = [flat[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
                    ia = pc.index_in(part.column("ta"), left).to_pylist()
                    ib = pc.index_in(part.column("tb"), right).to_pylist()
                    keep = []
                    for i, (x, y) in enumerate(zip(ia, ib)):
                        p, q = sets[x], sets[len(left) + y]
                        shared = len(np.intersect1d(p, q, assume_unique=True))
                        if 100 * shared >= percent * (len(p) + len(q) - shared):
                            keep.append(i)
                    yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 80,
                    fingerprints: bool = False) -> DataFrame:
    """Connected components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Documents with equal sets form one class first (grouped by a 128-bit fingerprint), so copies are never paired.
    MinHash bands make candidates among classes. In each bucket all members are tested against one centre; buckets
    whose members still lie in several components take further centres, and at last all members in different components are
    compared block by block, so no link is left out. Every candidate pair is verified step by step on signature batches
    (pruned at a posterior probability below ``MISS``), then by an exact lower bound of the sets' difference, and
    survivors are confirmed on the full sets of their texts. Bands miss a pair at
    the threshold with probability 2.9e-6.

    Returns one row per document: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable); with ``fingerprints`` also
    ``text_hash`` (xxhash64 of the text) and ``component`` (a number of the component's own, null without shingles), which
    tell rows of one key apart. Nulls: a null or
    wordless text has no shingles and is alone; a null key is never the smallest, unless no other is in the component.
    Rows that share key and text are one class. Other columns are ignored. An empty table gives an empty result.
    """
    every, classes = _classes(docs, text, key, size)
    banded = classes.select("node", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = cut(banded.join(centres, "band"), "buckets")

    # texts and sketches of the classes that share a bucket, once for all rounds
    wanted = cut(buckets.select("node").distinct().join(classes.select("node", "fp", "bands", F.col("doc").alias("d")), "node"), "wanted")
    members = _members(docs, wanted, text, key, size)

    pairs = buckets.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = cut(_confirm(cut(_prune(pairs, members, percent), "survivors"), members, percent, size), "links")
    roots = connected_components(links, "a", "b")
    for turn in range(STAR_ROUNDS + 1):
        state = buckets.select("node", "band").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        open_ = state.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                          F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("centre"),
                                          F.min_by("root", F.xxhash64("node", F.lit(turn))).alias("centre_root"))
        state = cut(state.join(open_.filter("low < high"), "band"), "open-buckets")
        if state.isEmpty():
            break
        if turn < STAR_ROUNDS:
            pairs = state.filter("root <> centre_root").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
            passed = _prune(pairs.distinct(), members, percent)
        else:
            passed = _compare_buckets(state.select("band", "node", "root"), members, percent)
        more = cut(_confirm(cut(passed, "survivors"), members, percent, size), "links")
        if more.isEmpty():
            continue
        links = links.union(more)
        roots = connected_components(links, "a", "b")
    named = classes.select("node", "fp", "doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named, "class-roots")
    least = named.groupBy("root").agg(F.min("doc").alias("least"))
    ids = cut(named.join(least, "root").select(F.col("fp").alias("f"), "least", F.col("root").alias("component")), "class-components")
    return (every.join(ids, F.col("fp") == F.col("f"), "left")
            .select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc"))
                    .otherwise(F.col("least")).alias("component_id"),
                    *([F.col("h").alias("text_hash"), "component"] if fingerprints else [])))
