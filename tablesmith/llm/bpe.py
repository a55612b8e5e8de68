"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tablesmith.llm.common import steps
from tablesmith.llm.packing import byte_chars

NONE = np.int64(1) << 40
#: Distinct words whose ids a task remembers before it starts anew.
CACHE_WORDS = 400_000


class WordBPE:
    """Encoder and decoder for a word-end BPE vocabulary file (text of its JSON).

    Words are split by the file's pattern after NFC and lower case. Symbols of many distinct words lie in one flat
    array; in each round every word merges its lowest-ranked adjacent pair, found by binary search over the sorted
    pair keys. All its occurrences merge at once where that is the same as one by one (no pair with the merged symbol
    ranks lower), else only the leftmost one.
    """

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if spec["decoder"] is not None or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("not a word-end BPE vocabulary")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.fold = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.cut = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", True)
        names = vocab | self.special
        self.names = pa.array([""] * (max(names.values()) + 1))
        table = self.names.to_pylist()
        for token, i in names.items():
            table[i] = token
        self.names = pa.array(table)
        self.size = np.int64(len(table))
        chars = byte_chars()
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in chars.items():
            self.inner[b], self.final[b] = vocab[c], vocab[c + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        lowest = np.full(int(self.size), NONE)
        rank = np.arange(len(pairs), dtype=np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.at_once = lowest[made] > rank
        self.cache: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.cache.clear()
        self.cache.update({t: i for i, t in enumerate(self.special)})
        self.store = np.array(list(self.special.values()), np.int64)
        self.start = np.arange(len(self.special), dtype=np.int64)
        self.length = np.ones(len(self.special), np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.ranks[spot], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words in a row, and how many each word has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol, owner = self.inner[flat], np.repeat(np.arange(len(raw)), sizes)
        last = np.cumsum(sizes) - 1
        symbol[last] = self.final[flat[last]]
        out_symbol, out_owner = [], []

        def ranked(s: np.ndarray, o: np.ndarray) -> np.ndarray:
            rank = np.full(len(s), NONE)
            inside = np.flatnonzero(o[1:] == o[:-1])
            rank[inside] = self._rank(s[inside], s[inside + 1])
            return rank

        rank = ranked(symbol, owner)
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[begin, len(owner)])
            best = np.minimum.reduceat(rank, begin)
            live = best < NONE
            if not live.all():  # finished words leave the arrays
                gone = np.repeat(~live, sizes)
                out_symbol.append(symbol[gone])
                out_owner.append(owner[gone])
                symbol, owner, rank = symbol[~gone], owner[~gone], rank[~gone]
                best, sizes = best[live], sizes[live]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # overlapping pairs (runs of one symbol) merge from the left; pairs that are not at_once merge the leftmost
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            first = np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]
            hit = hit[((np.arange(len(hit)) - run) % 2 == 0) & (self.at_once[rank[hit]] | first)]
            symbol[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            at = moved[hit]
            redo = np.unique(np.r_[at, at[at > 0] - 1])
            redo = redo[redo < len(symbol)]
            rank[redo] = NONE
            redo = redo[redo + 1 < len(symbol)]
            redo = redo[owner[redo] == owner[redo + 1]]
            rank[redo] = self._rank(symbol[redo], symbol[redo + 1])
        ids = np.concatenate(out_symbol) if out_symbol else np.zeros(0, np.int64)
        whose = np.concatenate(out_owner) if out_owner else np.zeros(0, np.int64)
        order = np.argsort(whose, kind="stable")
        return ids[order], np.bincount(whose, minlength=len(raw)).astype(np.int64)

    def split(self, text: str) -> list[str]:
        """Special strings and words of a text, in order."""
        if "<|" in text:
            found = []
            for i, piece in enumerate(self.split_special.split(text)):
                found += [piece] if i % 2 else self._split(piece)
            return found
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # libraries differ on letters that a newer Unicode assigns: the vocabulary's own library decides
            return [w for w, _ in self.cut.pre_tokenize_str(self.fold.normalize_str(text))]
        # lower case goes letter by letter, so a final sigma is an ordinary one
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        parts = [self.split(t) for t in texts]
        flat = [w for p in parts for w in p]
        if len(self.cache) > CACHE_WORDS:
            self._forget()
        new = list(set(flat) - self.cache.keys())
        if new:
            ids, sizes = self.encode_words(new)
            known = len(self.length)
            self.cache.update(zip(new, range(known, known + len(new))))
            self.start = np.r_[self.start, len(self.store) + np.cumsum(sizes) - sizes]
            self.length, self.store = np.r_[self.length, sizes], np.r_[self.store, ids]
        codes = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        sizes = self.length[codes]
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[codes] - (ends - sizes), sizes)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        counts = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        return self.store[spots], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of id runs, special ids included: the vocabulary's strings joined by a space (it names no decoder)."""
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(pa.array(ids))), " ")


def encode_documents(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every whole text: ``keep`` columns, ``ids`` (little-endian unsigned 32-bit), ``decoded``.

    A null or empty text has no ids. Other columns are ignored, and repeated rows are encoded each. One pass without
    a shuffle; the vocabulary file is read on the driver and broadcast (its size does not grow with the data).
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f.simpleString().replace(":", " ", 1) for f in slim.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(vocabulary.value)
        for batch in batches:
            for part in steps(batch, 0):
                ids, counts = bpe.encode([t or "" for t in part.column(0).to_pylist()])
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
                cuts = [raw[4 * (e - n):4 * e] for e, n in zip(ends, counts.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(cuts, pa.binary()), bpe.decode(ids, counts)],
                                                 [*part.schema.names[1:], "ids", "decoded"])

    out = slim.mapInArrow(run, ", ".join([*fields, "ids binary", "decoded string"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")
