"""Quality rules, classifier, tokens, packing and sharding against plain versions on small inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablesmith.llm import bpe, packing, quality_classifier, quality_rules, sharding
from tests.llm.conftest import SF

ODD_TEXTS = [None, "", "   \n\t ", "one", "a b c d e a b c d e", "x\ny\nx\n\n \nx", "#1 *b* $c% &|<> #", "\x1c a\x85b\xa0c　d",
             "word " * 3000, "äöü ß 😀 Ünïcode", "A" * 9000, "tail\n", "\ntail\ntail"]


def rows_of(texts):
    return [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2"][i % 3]) for i, t in enumerate(texts)]


def plain_base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(lines), len(covered))


def test_base_figures_match_plain_counts(spark, make_docs, sf_docs):
    texts = ODD_TEXTS + [r.text for r in sf_docs.collect()]
    got = {r.k0: tuple(r[c] for c in quality_rules.BASE_FIELDS) for r in
           quality_rules.text_figures(make_docs(rows_of(texts)), keep=("doc_id",)).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def plain_verdicts(rows):
    """The adaptive rules in plain Python: log-bin sketches per group, merged for small groups."""
    g = (1 + quality_rules.SKETCH_ERROR) / (1 - quality_rules.SKETCH_ERROR)
    ratio, failed, units = {}, {}, {}
    for i, text, lang, source in rows:
        w, c, s, d, n, r = plain_base(text)
        failed[i] = w < 10 or 100 * r > 20 * w
        units[i] = dict(words=1 / max(w, 1), lines=1 / max(n, 1))
        ratio[i] = dict(symbols_per_word=s / max(w, 1), chars_per_word=c / max(w, 1), dup_line_share=d / max(n, 1), repeat_word_share=r / max(w, 1))
    groups = defaultdict(lambda: defaultdict(Counter))
    for i, _, lang, source in rows:
        if not failed[i]:
            for rule, v in (ratio[i] | units[i]).items():
                b = math.ceil(math.log(v) / math.log(g)) if v > 0 else None
                for key in ((lang, source), (lang,), ()):
                    groups[key][rule][b] += 1

    def quantiles(key, rule):
        bins, total, seen, out = groups[key][rule], sum(groups[key][rule].values()), 0, []
        wanted = (0.25, 0.5, 0.75, quality_rules.TAIL)
        for b in sorted(bins, key=lambda b: -math.inf if b is None else b):
            seen += bins[b]
            while len(out) < len(wanted) and seen >= math.ceil(total * wanted[len(out)]):
                out.append(0.0 if b is None else g ** b * 2 / (1 + g))
        return out

    def limits(key, rule):
        unit, few, many = quality_rules.RULES[rule]
        q1, _, q3, tail = quantiles(key, rule)
        near, far = (max(quality_rules.SPREADS * (q3 - q1), events * quantiles(key, unit)[1]) for events in (few, many))
        low = q1 - far if rule in quality_rules.BOTH_SIDES else -math.inf
        return low, min(q3 + far, max(q3 + near, tail * (1 + quality_rules.MARGIN)))

    size = lambda key: sum(groups[key]["chars_per_word"].values()) if key in groups else 0
    out = {}
    for i, _, lang, source in rows:
        key = next((k for k in ((lang, source), (lang,)) if size(k) >= quality_rules.MIN_GROUP), ())
        out[i] = not failed[i] and all(limits(key, rule)[0] <= v <= limits(key, rule)[1] for rule, v in ratio[i].items())
    return out


def test_verdicts_match_plain_rules(spark, make_docs, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    texts = []
    for i in range(240):
        words = [word() for _ in range(rng.randint(8, 60))]
        if i % 9 == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        if i % 13 == 0:
            words = words[:5] * 6
        if i % 23 == 0:
            words = [w[:1] for w in words]
        if i % 29 == 0:
            words += words[:6]
        texts.append(" ".join(words) + ("\nsame line\nsame line" if i % 5 == 0 else ""))
    rows = rows_of(texts + ODD_TEXTS)
    got = {r.doc_id: r.kept for r in quality_rules.adaptive_filter(make_docs(rows)).collect()}
    want = plain_verdicts(rows)
    assert got == want and 0 < sum(want.values()) < len(rows)


def test_every_rule_fires_below_the_base_limit(spark, make_docs):
    """In a group of clean texts each kind of fault goes and is counted for its rule, though the base test lets all pass."""
    rng = random.Random(8)
    word = lambda low, high: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(low, high)))
    lines = lambda n, low=3, high=7: [" ".join(word(low, high) for _ in range(8)) for _ in range(n)]
    clean = ["\n".join(lines(6)) for _ in range(150)]
    base = lines(11)
    faults = {"symbols_per_word": ["\n".join([*lines(6), "# * $ & | < > % # *"])],
              "chars_per_word": ["\n".join(lines(6, 10, 14)), "\n".join(lines(6, 1, 1))],
              "dup_line_share": ["\n".join(lines(6) + ["ab cd"] * 5)],
              "repeat_word_share": ["\n".join([*base, " ".join(base[0].split()[:6])])]}
    odd = [(r, t) for r, texts in faults.items() for t in texts]
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate([*clean, *[t for _, t in odd]])])
    got = {r.doc_id: r for r in quality_rules.adaptive_filter(docs, reasons=True).collect()}
    assert not any(r.base_failed for r in got.values())
    for i, (rule, _) in enumerate(odd):
        assert not got[len(clean) + i].kept and rule in got[len(clean) + i].failed_rules, rule
    assert sum(got[i].kept for i in range(len(clean))) >= 0.98 * len(clean)
    assert all(r.documents > 0 for r in quality_rules.rejections(docs).collect())


def test_limits_follow_the_group(spark, make_docs):
    """5 % junk of a group goes though it holds its tail quantile, and the same slips pass in short texts and not in long ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    text = lambda n, slips=0: " ".join([word() for _ in range(n - slips)] + [word() + "#" for _ in range(slips)])
    short = [(i, text(30), "en", "short") for i in range(100)] + [(100 + i, text(30, 25), "en", "short") for i in range(6)] + [(110, text(30, 2), "en", "short")]
    long = [(200 + i, text(400), "en", "long") for i in range(100)] + [(300 + i, text(400, 25), "en", "long") for i in range(6)]
    got = {r.doc_id: r.failed_rules for r in quality_rules.adaptive_filter(make_docs(short + long), reasons=True).collect()}
    assert all("symbols_per_word" in got[i] for i in [*range(100, 106), *range(300, 306)]) and got[110] == []
    assert sum(got[i] == [] for i in [*range(100), *range(200, 300)]) >= 196
    origins = {(r.rule, r.origin): r.groups for r in quality_rules.limit_origins(make_docs(short + long)).collect()}
    assert origins["symbols_per_word", "events"] == 2 and origins["chars_per_word", "range"] == 2 and sum(origins.values()) == 8


def test_rules_keep_good_documents(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.adaptive_filter(sf_docs).join(labels, "doc_id").toPandas()
    fine = got[(got.quality == 1) & ~got.base_failed]
    assert fine.kept.mean() >= 0.98 and not got[got.base_failed].kept.any()


def test_empty_tables(spark, make_docs):
    none = make_docs([])
    assert quality_rules.adaptive_filter(none).collect() == []
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert bpe.encode_documents(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert sharding.interleave_shards(none, "source", "doc_id").collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.score_documents(none, labels).collect() == []
    some = make_docs(rows_of(ODD_TEXTS))
    assert {r.score for r in quality_classifier.score_documents(some, labels).collect()} == {0.5}


# --- classifier ---------------------------------------------------------------------------------------------------

def test_classifier_on_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert set(held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5)) == {0}
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(good > b).mean() for b in bad]) > 0.95
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_held_out_labels_change_nothing(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_classifier.score_documents(sf_docs, x).collect()} for x in (labels, flipped))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_odd_documents_get_scores(spark, make_docs, sf_docs):
    rows = rows_of(ODD_TEXTS) + [(None, "no key", "en", "s1"), (3, "again", "en", "s1"), (3, "again", "en", "s1")]
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, None), (5, 1), (6, 0), (8, 1), (9, 1), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.score_documents(make_docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def plain_scores(rows, labels):
    """The classifier in plain numpy: the same statistics, least squares over all rows at once, pooling of violators by hand."""
    Q = quality_classifier
    x, fold = np.array([r.x for r in rows]), np.array([zlib.crc32(str(r.doc).encode()) % Q.FOLDS for r in rows])
    y = np.array([labels.get(r.doc, np.nan) for r in rows], float)
    z = Q.Fourier(x.mean(axis=0), x.std(axis=0))(x)
    fit = ~np.isnan(y) & (fold != 0) & (fold != Q.CALIBRATE)
    root = np.sqrt(Q.PENALTY * fit.sum()) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.vstack([z[fit], root]), np.concatenate([y[fit], np.zeros(z.shape[1])]), rcond=None)[0]
    raw = np.clip(z @ weights, -1, 2)
    cells = defaultdict(list)
    for i in np.flatnonzero(~np.isnan(y) & (fold == Q.CALIBRATE)):
        cells[math.floor(raw[i] * (Q.CELLS / 3))].append(y[i])
    parts = [[(c + 0.5) * 3 / Q.CELLS * len(v), len(v), sum(v)] for c, v in sorted(cells.items())]
    while True:  # merge the first pair of neighbours that does not rise until there is none
        at = next((i for i in range(len(parts) - 1) if parts[i][2] * parts[i + 1][1] >= parts[i + 1][2] * parts[i][1]), None)
        if at is None:
            break
        parts[at:at + 2] = [[a + b for a, b in zip(parts[at], parts[at + 1])]]
    knots = [p[0] / p[1] for p in parts], [p[2] / p[1] for p in parts]
    return np.clip(np.interp(raw, *knots) * 0.999 + (raw + 1) / 3 * 0.001, 0, 1)


def test_scores_equal_plain_least_squares(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_classifier.text_statistics(sf_docs, "text", "doc_id").collect()
    want = dict(zip([r.doc for r in rows], plain_scores(rows, {r.doc_id: r.quality for r in labels.collect()})))
    got = {r.doc_id: r.score for r in quality_classifier.score_documents(sf_docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-6


def test_isotonic_pools_violators():
    centre, value = quality_classifier.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([2.0, 2.0, 2.0, 4.0]), np.array([0.0, 2.0, 1.0, 4.0]))
    assert value.tolist() == [0.0, 0.75, 1.0] and centre.tolist() == [1.0, 2.5, 4.0]


# --- tokens and packing -------------------------------------------------------------------------------------------

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_bpe():
    with open(WORD, encoding="utf-8") as f:
        return bpe.WordBPE(f.read()), Tokenizer.from_file(WORD)


ANY = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aaabehilostΣß'\n <|>")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(ANY, st.sampled_from(["<|endoftext|>", "hahahaha aaaaaaa", "<|startoftext|>x<|endoftext|>", "a" * 700])), max_size=5))
def test_word_bpe_equals_library(word_bpe, texts):
    own, library = word_bpe
    ids, counts = own.encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
    for text, got, back in zip(texts, parts, own.decode(ids, counts).to_pylist()):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want and back == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_byte_encoder_equals_library(text):
    global _BYTE
    try:
        own, library = _BYTE
    except NameError:
        with open(BYTE, encoding="utf-8") as f:
            own, library = _BYTE = packing.byte_level_encoder(f.read()), Tokenizer.from_file(BYTE)
    assert own.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def test_documents_round_trip(spark, make_docs, sf_docs):
    texts = ODD_TEXTS + [r.text for r in sf_docs.limit(60).collect()] + ["<|endoftext|> andᲉ"]
    library = Tokenizer.from_file(WORD)
    for r in bpe.encode_documents(make_docs(rows_of(texts)), WORD).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r.decoded == library.decode(want, skip_special_tokens=False)


def check_pieces(pieces, texts, window):
    library = Tokenizer.from_file(BYTE)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for i, t in texts.items():
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted(by_doc.pop(i), key=lambda p: p["start"])
        got = [x for p in mine for x in np.frombuffer(p["ids"], "<u4").tolist()]
        assert got == want and [p["start"] for p in mine] == np.cumsum([0] + [p["length"] for p in mine])[:-1].tolist()
        assert {p["doc_tokens"] for p in mine} == {len(want)}
        assert [p["is_boundary"] for p in mine] == [len(mine) > 1] * len(mine)
    assert not by_doc
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) == window or s == len(sequences) - 1


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_holds_every_token_once(spark, make_docs, sf_docs, window):
    texts = dict(enumerate(ODD_TEXTS + [r.text for r in sf_docs.limit(50).collect()]))
    docs = make_docs(rows_of(list(texts.values()))).repartition(5)
    check_pieces([r.asDict() for r in packing.pack(docs, BYTE, window).collect()], texts, window)


# --- sharding -----------------------------------------------------------------------------------------------------

def test_shards_have_the_mixture(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, f"t{i}", "en", rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(1500)] + [(None, "x", "en", "a"), (7, "t7", "en", "hot"), (7, "t7", "en", "hot")]
    docs = make_docs(rows)
    got = sharding.interleave_shards(docs, "source", "doc_id", 16, payload=("text", "source")).toPandas()
    assert len(got) == len(rows) and Counter(got.doc_id.dropna()) == Counter(i for i, *_ in rows if i is not None)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, part in got.groupby(got.source.fillna("?")):
        counts = part.groupby("shard").size().reindex(range(16), fill_value=0)
        assert counts.max() - counts.min() <= 2
    again = sharding.interleave_shards(docs.repartition(7), "source", "doc_id", 16, payload=("text", "source")).toPandas()
    key = ["doc_id", "text", "shard", "slot"]
    assert got[key].sort_values(["shard", "slot"]).reset_index(drop=True).equals(again[key].sort_values(["shard", "slot"]).reset_index(drop=True))


def test_shards_equal_plain_rank_and_cut(spark, make_docs):
    """The law in plain Python: seeded hash order within a source, fractional ranks, one cut for all shards."""
    rng = random.Random(6)
    docs = make_docs([(i, f"t{i}", "en", rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(700)])
    rows = [(r.source, r.h, r.doc_id) for r in docs.select("source", "doc_id", F.xxhash64(F.lit(7), F.col("doc_id")).alias("h")).collect()]
    first = lambda s: (s is not None, s or "")  # noqa: E731  null sorts first
    ranked = []
    for source in {s for s, *_ in rows}:
        mine = sorted((h, i) for s, h, i in rows if s == source)
        ranked += [((2 * r + 1) / (2 * len(mine)), first(source), h, i) for r, (h, i) in enumerate(mine)]
    want, n = {}, len(rows)
    for pos, (*_, i) in enumerate(sorted(ranked)):
        shard = pos * 16 // n
        want[i] = (shard, pos - -(-shard * n // 16))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave_shards(docs, "source", "doc_id", 16).collect()}
    assert got == want


def test_fewer_rows_than_shards(spark, make_docs):
    got = sharding.interleave_shards(make_docs(rows_of(["a", "b", None])), "source", "doc_id").collect()
    assert len(got) == 3 and {r.slot for r in got} == {0}


def test_sharding_runs_no_python(spark, make_docs):
    plan = sharding.interleave_shards(make_docs(rows_of(["a"])).cache(), "source", "doc_id")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
