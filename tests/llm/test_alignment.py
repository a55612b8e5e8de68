"""Token alignment, line dedup and whitening against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablesmith.llm import line_dedup, queries, token_align, whitening
from tablesmith.llm.packing import byte_chars

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "<|endoftext|> </s> <s>x", "naïve 日本語 テスト\n\n\t  x", "▁foo", "  lead  double ", "🙂🙂 emoji‍",
       "x" * 3000, "a b " * 2500, "\x00\x01", "<0x41>", "ﬁ Ａ", "é \r\n end "]


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def plain_alignment(rows):
    a_tok, b_tok = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a_tok.encode_special_tokens = True
    back = byte_chars()
    docs, count, best = [], Counter(), {}
    for key, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append((key, [], [], [], []))
            continue
        sa, sb = spans(a_bytes), spans(b_bytes)
        links, low = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[low][1] <= s:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < e:
                links.append((i, j))
                j += 1
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in shared:
            inside = [",".join(str(x) for x, (s, e) in zip(ids, sp) if start < e <= end) for ids, sp in ((a, sa), (b, sb))] if len(a) < 500 else None
            groups.append(inside and "|".join(inside))
            start = end
        pairs = [(a[i], b[j]) for i, j in links]
        count.update(pairs)
        docs.append((key, a, b, groups, pairs))
    for (_, b), c in count.items():
        best[b] = max(best.get(b, 0), c)
    return {(key, len(a), len(b), len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p),
             None if g and g[0] is None else hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for key, a, b, g, p in docs}


def digests(docs, **options):
    aligned = token_align.align_tokens(docs, A_FILE, B_FILE)
    aligned = aligned.withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    out = token_align.link_support(aligned, **options).collect()
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha) for r in out]


def same_alignment(got, want):
    known = {w[:-1] for w in want}
    assert {g[:-1] for g in got} == known
    exact = {w for w in want if w[-1] is not None}
    assert all(g in exact for g in got if any(e[:-1] == g[:-1] for e in exact))


@pytest.mark.parametrize("heavy", [token_align.HEAVY, 20, 1])
def test_alignment_equals_plain(make_docs, heavy):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(None, "hello you", "en", "s"), (7, "hello you", "en", "s"), (7, "hello you", None, None)]
    got = digests(make_docs(rows), heavy=heavy)
    assert len(got) == len(rows)
    same_alignment(got, plain_alignment([(r[0], r[1]) for r in rows]))


def test_alignment_of_given_documents(spark, sf_docs):
    got = [tuple(r) for r in queries.QUERIES["op11_token_align"](spark, SF).collect()]
    assert len(got) == sf_docs.count()
    same_alignment(got, plain_alignment([(r.doc_id, r.text) for r in sf_docs.collect()]))


def test_alignment_of_no_documents(make_docs):
    assert digests(make_docs([])) == []


def test_lanes_do_not_change_links():
    rng = np.random.default_rng(3)
    sizes_a, sizes_b, ends_a, ends_b, base = [], [], [], [], 0
    for n in (0, 1, 400, 3, 0, 90):
        cuts = [np.unique(np.append(rng.integers(1, n * 3, rng.integers(1, 2 * n)), n * 3)) if n else np.zeros(0, int) for _ in "ab"]
        sizes_a.append(len(cuts[0])), sizes_b.append(len(cuts[1]))
        ends_a += (cuts[0] + base).tolist()
        ends_b += (cuts[1] + base).tolist()
        base += n * 3
    args = [np.array(x, np.int64) for x in (sizes_a, ends_a, sizes_b, ends_b)]
    whole, short = token_align.merge_lockstep(*args, lane=10**6), token_align.merge_lockstep(*args, lane=5)
    assert all((x == y).all() for x, y in zip(whole, short))
    starts_a, starts_b = np.r_[0, args[1][:-1]], np.r_[0, args[3][:-1]]
    brute = [(i, j) for i in range(len(args[1])) for j in range(len(args[3])) if starts_a[i] < args[3][j] and starts_b[j] < args[1][i]]
    assert list(zip(whole[0].tolist(), whole[1].tolist())) == brute


def test_link_positions(make_docs):
    row = token_align.align_tokens(make_docs([(1, "unbelievable tokenizers", "en", "s")]), A_FILE, B_FILE, links=True).first()
    assert len(row.links_a) == len(row.links_b) == row.n_links and row.links_a[-1] == row.n_a - 1 and row.links_b[-1] == row.n_b - 1
    keys, counts = token_align.unpack_pairs(bytes(row.pairs))
    assert counts.sum() == row.n_links and (np.diff(keys.astype(np.int64)) > 0).all()


def plain_lines(rows, min_docs):
    blanks = " \t\n\x0b\x0c\r"
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    split = [(k, (t or "").split("\n")) for k, t in rows]
    seen = Counter(x for _, lines in split for x in {li.strip(blanks).translate(low) for li in lines})
    gone = {x for x, n in seen.items() if x and n >= min_docs}
    out = []
    for k, lines in split:
        left = [li for li in lines if li.strip(blanks).translate(low) not in gone]
        out.append((k, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def by_text(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_line_dedup_equals_plain(make_docs):
    rows = [(1, "A \n b\nc\n"), (2, None), (3, ""), (4, "a\nX\na\nx"), (None, "a\nb"), (4, "a\nX\na\nx"), (5, "\x0bÄ\n ä\n a"),
            (6, "\n\n\n"), (7, "k\n" * 3000 + "only"), (8, "K"), (9, "\n".join(f"line {i % 40}" for i in range(2000))), (10, "LINE 7\nend")]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    for least in (1, 2, 3, 50):
        got = line_dedup.drop_frequent_lines(docs, min_docs=least).collect()
        assert by_text(map(tuple, got)) == by_text(plain_lines(rows, least))
    kept = line_dedup.drop_frequent_lines(docs, min_docs=2, keep=("lang", "t"))
    assert kept.columns == ["doc_id", "lang", "t", "text", "n_lines", "n_dropped"] and kept.count() == len(rows)
    assert line_dedup.drop_frequent_lines(make_docs([])).collect() == []


def test_line_dedup_min_chars(make_docs):
    docs = make_docs([(i, f"}}\nshared line\n{i}", "en", "s") for i in range(12)])
    got = {tuple(r) for r in line_dedup.drop_frequent_lines(docs, min_chars=2).collect()}
    assert got == {(i, f"}}\n{i}", 3, 1) for i in range(12)}


def test_line_dedup_of_given_documents(spark, sf_docs):
    want = {(k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, t, n, d in plain_lines([(r.doc_id, r.text) for r in sf_docs.collect()], 10)}
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.QUERIES["op12_line_dedup"](spark, SF).collect()}
    assert got == want and any(d for _, _, d, _ in got)


def plain_whitening(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    _, sigma, right = np.linalg.svd(c, full_matrices=False)
    return c, sigma**2 / n, right, ((n * x - s).astype(object) ** 2).sum(axis=1)


def check_whitening(rows, df):
    out = whitening.whiten(df).collect()
    by_id = dict(rows)
    c, values, right, dev = plain_whitening([by_id[r.vec_id] for r in out])
    got = np.array([r.whitened for r in out])
    k = got.shape[1]
    want = c @ right[:k].T / np.sqrt(values[:k])
    assert np.allclose(got, want * np.sign((want * got).sum(axis=0)), atol=1e-7)
    assert np.allclose(out[0].explained, values[:k] / values.sum(), rtol=1e-7)
    assert out[0].identity_error < 1e-7 and {r.n for r in out} == {len(out)}
    assert all(r.deviation in (d, None) for r, d in zip(out, dev))
    return out, k


def test_whitening_equals_svd(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    table = queries.QUERIES["op13_whitening"](spark, SF)
    assert dict(table.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                  "explained": "double", "identity_error": "double"}
    assert table.count() == 32 * len(rows)
    out, k = check_whitening(rows, spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert k == 32 and len(out) == len(rows) and all(r.deviation is not None for r in out)


VECTORS = "vec_id long, embedding array<double>"


def test_whitening_of_hard_spectra(spark):
    rng = np.random.default_rng(0)
    scaled = rng.normal(size=(400, 40)) * np.logspace(5, -1, 40)
    scaled[:, 7], scaled[:, 8] = 3, scaled[:, 9]
    rows = list(enumerate(scaled.tolist()))
    _, k = check_whitening(rows, spark.createDataFrame(rows, VECTORS))
    assert k == 32
    low = np.round(rng.normal(size=(300, 3)) * 50) @ np.round(rng.normal(size=(3, 10)) * 9)
    rows = list(enumerate(low.tolist()))
    _, k = check_whitening(rows, spark.createDataFrame(rows, VECTORS).withColumn("k0", F.lit("clash")).withColumn("x", F.lit(1)))
    assert k == 3


def test_whitening_of_odd_rows(spark):
    white = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert white([]) == white([(1, [1.0, 2.0])]) == white([(1, [1.0]), (2, [1.0])]) == white([(1, None)]) == []
    got = white([(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (None, [1.0, 5.0]), (5, [2.0, 3.0]), (6, [7.0]), (7, []),
                 (8, [float("inf"), 1.0]), (9, [1e300, 1.0])])
    assert sorted((str(r.vec_id), r.n, len(r.whitened), round(abs(r.whitened[0]), 6)) for r in got) == [("5", 2, 1, 1.0), ("None", 2, 1, 1.0)]
    twice = white([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [4.0, 0.0])])
    assert len(twice) == 3 and len({r.whitened[0] for r in twice if r.vec_id == 1}) == 1
