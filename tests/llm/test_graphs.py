"""Near-duplicates, nearest neighbours, main text, secrets, chat formatting and the pipeline against plain versions."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import chat_format, common, html_style_tree, minhash_dedup, nn_descent, quality_classifier, secret_scan
from tests.llm.conftest import SF
from tests.llm.test_texts import ODD_TEXTS, check_pieces, plain_verdicts, rows_of


def shingles(text, size):
    words = [w.decode() for w in re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or "").encode().split()]
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def plain_components(texts, size=4, percent=80):
    """Smallest id of each document's component, comparing all pairs."""
    sets, root = {i: shingles(t, size) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(rng, n, words=90):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(words)] = f"n{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_all_pairs(spark, make_docs, sf_docs):
    rng = random.Random(5)
    chain = ["c%d " % 0 + " ".join(f"k{i}" for i in range(j, j + 60)) for j in range(0, 24, 3)]  # linked only step by step
    texts = ODD_TEXTS + near_copies(rng, 40) + near_copies(rng, 12, 30) + chain + [r.text for r in sf_docs.collect()]
    texts += [texts[14].upper(), texts[14], "same short", "Same  SHORT", "two words"]
    texts = dict(enumerate(texts))
    got = minhash_dedup.near_duplicates(make_docs(rows_of(list(texts.values()))).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(texts)


def test_bucket_blocks_find_the_same_links(spark, make_docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    texts = dict(enumerate(near_copies(random.Random(8), 60, 60)))
    got = minhash_dedup.near_duplicates(make_docs(rows_of(list(texts.values()))), percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(texts)


def test_near_duplicates_of_repeated_and_missing_keys(spark, make_docs):
    text = "one two three four five six seven"
    rows = [(4, text, "en", "s"), (4, text, "en", "s"), (None, text, "en", "s"), (2, "else " * 3 + "x y z", "en", "s"), (4, "another text with the same key", "en", "s")]
    got = [(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(make_docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([(4, 4), (4, 4), (None, 4), (2, 2), (4, 4)], key=str)
    assert minhash_dedup.near_duplicates(make_docs([])).collect() == []


def test_pruning_rule():
    least = minhash_dedup.fewest_matches(0.8)
    steps = np.arange(1, len(least) + 1) * minhash_dedup.STEP
    assert all(a <= b for a, b in zip(least, least[1:])) and all(m < 0.8 * n for m, n in zip(least, steps))
    x, y = np.unique(np.random.default_rng(0).integers(0, 1 << 63, (2, 300)).astype(np.uint64), axis=1)
    flat, sizes = np.concatenate([np.sort(x), np.sort(y)]), np.array([len(x), len(y)])
    a, b = (np.frombuffer(s, np.uint8) for s in minhash_dedup.parity_sketches(flat, sizes))
    assert np.bitwise_count(a ^ b).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert all(find(n) == got.get(n, n) for n in root)


# --- nearest neighbours -------------------------------------------------------------------------------------------

def plain_neighbours(rows, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in fine:
        d = sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q)
        out[q] = d[:k]
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)] + [(400, None), (401, [0.0] * 8), (402, [1.0] * 7 + [float("nan")]),
                                                         (403, [1.0] * 7 + [None]), (404, [1.0] * 7 + [float("inf")]), (405, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string")
    got = defaultdict(list)
    for r in nn_descent.nearest_neighbours(df, df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = plain_neighbours([(i, v) for i, v in rows if not v or len(v) == 8], 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nn_descent.nearest_neighbours(df, df).collect()]
    assert sorted(got) == [(1, 1, 3), (1, 2, 2), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert nn_descent.nearest_neighbours(df.limit(0), df.limit(0)).collect() == []


def test_queries_outside_the_table(spark, monkeypatch):
    """Queries whose vectors no row has, in many sets of starting nodes; unusable ones have no result."""
    monkeypatch.setattr(nn_descent, "ENTRY_SEARCHES", 10)
    rng = np.random.default_rng(12)
    point = lambda: [float(np.float32(x)) for x in rng.normal(size=6)]
    rows = [(i, point()) for i in range(600)]
    outside = [(1000 + i, point()) for i in range(60)]
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0] * 3), (2003, [float("nan")] * 6), (None, point())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame(outside + [(3000, outside[0][1]), rows[7]] + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nn_descent.nearest_neighbours(table, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = {q: sorted((math.dist(v, x), i) for i, x in rows if i != q)[:10] for q, v in outside + [(3000, outside[0][1]), rows[7]]}
    assert got == {q: [i for _, i in near] for q, near in want.items()}
    assert nn_descent.nearest_neighbours(table.limit(0), asked).collect() == []


def test_neighbours_in_a_clump_of_near_copies(spark):
    """Copies whose differences are below an 8-bit step are told apart."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=32)
    points = np.vstack([base * (1 + 0.001 * rng.normal(size=(700, 32))), rng.normal(size=(700, 32))]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in nn_descent.nearest_neighbours(df, df.filter("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = {q: {i for _, i in d} for q, d in plain_neighbours(rows, 10).items() if q % 20 == 0}
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & want[q]) / 10 for q in want if q < 700]) >= 0.9


def test_beam_grows_with_measured_recall(spark, monkeypatch):
    """A first beam that is too narrow for the table is widened until sampled queries find their neighbours."""
    monkeypatch.setattr(nn_descent, "BEAM", 11)
    monkeypatch.setattr(nn_descent, "SPARE", 0)
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=48)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in nn_descent.nearest_neighbours(df, df.filter("vec_id % 25 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = {q: {i for _, i in d} for q, d in plain_neighbours(rows, 10).items() if q % 25 == 0}
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= nn_descent.RECALL


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {q: {i for _, i in d} for q, d in plain_neighbours(rows[:], 10).items() if q % 100 == 0}
    got = defaultdict(set)
    for r in nn_descent.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    assert got.keys() == want.keys() and np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.9


# --- main text ----------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header class="site"><p>Site</p></header><nav><ul><li><a href=/>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<div class="page"><article><h1>The &amp; <i>title</i>%d</h1><p>First&nbsp;para <b>bold<br>line %d<p>Second &lt;tag&gt; &#233; &copy 1 < 2
<div class="share-box">Share</div><div class="box">Read our magazine</div><ul><li>one %d<li>two</ul><!-- <p>no</p> -->
<section id="comments"><p>Nice!</p></section><form><p>Mail<input></p></form></article></div><aside>More</aside><footer>End</footer>"""


def test_main_text(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE % (i, i, i)) for i in range(12)] + [
        (20, "http://one.example/", "<p>Only <b>text</b></p><div class='ad'>buy</div>plain"), (21, None, None), (22, "", ""), (23, "x", "no markup & more"),
        (24, "http://one.example/2", "<article><p>cut off <a href='x"), (25, "http://one.example/3", "<div>" * 400 + "deep" + "</div>" * 400)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, blocks string")
    got = {r.page_id: r for r in html_style_tree.extract_main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == f"The & title{i}\n\nFirst para bold line {i}\n\nSecond <tag> é © 1 < 2\n\none {i}\n\ntwo"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in range(20, 26)] == ["Only text\n\nplain", "", "", "no markup & more", "cut off", "deep"]
    assert html_style_tree.extract_main_text(df.limit(0)).collect() == []


def test_repeated_branch_needs_enough_pages(spark):
    rows = [(i, f"http://h/{i}", PAGE % (i, i, i)) for i in range(html_style_tree.LEAST_PAGES - 1)]
    got = html_style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Read our magazine" in r.text for r in got)


def test_importance_is_entropy(spark):
    rows = [(i, "http://h/", f"<body><div class=a><p>same</p></div><div class=b><p>own {i}</p></div></body>") for i in range(16)]
    parsed = html_style_tree.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(round(r.importance, 6) for r in html_style_tree.node_importance(parsed).collect())
    w = html_style_tree.CONTENT_WEIGHT  # div.a and its p, div.b and its p
    assert got == [0.0, 0.0, w, w]


def kept_blocks(source):
    """What the prior odds alone leave of a page."""
    page = html_style_tree.Page(source)
    return [b.text for b in page.blocks if not b.noise and (b.core is not None or not page.article)]


def test_noise_inside_lines_ids_and_teasers():
    assert kept_blocks("<article><p>x<button>Share</button>y <span class=ad>BUY NOW</span>z<noscript>off</noscript></p></article>") == ["xy z"]
    assert kept_blocks("<p>a <select><option>one<option>two</select>b<svg><text>t</text></svg></p><p>c</p>") == ["a b", "c"]
    assert kept_blocks("<article><h2 id=social-impact>Impact</h2><section id=related-work><p>Work</p></section></article>") == ["Impact", "Work"]
    assert kept_blocks("<article><p>t</p></article><div class=responses><p>no</p></div>") == ["t"]
    assert kept_blocks("<article><p>t</p><ul class='post replies'><li>no</ul><div id=comments>no</div></article>") == ["t"]
    assert kept_blocks("<article><header><h1>Title</h1><p>by me</p></header><p>text</p><footer>f</footer></article>") == ["Title", "text"]
    long = "words of the text " * 20
    assert kept_blocks(f"<main>Sign in</main><div class=content><p>{long}</p></div>") == ["Sign in", long.strip()]
    assert kept_blocks(f"<div><p>{long}</p></div><div><article><p>A teaser</p></article></div>") == [long.strip(), "A teaser"]


@pytest.mark.parametrize("articles", [0, 1, 2])
def test_importance_decides_branches(spark, monkeypatch, articles):
    """A branch that all pages of a host share goes, in and outside articles; without the importance it stays."""
    own = lambda i, j: " ".join(f"own{i}x{j}x{k}" for k in range(30))
    inner = lambda i, j: f"<h2>Part {i}</h2><p>{own(i, j)}</p><blockquote>Follow our work every day of the week</blockquote><div class=note2>Terms apply</div>"
    wrap = {0: "<div class=page>{}</div>", 1: "<article>{}</article>", 2: "<article>{}</article>"}[articles]
    rows = [(i, "http://h/", "<nav>Menu</nav>" + "".join(wrap.format(inner(i, j)) for j in range(max(1, articles)))) for i in range(14)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    clean = {i: "\n\n".join(f"Part {i}\n\n{own(i, j)}" for j in range(max(1, articles))) for i in range(14)}
    assert {r.page_id: r.text for r in html_style_tree.extract_main_text(df).collect()} == clean
    monkeypatch.setattr(html_style_tree, "LEAST_PAGES", 1000)
    whole = {r.page_id: r.text for r in html_style_tree.extract_main_text(df).collect()}
    assert all("Follow our work" in t and "Terms apply" in t for t in whole.values())


def test_hosts_of_near_copies_keep_their_articles(spark):
    rows = [(i, "http://h/", f"<article><h1>News {i}</h1>" + "".join(f"<p>the same paragraph {k} of a long report</p>" for k in range(20)) + "</article>") for i in range(40)]
    got = html_style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.count("\n\n") == 20 for r in got)


def test_articles_in_comments_and_asides():
    """Article elements of comments and asides are not the article, and do not push out the page's text."""
    kept = kept_blocks
    assert kept("<div class=post><p>text</p></div><aside><article>tease</article></aside>") == ["text"]
    assert kept("<div class=post><p>text</p></div><section id=comments><article><p>nice</p></article></section>") == ["text"]
    assert kept("<article><p>text</p><div class=comments><article class=comment><p>nice</p></article></div></article>") == ["text"]
    assert kept("<article>text</article><ol><li><article class='comment odd'><p>nice</p></article></ol>") == ["text"]
    assert kept("<div class='page has sidebar'><article>one</article><article>two</article></div>") == ["one", "two"]


def test_articles_of_the_test_pages(spark):
    import html as h
    df = spark.read.parquet(f"{SF}/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    for r in html_style_tree.extract_main_text(df).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# --- secrets ------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(secret_scan.RULES[0][1])
SECRET_TEXTS = ["password = hunter22hunter", 'API_KEY:"abcdefgh1"', "password: secret: abcdefgh12", "token=token=abcdefgh", "apikey=short",
                "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 9, "AKIA" + "B" * 11, "f" * 32, "0" * 31 + "g" + "a" * 40, "ghp_" + "a1" * 20,
                "é😀 passwd:\"ABCDEFGHIJ\" " + "deadbeef" * 5 + " SECRET=" + "ab" * 20, "-----BEGIN RSA PRIVATE KEY-----", "x" * 5000 + " Token : abc.def_ghi",
                "eyJhbGciOi1.eyJzdWIiOi1.abcdefgh-1", "xoxb-1234567890a", "no secrets here, only a password"] + ODD_TEXTS


def plain_spans(text):
    found = []
    for ord_, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        found += [(m.start(), ord_, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)


def test_secrets_equal_plain_regexes(spark, make_docs):
    rows = rows_of(SECRET_TEXTS + SECRET_TEXTS[:1]) + [(0, SECRET_TEXTS[1], "en", "s"), (0, SECRET_TEXTS[0], "en", "s"), (None, SECRET_TEXTS[2], "en", "s")]
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.find_secrets(make_docs(rows)).collect()]
    want = [(i, plain_spans(t)) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert secret_scan.find_secrets(make_docs([])).collect() == []


def test_redaction(spark, make_docs):
    rows = rows_of(SECRET_TEXTS)
    docs = make_docs(rows)
    got = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    for i, text, *_ in rows:
        want, at = [], 0
        for start, _, _, end in plain_spans(text):
            if start >= at:
                want += [text[at:start], "[secret]"]
            at = max(at, end)
        assert got[i].text == (None if text is None else "".join(want) + text[at:]) and got[i].node == "clash"


def test_redaction_takes_the_whole_key(spark, make_docs):
    body = "\n".join("MIIEpAIBAAKCAQEA" + "aB3/" * 12 for _ in range(25)) + "\nQ2x=="
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"a {head}\n{body}\n{end} b", f"a {head}\nDEK-Info: AES-256-CBC,0F\n\n{body}\n{end} b", f"a {head}\n{body[:-6]}\n-- b", f"a {head} b"]
    got = {r.doc_id: r.text for r in secret_scan.redact(make_docs(rows_of(texts))).collect()}
    assert got == {0: "a [secret] b", 1: "a [secret] b", 2: "a [secret]\n-- b", 3: "a [secret] b"}


def test_a_long_key_without_its_end(spark, make_docs):
    """One truncated key of 100,000 lines must neither recurse per line nor leave its body."""
    line = "MIIEpAIBAAKCAQEA" + "aB3/" * 12
    head = "-----BEGIN PRIVATE KEY-----"
    texts = [f"a {head}\n" + "\n".join([line] * 100_000) + "\nrest of it", f"{head}\nA-B: " + "- " * 60 + f"\n{line}\n-----END PRIVATE KEY----- b",
             "eyJ" * 20_000, f"{head}\n{line} some words {head}\n{line}\nQ2x=\nend"]
    got = {r.doc_id: r.text for r in secret_scan.redact(make_docs(rows_of(texts))).collect()}
    assert got == {0: "a [secret]\nrest of it", 1: "[secret] b", 2: texts[2], 3: "[secret] some words [secret]\nend"}


def test_trigram_queries():
    query = {kind: secret_scan.trigram_query(p) for kind, p, *_ in secret_scan.RULES}
    assert query["hex"] is None and query["access"] == {frozenset(("aki", "kia"))}
    assert frozenset(("tok", "oke", "ken")) in query["assign"] and len(query["assign"]) == 6
    for kind, pattern, *_ in secret_scan.RULES:
        for text in SECRET_TEXTS:
            if query[kind] is not None and re.search(pattern, text or ""):
                grams = {text.lower()[i:i + 3] for i in range(len(text))}
                assert any(clause <= grams for clause in query[kind])


# --- chat formatting ----------------------------------------------------------------------------------------------

CONTROLS = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "<\\|end|>", "<\\\\|", "<|", "a<|image|>b", "", None, "line\nline", "é😀"]


def test_index_answers_boolean_queries(spark):
    """Postings of rows in many buckets, with trigrams that all, some and no rows hold, against plain set tests."""
    held = lambda i: {"all"} | {g for g, m in (("two", 2), ("six", 6), ("odd", 20011)) if i % m == 0}
    numbers = [*range(1, 400), *range(32_700, 32_900), *range(98_304, 98_320), (7 << 33) + 1, (7 << 33) + 40_023]
    rows = spark.createDataFrame([(i, sorted(held(i))) for i in numbers], "at long, grams array<string>").repartition(5)
    queries = {0: frozenset({frozenset({"all", "two"})}), 3: frozenset({frozenset({"odd"}), frozenset({"all", "six"})}),
               4: frozenset({frozenset({"all", "nil"})}), 5: frozenset({frozenset({"all"})})}
    got = {tuple(r) for r in secret_scan.answer_queries(secret_scan.index_postings(rows), queries).collect()}
    assert got == {(i, q) for i in numbers for q, any_ in queries.items() if any(clause <= held(i) for clause in any_)}


def test_rules_that_all_scan(spark, make_docs):
    rules = tuple(r for r in secret_scan.RULES if r[0] == "hex")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secret_scan.find_secrets(make_docs([(1, "0" * 33, "en", "s"), (2, None, "en", "s")]), rules=rules).collect()}
    assert got == {1: [(0, 0, "hex", 33)], 2: []}


def test_chat_round_trip(spark):
    rows = [(i % 4, i, ["user", "assistant", None, "sys<|tem"][i % 4 if i % 3 else 1], CONTROLS[i % len(CONTROLS)], "c") for i in range(40)]
    rows += [(9, 1, "assistant", "tie b", "c"), (9, 1, "assistant", "tie a", "c"), (9, 1, "assistant", "tie a", "c"), (None, None, "assistant", "lost", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_turns(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in chat_format.conversation_digests(formatted).collect()}
    size = {r.conv_id: r.s for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("s")).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        whole, loss = "".join(f"{r}\n{x}\n" for *_, r, x in turns), "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) == (len(turns), len(loss), size[c])
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_parts(spark):
    part = lambda kind, text=None, **k: (kind, text, k.get("uri"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    parts = [part("text", "see <|"), part("image", uri="a.png", width=29, height=14), part("audio", uri="b.wav", seconds=1.5),
             part("document", uri="c.pdf", pages=2), part(None, "end"), part("image")]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    a, b = chat_format.format_turns(df).orderBy("turn").collect()
    assert a.formatted == "<|turn|>assistant<|says|>see <\\|<|image|><|audio|><|document|>end<|image|><|end|>" and b.formatted == "<|turn|>user<|says|><|end|>"
    assert [(x.ordinal, x.kind, x.uri, x.n_tokens) for x in a.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 512), (3, "image", None, 0)]
    assert all(a.formatted[x.at:].startswith(f"<|{x.kind}|>") for x in a.attachments)
    assert [a.formatted[s.start:s.end] for s in a.loss] == ["see <\\|", "end"] and b.loss == []
    back = chat_format.read_back(chat_format.format_turns(df)).orderBy("turn").first()
    assert (back.text, back.learned) == ("see <|end", "see <|end")


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.conversation_digests(chat_format.format_turns(df.withColumn("parts", chat_format.text_parts(F.col("text"))))).collect() == []


# --- pipeline -----------------------------------------------------------------------------------------------------

def test_pipeline_stages_equal_plain_versions(spark):
    import corpus_pipeline as P
    docs = P.read(spark, SF, "documents")
    columns = docs.columns
    stage = dict(P.STAGES)
    assert list(stage) == ["quality_rules", "quality_classifier", "near_dedup", "secret_scan", "packing"]

    rules = P.cut(stage["quality_rules"](spark, docs, SF), "t")
    want = plain_verdicts([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    assert rules.columns == columns and {r.doc_id for r in rules.collect()} == {i for i, k in want.items() if k}

    good = P.cut(stage["quality_classifier"](spark, rules, SF), "t")
    scores = quality_classifier.score_documents(rules, spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.collect() if r.score >= 0.3}

    single = P.cut(stage["near_dedup"](spark, good, SF), "t")
    parts = plain_components({r.doc_id: r.text for r in good.collect()}, P.SHINGLE, P.PERCENT)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {i for i, (_, c) in parts.items() if i == c}

    clean = P.cut(stage["secret_scan"](spark, single, SF), "t")
    before, after = ({r.doc_id: r for r in df.collect()} for df in (single, clean))
    assert clean.columns == columns and before.keys() == after.keys()
    assert all((after[i].text == before[i].text) == (not plain_spans(before[i].text)) and not plain_spans(after[i].text) for i in before)

    def key(r):
        return r["doc_id"], r["start"]
    packed = stage["packing"](spark, clean, SF).collect()
    whole = P.run(spark, SF).collect()
    got = {key(r): (r.length, r.doc_tokens, r.ids_crc32) for r in packed}
    assert len(whole) >= len({r.doc_id for r in clean.collect()}) and {k[0] for k in got} == {r.doc_id for r in whole}
    from tablesmith.llm import packing
    import public_tokenizers
    pieces = [r.asDict() for r in packing.pack(clean, public_tokenizers.path("byte_bpe_50k.json")).collect()]
    check_pieces(pieces, {r.doc_id: r.text for r in clean.collect()}, 2048)


def test_near_dedup_keeps_one_row_per_component(spark, make_docs):
    """Rows of one key are told apart: only the text that repeats another row's goes."""
    import corpus_pipeline as P
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (None, c), (None, c + " more"), (7, None), (7, None), (8, ""), (None, b + " x")]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup_stage(spark, docs, SF).collect()), key=str)
    one_c = [t for k, t in got if k is None]
    assert len(one_c) == 1 and one_c[0].startswith(c)
    assert [g for g in got if g[0] is not None] == [(1, a), (5, b), (7, None), (8, "")]


def test_pipeline_on_odd_documents(spark, make_docs, tmp_path):
    import corpus_pipeline as P
    rows = rows_of(ODD_TEXTS + SECRET_TEXTS) + [(None, " ".join(f"w{i}" for i in range(40)), None, None)] * 2
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = P.read(spark, str(tmp_path), "documents")
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == make_docs([]).columns, name
    assert docs.filter("doc_id is null").count() == 1
    assert P.run(spark, str(tmp_path)).count() >= 1


# --- the SQL oracles ----------------------------------------------------------------------------------------------

def test_oracles(spark):
    import duckdb
    from tablesmith.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLES.items():
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        df = QUERIES[name](spark, SF)
        assert sorted(df.columns) == sorted(names)
        assert sorted(map(str, df.select(names).toPandas().itertuples(index=False, name=None))) == sorted(map(str, [tuple(r) for r in cur.fetchall()]))


@pytest.mark.parametrize("name", ["op5_chat_format", "op8_bpe", "op10_shard"])
def test_queries_run(spark, name):
    from tablesmith.llm.queries import QUERIES
    assert QUERIES[name](spark, SF).count() > 0
