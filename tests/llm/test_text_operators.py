"""The text operators on small fixtures: edge cases and brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.compare import connect, rows
from tidemark.llm import balanced_lp, decontam, language_crf, media_sequences, mixture, paragraph_dedup, queries, template_html, textnum, toxicity_rnn, trie_join, url_rules

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra int"
EDGES = [(1, None, None, None, 1), (2, "", "en", "s", 2), (3, "a b c", "en", "s", 3), (4, "a b c", "en", "s", 3), (4, "a b c", "en", "s", 3), (5, "!!! ...", None, "t", 4), (6, " ".join(f"w{i}" for i in range(30000)), "en", "t", 5)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, DIR).toPandas()) == rows(connect(DIR).execute(queries.SQL[name]).df())


def test_sharding(spark, edges, none):
    assert balanced_lp.assign(none).count() == 0
    assert balanced_lp.assign(edges, 3).count() == len(EDGES)
    texts = [(i, f"copy {i % 7}" if i % 3 else f"own {i}") for i in range(300)]
    got = balanced_lp.assign(spark.createDataFrame(texts, "doc_id long, text string"), 6).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 6
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text = dict(texts)
    assert all(c == zlib.crc32(text[i].encode()) and s == len(text[i]) + 8 for i, c, s in zip(got.doc_id, got.text_crc32, got["size"]))
    together = got[got.doc_id % 3 != 0].groupby("text_crc32").shard.agg(lambda s: s.value_counts().iloc[0] / len(s))
    assert together.mean() > 0.6


def test_seats_are_the_highest_quotients():
    draw = random.Random(1)
    for _ in range(60):
        goals = {k: Fraction(draw.randint(0, 400), draw.randint(1, 5)) for k in "abcde"[: draw.randint(1, 5)]}
        n = draw.randint(0, 120)
        ranked = sorted(((g / (2 * k - 1), i, s) for i, (s, g) in enumerate(goals.items()) if g for k in range(1, n + 2)), key=lambda x: (-x[0], x[1]))[:n]
        assert mixture.seats(goals, n) == {s: sum(x[2] == s for x in ranked) for s in goals}
    assert mixture.shard_quotas({"a": 3, "b": 1}, 8, 2) == [{"a": 3, "b": 1}, {"a": 3, "b": 1}]


def test_mixture_edges(edges, none):
    assert mixture.mix(none).count() == 0
    got = mixture.mix(edges, block_tokens=1)
    assert got.count() == len(EDGES) and "extra" in got.columns
    assert all(x["taken"] <= 2 * x["size"] for x in got.collect())
    taken = {x["doc_id"]: x["taken"] for x in got.where("doc_id in (1, 6)").collect()}
    emitted = mixture.emit(got).where("doc_id = 6").collect()
    assert taken[1] == 0 and sum(len(x["text"].split()) for x in emitted) == taken[6]


def test_url_rules_by_join_equal_those_in_line(spark):
    urls = ["http://A.example.org/en/12?x", "https://org/", "ftp://b.com/fr/1", "http://com", None, "nothing", "http://example.org/es/", "http://x.com/de/a#b", "http://xorg/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    a = url_rules.judge_urls(df, queries.URL_RULES).toPandas()
    assert rows(a) == rows(url_rules.judge_urls(df, queries.URL_RULES, inline_rules=0).toPandas())
    by = dict(zip(a.page_id, zip(a.rule, a.verdict)))
    assert by[0] == ("example.org/en/1", "block") and by[1] == ("org/", "allow") and by[2] == ("com/fr/", "allow") and by[3][1] == "allow" and by[3][0] is None
    assert by[6][0] == "example.org/es/" and by[7] == ("com/de/", "block") and by[8][0] is None
    assert url_rules.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def near_copies():
    draw = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"v{draw.randint(0, 500)}" for _ in range(draw.randint(3, 60))]
        for _ in range(draw.randint(1, 5)):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = f"z{draw.randint(0, 99)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [256, 2])
def test_trie_join_is_exact(spark, block):
    texts = near_copies()
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in (t.split() for t in texts)]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: (x["n"], x["comp"]) for x in trie_join.TrieJoin(docs, 4, 85, block=block).documents().collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_trie_join_edges(edges, none):
    assert trie_join.TrieJoin(none).documents().count() == 0
    got = {x["id"]: (x["n"], x["comp"]) for x in trie_join.TrieJoin(edges).documents().collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (29996, 6)}


def test_trie_walk_prunes_nothing_similar():
    draw = np.random.default_rng(0)
    query = np.unique(draw.integers(0, 2000, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([draw.choice(query, len(query) - k, replace=False), draw.integers(0, 2000, k // 2).astype(np.uint64)])) for k in range(0, 60, 3)]
    want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(query, s)) >= 80 * len(np.union1d(query, s))]
    assert sorted(trie_join.trie_links(query, sets, 80, segment=7)) == want


def test_decontamination_blocks_and_offsets(spark, edges, none):
    items = spark.createDataFrame([(1, "Alpha beta, gamma! delta epsilon zeta eta theta iota kappa LAMBDA"), (2, "short one"), (3, None), (4, "...")], "item_id long, text string")
    text = "é-x Beta gamma delta " + "alpha BETA gamma delta; epsilon zeta eta theta iota kappa lambda. Short\none"
    docs = spark.createDataFrame([(9, text)], "doc_id long, text string")
    for size in (50_000, 4):
        x = decontam.judged(decontam.find(docs, items, block_words=size)).first()
        assert (x["n_hit"], x["item_ids"], x["contaminated"]) == (13, ["1", "2"], True)
        assert {text[h["start"] : h["end"]] for h in x["hits"] if h["item_id"] == "2"} == {"Short\none"}
    got = decontam.judged(decontam.find(edges, items))
    assert got.count() == len(EDGES) and got.where("contaminated").count() == 0 and "extra" in got.columns
    assert decontam.judged(decontam.find(none, items)).count() == 0
    assert decontam.judged(decontam.find(docs, items.limit(0))).first()["n_hit"] == 0


def test_html(spark):
    common = '<div class="x9">Sign up <b>now</b> for mail</div>'
    html = "<html><head><title>t</title></head><body><nav>menu</nav>%s<div><p>Body &amp; soul %d</p><ul><li>one %d<li>two %d</ul></div><div id=comments><p>me too</p></div><footer>f</footer></body></html>"
    pages = [(i, f"http://h.com/{i}", html % (common, i, i, i)) for i in range(12)] + [(20, "http://h.com/a", f"<article><h1>T</h1>{common}<p>said <i>x</i>y<p>same</p></article>"), (21, None, None), (22, "http://h.com", ""), (23, "x", "a < b & c <!-- gone --> d")]
    got = {x["page_id"]: x["text"] for x in template_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Body & soul 3\none 3\ntwo 3"
    assert got[20] == "T\nsaid xy\nsame" and got[21] == "" and got[22] == "" and got[23] == "a < b & c d"
    assert template_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_media(spark, edges):
    d = "ab" * 32
    seq = media_sequences.sequence(f'<p>one</p><figure><img src="sha256:{d}"><figcaption>cap <b>x</b></figcaption></figure><p>two</p><img src="a.png">')
    assert [s[1] for s in seq] == ["text", "media", "text", "media"] and seq[1][3:] == (d, "cap x") and seq[3][3] is None
    rows_ = edges.select("doc_id", media_sequences.padded(edges["text"]).alias("p"), media_sequences.to_media(media_sequences.padded(edges["text"])).alias("m"), "text").collect()
    for x in rows_:
        raw = (x["text"] or "").encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert bytes(x["p"]) == want and media_sequences.from_media(bytes(x["m"])) == want
    got = queries.op5_media(spark, DIR).toPandas()
    text = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    for i, n, sha in zip(got.doc_id, got.n_bytes, got.payload_sha256):
        raw = text[i].encode()
        assert n == len(raw) and sha == hashlib.sha256(raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))).hexdigest()
    assert len(got) == len(text)


def test_crf_is_exact_over_blocks():
    draw = np.random.default_rng(0)
    model = language_crf.Model(list("abc"), None, draw.normal(size=3), draw.normal(size=(3, 3)))
    scores, bounds = draw.normal(size=(300, 3)) * 3, np.array([0, 1, 130, 130, 300])
    got = language_crf.marginals(model, scores, bounds)
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            want = language_crf._forward_backward(model.start, model.moves, scores[None, a:b])[0][0]
            assert np.allclose(want / want.sum(1, keepdims=True), got[a:b])


def test_language(edges, none):
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_crf.identify(edges, edges["doc_id"] > 0).collect()}
    assert got[1] == ("und", 0) and got[2] == ("und", 0) and got[5] == ("und", 0) and got[3][0] == "en" and 0 <= got[3][1] <= 1
    assert language_crf.identify(none, none["doc_id"] > 0).count() == 0
    model = language_crf.train(["the cat and the dog sat there " * 9, "der hund und die katze sitzen dort " * 9] * 4, ["en", "de"] * 4)
    assert language_crf.predict(model, ["the dog and the cat"] + ["die katze und der hund"])[0] == ["en", "de"]


def test_network_gradients():
    draw = np.random.default_rng(2)
    net = toxicity_rnn.Network(np.arange(5, dtype=np.uint64), draw.normal(size=5).astype(np.float32), width=6)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    word, grams, begins = np.arange(5), draw.integers(0, 50, 15), np.arange(0, 15, 3)
    spot, mask = draw.integers(0, 5, (4, 6)), np.ones((4, 6), np.float32)
    mask[1, 3:] = 0
    truth, weight = np.array([1, 0, 1, 0.0]), np.ones(4)
    g, _ = net.gradients(word, grams, begins, spot, mask, truth, weight)
    for k, at in (("in", (1, 2)), ("uf", (0, 3)), ("ub", (2, 14)), ("att", (3, 1)), ("out", (4,)), ("word", (2, 1)), ("bias", (7,))):
        keep, step = net.w[k][at], 1e-2
        net.w[k][at] = keep + step
        up = net.gradients(word, grams, begins, spot, mask, truth, weight)[1]
        net.w[k][at] = keep - step
        down = net.gradients(word, grams, begins, spot, mask, truth, weight)[1]
        net.w[k][at] = keep
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3


def test_toxicity(spark, edges, none):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100, 180)], "doc_id long, toxic int")
    draw = random.Random(0)
    texts = [(i, " ".join([f"word{draw.randint(0, 60)}" for _ in range(40)] + ["vile scoundrel"] * (i % 4 == 0) + [f"x{draw.randint(0, 60)}" for _ in range(40)])) for i in range(100, 180)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = toxicity_rnn.classify(docs, labels, labels["doc_id"] < 160).toPandas()
    assert ((got.predicted == 1) == (got.doc_id % 4 == 0)).mean() > 0.9 and got.score.between(0, 1).all()
    assert toxicity_rnn.classify(edges, labels, labels["doc_id"] > 0).count() == len(EDGES)
    assert toxicity_rnn.classify(none, labels, labels["doc_id"] > 0).count() == 0


def test_all_windows_reach_the_end():
    owner, begin, length = toxicity_rnn.windows(np.array([0, 0, 5, 37, 137]), 32)
    assert [(begin[owner == i] + length[owner == i]).max() for i in range(4)] == [0, 5, 37, 137] and set(np.diff(begin[owner == 3])) == {16}


def test_repeated_passages(spark, edges, none):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(30):
        lines = [" ".join(word() for _ in range(40)) for _ in range(3)]
        if i < 4:
            lines[1] = passage
        elif i < 8:
            lines[1] = f"{lines[1]} {passage} {lines[2]}"
        elif i < 10:
            lines[1] = passage.replace(passage.split()[30], word())
        texts.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = paragraph_dedup.find(docs).toPandas()
    assert set(got.doc_id) == set(range(10)) and not got[got.doc_id == 0].removed.any()
    text = dict(texts)
    for x in got.itertuples():
        assert len(re.findall(r"\S+", text[x.doc_id][x.start : x.end])) == x.words
    assert paragraph_dedup.find(none).count() == 0
    assert set(paragraph_dedup.find(edges).toPandas().doc_id) == set()


@pytest.mark.parametrize("width", [5, 12, 19])
def test_repeated_passages_in_short_lines(spark, width):
    draw = random.Random(width)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    wrapped = lambda ws: "\n\n    ".join(" ".join(ws[i : i + width]) for i in range(0, len(ws), width))
    passage = [word() for _ in range(51)]
    texts = [(i, wrapped([word() for _ in range(draw.randrange(80))] + (passage if i < 4 else []) + [word() for _ in range(draw.randrange(80))])) for i in range(20)]
    texts += [(20, texts[10][1] + wrapped([word() for _ in range(51)])), (21, wrapped(passage))]
    texts += [(22, "\n".join(" ".join([word()] * 3) for _ in range(17))), (23, "x " * 70)]
    texts.append((24, texts[22][1]))
    got = paragraph_dedup.find(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    long_ = {10, 20} if len(texts[10][1].split()) >= 50 else set(got.doc_id) & {10, 20}
    assert set(got.doc_id) == {0, 1, 2, 3, 21, 22, 23, 24} | long_
    assert not got[got.doc_id.isin([0, 10, 22])].removed.any() and set(got[got.removed].doc_id) >= {1, 2, 3, 21, 23, 24}


def test_every_passage_from_50_words_is_found_whole(spark):
    draw = random.Random(11)
    word = lambda: str(int(draw.paretovariate(0.7))) if draw.random() < 0.7 else "".join(draw.choice("abcdefghij") for _ in range(6))
    texts, place = [], {}
    for i in range(150):
        passage = [word() for _ in range(draw.choice([50, 51, 55, 60, 70, 120]))]
        for j in (2 * i, 2 * i + 1):
            before, after = ([word() for _ in range(draw.randrange(60))] + [f"x{j}"], [f"y{j}"] + [word() for _ in range(draw.randrange(60))])
            texts.append((j, " ".join(before + passage + after)))
            place[j] = (len(" ".join(before)) + 1, len(" ".join(before + passage)), len(passage))
    got = paragraph_dedup.find(spark.createDataFrame(texts, "doc_id long, text string")).where("kind = 'piece'").toPandas()
    rows_ = {(x.doc_id, x.start, x.end, x.words, x.removed) for x in got.itertuples()}
    assert rows_ >= {(j, *place[j], j % 2 == 1) for j in place}


def test_class_docs_is_exact(spark):
    line = " ".join(f"w{i}" for i in range(22))
    got = paragraph_dedup.find(spark.range(1500).selectExpr("id as doc_id", f"'{line}' as text")).toPandas()
    assert len(got) == 3000 and set(got.class_docs) == {1500} and got.removed.sum() == 2998


def test_word_numbers():
    number, owner, first, end, data = textnum.words(["Ab c\tab", None, "", "AB é"])
    assert owner.tolist() == [0, 0, 0, 3, 3] and number[0] == number[2] == number[3] and len(set(number.tolist())) == 3
    sets = list(textnum.shingle_sets(["a b c d e", "a b", None, "A B"], 4))
    assert [len(s) for s in sets] == [2, 1, 0, 1] and sets[1][0] == sets[3][0]
