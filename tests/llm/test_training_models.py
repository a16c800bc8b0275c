"""Pages, quality, embeddings, language, mixing, secrets and the pipeline."""
import html as entities
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from wearline.llm import embedding_dedup, language_id, mixing, quality_rules, secrets, simhash
from wearline.llm.bpe_codec import codec
from wearline.llm.html_extract import main_text
from wearline.llm.queries import MIX_RATE, MIX_TARGETS, QUERIES, WORD_MODEL, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- pages
PARA_TEXT = "This is a paragraph of the article, with enough words, and commas, to count as prose."
PARA = f"<p>{PARA_TEXT}</p>"


def test_pages_of_the_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op1_html_extract"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page,text", [
    ("", ""), (None, ""), ("plain text &lt;b&gt;", "plain text <b>"), ("<script>x", ""),
    ("<p>a<b>b</b>c <i>d</i></p><div>e</div>", "abc d\ne"),
    ("<body><header><h1>Site</h1></header><main><h1>T</h1><p>One&amp;two &nbsp; three<br>four</p><section id='comments'><p>nice, "
     "very nice</p></section><form><p>Sign up</p></form></main><aside>x</aside></body>", "T\nOne&two three four"),
    ("<div class='content'><p>First, paragraph of text, long enough for it to count.</p><p>Second, one</p></div>"
     "<div class='cookie-notice'><p>We use cookies, accept, please, now, always and forever.</p></div>",
     "First, paragraph of text, long enough for it to count.\nSecond, one"),
    ("<div id=c><p>Long paragraph, with text, and words.</p><ul><li><a href=x>A link</a><li><a>b link</a></ul></div>",
     "Long paragraph, with text, and words."),
    ("<article><div hidden>no</div><script>var t='</p>';</script><table><tr><td>c1<td>c2</table><pre>  a\n b </pre></article>", "c1\nc2\na b"),
    ("<article><p>one<p>two</article><article class='comment'><p>reader says, well, a lot, of, things</p></article>", "one\ntwo"),
    (f"<div id=content><h1>T</h1><section class=s>{PARA * 3}</section><section class=s><p>Short one.</p></section></div>"
     "<div class='sideBar'><ul><li><a href=1>x</a></ul></div>", "T\n" + "\n".join([PARA_TEXT] * 3) + "\nShort one."),
    (f"<div class=topnav><a href=1>Home</a> <a>About</a></div><div id=main><h1>Title</h1><div class=body>{PARA * 2}</div>"
     f"<div id='commentList'><div class='c'>{PARA * 4}</div></div></div><div class='siteFooter'>x, y, z, and a lot</div>",
     "Title\n" + "\n".join([PARA_TEXT] * 2)),
    (f"<main><h1>A</h1><p>Hi.</p></main><div class='cookieNotice'>{PARA * 3}</div>", "A\nHi."),
    (f"<div class='widget content'>{PARA * 4}</div><div>x</div>", "\n".join([PARA_TEXT] * 4)),
    ("<p title=\"a>b\">x</p><!-- <p>no</p> --><a b='", "x"),
])
def test_pages_by_hand(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given.</p>", "Let x=2 be given."),
    ("<p>a</p><object data='f.swf'><param name=n><p>Fallback text.</p></object><p>b</p>", "a\nFallback text.\nb"),
    *[(f"<article><p>one</p><{t} class=x><p>two</p><p>three</p></article>", "one\ntwo\nthree")
      for t in ("svg", "math", "object", "canvas", "noscript", "template")],
    ("<article><p>one</p><svg><p>two</p><svg><text>icon</text></svg><p>three</p></article>", "one\ntwo\nthree"),
    ("<article><p>o<svg><g><svg>in</svg></g>out</svg>ne</p><template><p>t<template>u</template>v</p></template><noscript>n</noscript>"
     "<canvas>c</canvas><svg/><p>two</p></article>", "one\ntwo"),
])
def test_unseen_elements(page, text):
    assert main_text(page) == text


PROSE = "Search algorithms find an item, in a list, by looking at it again and again."


@pytest.mark.parametrize("page,text", [
    (f'<article><h1>T</h1>{PARA}<h2 id="comments">Comments in C</h2>{PARA}</article>', f"T\n{PARA_TEXT}\nComments in C\n{PARA_TEXT}"),
    (f'<article>{PARA}<p class="social">Social science</p>{PARA}</article>', f"{PARA_TEXT}\nSocial science\n{PARA_TEXT}"),
    (f'<article>{PARA}<section id="search"><p>{PROSE}</p></section></article>', f"{PARA_TEXT}\n{PROSE}"),
    (f'<article>{PARA}<div class="related"><p>{PROSE}</p></div>{PARA}</article>', f"{PARA_TEXT}\n{PROSE}\n{PARA_TEXT}"),
    (f'<div id=content>{PARA * 3}<div class="search"><p>{PROSE}</p></div>{PARA}</div>', "\n".join([PARA_TEXT] * 3 + [PROSE, PARA_TEXT])),
    (f'<article>{PARA}<section id="comments-in-c"><h2>Comments in C</h2>{PARA}</section></article>', f"{PARA_TEXT}\nComments in C\n{PARA_TEXT}"),
    (f'<article>{PARA}<h2>References</h2><ul><li><a href=1>Smith, 2010</a><li><a href=2>Jones</a></ul></article>',
     f"{PARA_TEXT}\nReferences\nSmith, 2010\nJones"),
    (f'<article>{PARA}<p>Sources:</p><ul><li><a href=1>Smith</a></ul>{PARA}</article>', f"{PARA_TEXT}\nSources:\nSmith\n{PARA_TEXT}"),
    (f'<article>{PARA}<ol><li><a href=1>First step</a></ol>{PARA}</article>', f"{PARA_TEXT}\nFirst step\n{PARA_TEXT}"),
    # what the names still mark
    (f'<article>{PARA}<section id="comments"><h2>Comments</h2>{PARA}</section></article>', PARA_TEXT),
    (f'<article>{PARA}<div class=share><a>Tweet</a><a>Post</a></div><div class="related"><ul><li><a>A long title of another text, elsewhere'
     ' on this site of ours</a></ul></div></article>', PARA_TEXT),
    (f'<article>{PARA}<div class="newsletter">{PARA}</div><div class="cookie-notice">{PARA}</div></article>', PARA_TEXT),
    (f'<article><ul><li><a>Home</a><li><a>News</a></ul>{PARA}<div><a>Older</a> <a>Newer</a></div></article>', PARA_TEXT),
])
def test_article_text_with_telling_names(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</p>" * 50_000, "<li><div>" + "<center>" * 20_000 + "<dt><li>" * 20_000,
                                  "<p>" * 50_000, "<td><b></td></div>" * 20_000])
def test_bad_nesting_takes_linear_time(page):
    import time
    begin = time.process_time()
    main_text(page)
    whole = time.process_time() - begin
    begin = time.process_time()
    main_text(page[:len(page) // 4])
    assert whole < 8 * (time.process_time() - begin) + 0.5


def test_many_unclosed_elements():
    assert main_text("<p>a" + "<svg>" * 20_000 + "b</p>") == "ab"


def test_deep_page():
    assert main_text("<div>" * 20_000 + "x") == "x"


# ---------------------------------------------------------------- quality
def test_quality_counts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "\n a b c.\n a b c.\n"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality(df).collect():
        w = WORD.findall(texts[r.doc_id])
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in texts[r.doc_id].split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_quality_lines(spark):
    rng = random.Random(8)
    body = "\n".join(" ".join("".join(rng.choices("aeinorst", k=5)) for _ in range(12)) + "." for _ in range(8))
    rows = [(1, body), (2, "\n".join("Home | About | item" + str(i) + " | more and more words here" for i in range(20))),
            (3, body + "\nAll rights reserved.\nSign up here now"), (4, " ".join(f"wo%%% r{i}###" for i in range(80)))]
    out = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].kept for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert out[3].clean_text == body and out[2].clean_text == ""


# ---------------------------------------------------------------- embeddings
def brute_vectors(rows, cosine=0.98):
    unit = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float64)
            unit[k] = a / np.linalg.norm(a)
    links = {k: [m for m in unit if m != k and rows[m][2] == rows[k][2] and len(unit[m]) == len(unit[k]) and unit[m] @ unit[k] >= cosine] for k in unit}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((i, len(links.get(k, [])), min(rows[m][0] for m in seen)))
    return out


@pytest.mark.parametrize("block,leaf", [(1024, 256), (7, 3)])
def test_embeddings(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, 2, None):
        for _ in range(25):
            v = rng.normal(size=8)
            for _ in range(int(rng.choice([1, 1, 2, 6]))):
                rows.append((n, [float(np.float32(x)) for x in v + rng.normal(size=8) * 0.1 * rng.choice([0, 0.5, 1])], label))
                n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [None] * 8, 1), (n + 4, rows[0][1], 0),
             (n + 5, [x * 4 for x in rows[0][1]], 0), (n + 6, [-0.0 if x == 0 else x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(df).collect()}
    for i, links, comp in brute_vectors(rows):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, comp, i == comp)


@pytest.mark.parametrize("lengths", [16, 1])
def test_embeddings_of_mixed_lengths(spark, monkeypatch, lengths):
    monkeypatch.setattr(embedding_dedup, "LENGTHS", lengths)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 5)
    rng = np.random.default_rng(9)
    rows = []
    for dim, many in ((8, 30), (3, 6), (12, 6), (1, 3)):
        for _ in range(many):
            v = rng.normal(size=dim)
            label = int(rng.integers(2))
            for _ in range(int(rng.choice([1, 2, 4]))):
                rows.append((len(rows), [float(np.float32(x)) for x in v + rng.normal(size=dim) * 0.05 * rng.choice([0, 1])], label))
    rows += [(len(rows), [1.0] * 65, 1), (len(rows) + 1, None, 1)]  # one over-long row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(df).collect()}
    want = brute_vectors(rows)
    assert all(any(links and len(rows[i][1]) == dim for i, links, _ in want) for dim in (8, 3, 12))
    for i, links, comp in want:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, comp, i == comp)


# ---------------------------------------------------------------- language
def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op5_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 150
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures():
    rng = np.random.default_rng(1)
    prob = rng.dirichlet(np.full(language_id.N_GRAMS, 0.05), size=4) + 1e-9
    prob /= prob.sum(axis=1, keepdims=True)
    true = np.array([[1, 0, 0, 0], [0.7, 0, 0.3, 0], [0, 0.2, 0.2, 0.6]])
    counts = np.stack([rng.multinomial(3000, t @ prob / (t @ prob).sum()) for t in true]).astype(np.float32)
    best, share = language_id.infer(counts, np.log(prob))
    assert best.tolist() == [0, 0, 3] and share[0] == 1 and abs(share[1] - 0.7) < 0.04 and abs(share[2] - 0.6) < 0.05


# ---------------------------------------------------------------- mixing
def test_raked_marginals(spark):
    rng = random.Random(2)
    rows = [(f"s{a}", f"l{b}", f"t{c}", float(rng.randint(1, 10_000))) for a in range(6) for b in range(3) for c in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    given = {"l0": 0.5, "l1": 0.3, "l2": 0.2}
    out = mixing.rake(cells, {"source": 0.5, "lang": given, "topic": 0.0})
    p = {(r.source, r.lang, r.topic): r.probability for r in mixing.probabilities(out, 0.4).collect()}
    out = out.collect()
    for lang, share in given.items():
        assert abs(sum(r.weight for r in out if r.lang == lang) - share) < 1e-8
    for t in ("t0", "t1", "t2"):
        assert abs(sum(r.weight for r in out if r.topic == t) - 1 / 3) < 1e-8
    raw = {s: sum(r.tokens for r in out if r.source == s) ** 0.5 for s in {r.source for r in out}}
    for s in raw:
        assert abs(sum(r.weight for r in out if r.source == s) - raw[s] / sum(raw.values())) < 1e-8
    total = sum(r.tokens for r in out)
    assert abs(sum(r.tokens * p[r.source, r.lang, r.topic] for r in out) / total - 0.4) < 1e-9
    assert max(p.values()) <= 1 and min(p.values()) > 0


def test_raking_goes_on_until_the_targets_are_met(spark):
    """A nearly separable table, which a dozen rounds leave far from its targets."""
    rows = [("a", "x", "t", 100.0), ("b", "y", "t", 100.0), ("a", "y", "t", 1.0), ("b", "x", "t", 1.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    out = mixing.rake(cells, {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.6, "y": 0.4}, "topic": 0.0}).collect()
    for column, key, share in ((0, "a", 0.7), (0, "b", 0.3), (1, "x", 0.6), (1, "y", 0.4)):
        assert abs(sum(r.weight for r in out if r[column] == key) - share) < 1e-8


def test_raking_ends_where_targets_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5.0), ("b", "x", "t", 7.0)], "source string, lang string, topic string, tokens double")
    out = mixing.rake(cells, {"source": 0.5, "lang": {"x": 0.5, "z": 0.5}, "topic": 0.0}).collect()
    assert all(r.weight > 0 for r in out)


def test_more_languages_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    rows = [(i, f"{chr(97 + i % 7) * 3} " * (40 - i % 7), f"l{i % 7}") for i in range(40) if i % 4 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, log_prob = language_id.learn(docs)
    taught = {}
    for r in rows:
        if not (__import__("zlib").crc32(str(r[0]).encode()) % 4 == 2):
            taught[r[2]] = taught.get(r[2], 0) + len(r[1].replace(" ", ""))
    assert langs == sorted(sorted(taught, key=lambda k: (-taught[k], k))[:3]) and log_prob.shape[0] == 3
    out = language_id.identify(docs).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out} <= set(langs)


def slow_infer(counts, prob):
    """The set search of one document by plain loops and a long EM."""
    def em(allowed):
        share = np.array([a / sum(allowed) for a in allowed], dtype=float)
        for _ in range(language_id.ROUNDS):
            new = np.zeros(len(share))
            for g, c in enumerate(counts):
                if c:
                    mix = sum(share[k] * prob[k][g] for k in range(len(share)))
                    for k in range(len(share)):
                        new[k] += c * share[k] * prob[k][g] / mix
            share = new / counts.sum()
        like = sum(c * np.log(sum(share[k] * prob[k][g] for k in range(len(share)))) for g, c in enumerate(counts) if c)
        return share, like

    single = [sum(c * np.log(prob[k][g]) for g, c in enumerate(counts) if c) for k in range(len(prob))]
    best, score, like = int(np.argmax(single)), 1.0, max(single)
    order = np.argsort(-em([1] * len(prob))[0], kind="stable")
    for k in range(2, len(prob) + 1):
        share, now = em([int(i in order[:k]) for i in range(len(prob))])
        if now - like <= language_id.PENALTY * np.log(counts.sum() + 1):
            break
        best, score, like = int(np.argmax(share)), float(share.max()), now
    return best, score


def test_inference_equals_plain_loops():
    rng = np.random.default_rng(8)
    prob = rng.dirichlet(np.full(40, 0.3), size=4) + 1e-6
    prob /= prob.sum(axis=1, keepdims=True)
    mixes = rng.dirichlet([0.5] * 4, size=12)
    counts = np.stack([rng.multinomial(400, m @ prob / (m @ prob).sum()) for m in mixes]).astype(np.float64)
    best, score = language_id.infer(counts, np.log(prob))
    for i, c in enumerate(counts):
        b, s = slow_infer(c, prob)
        assert (best[i], score[i]) == (b, pytest.approx(s, abs=1e-6)) or abs(s - score[i]) < 1e-6


def test_components_of_stars_and_chains(spark, monkeypatch):
    from wearline.llm import components as comp
    monkeypatch.setattr(comp, "HOT", 3)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(50)] + [(500, 399), (7, 7), (2000, 2001), (2001, 2000)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in [*range(1, 400), 500]} | {1001 + i: 1000 for i in range(50)} | {2001: 2000}
    assert got == want
    assert comp.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- secrets
def slow_base(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "paſſword", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOPQ12", "0af3" * 7,
             "abcdef", "x", "\n", "é", "short", "K", "_", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == slow_base(text)


def planted(n, seed):
    rng = random.Random(seed)
    plain = ["the", "river", "runs", "under", "old", "bridges.", "Nobody", "counts", "12", "boats,", "though"]
    chains, texts = [], []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        words.insert(rng.randint(0, 40), rng.choice([f"password={rng.getrandbits(80):x}", f'token = "{rng.getrandbits(160):040x}"',
                                                      "AKIA" + "".join(rng.choices("ABCDEFGH234567", k=16)), "room 101"]))
        texts.append(" ".join(words))
        runs, whole = secrets.regions(texts[-1])
        spans = secrets.base_spans(texts[-1])
        chains += [(secrets.chain_features(texts[-1], w, whole), secrets.gold(w, spans)) for w in runs]
    return texts, chains


def test_crf_on_held_out_texts():
    _, train = planted(300, 1)
    model = secrets.Chain.fit(train)
    _, test = planted(200, 2)
    tags = [(t, g) for f, gold in test for t, g in zip(model.decode(f), gold)]
    right = sum(t == g for t, g in tags if g)
    assert right / sum(g > 0 for _, g in tags) > 0.95
    assert sum(t > 0 for t, g in tags if not g) / len(tags) < 0.01
    # a secret that the fixed patterns miss, in the place where one would stand
    text = "the river passphrase= x token = k runs under pwd password={b7db7aa4a5fcc78305} bridges."
    assert not [s for s in secrets.base_spans(text)]
    assert any(k == "crf" and "b7db7aa4a5fcc78305" in text[a:b] for k, a, b in secrets.scan(text, model))


def test_viterbi_and_whole_text_decoding():
    texts, train = planted(60, 3)
    model = secrets.Chain.fit(train)
    for feats, _ in train[:20]:
        feats = feats[:6]
        tags = model.decode(feats)

        def score(path):
            s = model.FIRST[path[0]] + model.step[path[-1], 0]
            s += sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return s + sum(model.emit[[model.names.get(x, len(model.names)) for x in f], t].sum() for f, t in zip(feats, path))

        assert abs(score(tags) - max(map(score, itertools.product(range(3), repeat=len(feats))))) < 1e-9
    for text in texts:
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        runs, whole = secrets.regions(text)
        near = {w: t for r in runs for w, t in zip(r, model.decode(secrets.chain_features(text, r, whole)))}
        assert [near.get(w, 0) for w in words] == model.decode(secrets.chain_features(text, words, whole))


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(secrets, "TRAIN_DOCS", 50)
    rows = [(None if i % 3 else i, f"text {i} token={i:08d}") for i in range(900)] + [(7, "copy token=12345678")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in secrets.sampled(df).collect()]
    assert len(got) == len(set(got)) == 50 and {i is None for i, _ in got} == {True, False}
    assert len(secrets.training_chains(df)) == 50
    monkeypatch.setattr(secrets, "TRAIN_CHAINS", 20)
    some = secrets.training_chains(df)
    assert len(some) == 20 and some == secrets.training_chains(df.repartition(5))
    assert secrets.sampled(df.limit(0)).count() == 0 and secrets.training_chains(df.limit(0)) == []


def test_chains_come_from_whole_texts(spark, monkeypatch):
    """Regions far into a text, and words far into a region, teach like the first ones."""
    long = " ".join(f"w{i} = {i}" for i in range(2000)) + " plain text without any mark " * 3
    apart = " plain words of prose, and more of them ".join(f"token={i:08d}" for i in range(300))
    df = spark.createDataFrame([(1, long), (2, apart)], "doc_id long, text string")
    chains = secrets.training_chains(df)
    regions = sum(-(-len(w) // secrets.REGION) for t in (long, apart) for w in secrets.regions(t)[0])
    assert len(chains) == regions > 400 and max(len(t) for _, _, t in chains) == secrets.REGION
    # the sum of slices is the gradient of all
    feats = [(f, t) for _, f, t in chains[:60]]
    whole = secrets.Chain.fit(feats)
    monkeypatch.setattr(secrets, "SLICE", 7)
    assert np.allclose(secrets.Chain.fit(feats).emit, whole.emit, atol=1e-6)


def test_key_words_beside_letters_that_change_length():
    for text in ("his password hunter was here", "\u0130 his password hunter was here", "\u0130x API_KEY y"):
        runs, _ = secrets.regions(text)
        marked = {text[a:b] for run in runs for a, b in run if secrets.is_marked(text[a:b])}
        assert marked == ({"password"} if "password" in text else {"API_KEY"})


def test_secrets_that_no_pattern_knows(spark):
    """Fitted on base spans, the chain finds secrets without key words, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rng = random.Random(4)
    found = total = extra = 0
    for r in docs.collect():
        words = (r.text or "").split(" ")
        extra += sum(k == "crf" for k, _, _ in secrets.scan(r.text or "", model))
        if 30 < len(words) < 2000:
            secret = rng.choice(["".join(rng.choices("ABCDEFGHabcdefgh0123456789", k=32)), f"{rng.getrandbits(160):040X}",
                                 "sk-" + "".join(rng.choices("abcdefghijkl0123456789", k=36))])
            i = rng.randint(1, len(words) - 1)
            text, at = " ".join(words[:i] + [secret] + words[i:]), len(" ".join(words[:i])) + 1
            total += 1
            found += any(a <= at and b >= at + len(secret) for _, a, b in secrets.scan(text, model))
    assert total > 300 and found > 0.6 * total and extra <= 0.01 * total


def test_secret_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op9_secret_scan"](spark, "/root/testdata/sf0.01").collect():
        base = slow_base(docs[r.doc_id])
        spans = [tuple(x.split(":")) for x in r.spans.split(",")] if r.spans else []
        assert [(k, int(a), int(b)) for k, a, b in spans if k != "crf"] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == s[0] for s in base) for k in ("assign", "access", "hex"))


# ---------------------------------------------------------------- pipeline
def test_pipeline_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows.append({r.doc_id: r for r in docs.collect()})
    start, lang, alone, clean, mixed, coded = rows
    assert set(start) == set(lang)  # every document of this table has a language
    fp = {i: simhash.fingerprint(r.text) for i, r in lang.items()}
    first = {}
    for i in sorted(fp):
        linked = {j for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2}
        first[i] = min(linked)
    while any(first[first[i]] != first[i] or any(first[j] != first[i] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2) for i in fp):
        first = {i: min(first[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2) for i in fp}
    assert set(alone) == set(first.values())
    assert set(clean) == set(alone)
    for i, r in clean.items():
        base = slow_base(alone[i].text)
        assert r.n_chars == len(r.text) and (base or r.text == alone[i].text or "[SECRET]" in r.text)
        assert not slow_base(r.text)
    cells = spark.createDataFrame([(i, r.text, r.lang, r.source) for i, r in clean.items()], "doc_id long, text string, lang string, source string")
    want = {r.doc_id for r in mixing.mix(cells, MIX_TARGETS, MIX_RATE).where("kept").collect()}
    assert set(mixed) == want and all(mixed[i] == clean[i] for i in want)
    lib = codec(tokenizer_path(WORD_MODEL)).lib
    assert {i: r.n_tokens for i, r in coded.items()} == {i: len(lib.encode(mixed[i].text, add_special_tokens=False).ids) for i in mixed}
    assert corpus_pipeline.run(spark, SF).count() == len(coded)
