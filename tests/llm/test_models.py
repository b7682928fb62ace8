import itertools
import random

import numpy as np
import pytest

from caseloom.llm import page_text as pt, toxicity as tx


@pytest.fixture(scope="module")
def model():
    return pt.train()


def truth(html):
    page = pt.Page(html)
    return " ".join(t for n, t in page.blocks if page.nodes[n].label == 1)


def test_messages_match_enumeration():
    r = np.random.default_rng(0)
    for n in (1, 2, 6):
        parents = [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        u, pair = r.standard_normal((n, 2)), r.standard_normal((2, 2))
        p, z, e = np.zeros(n), 0.0, np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(u[i, y[i]] for i in range(n)) + sum(pair[y[parents[i]], y[i]] for i in range(1, n)))
            z += w
            p += w * np.array(y)
            for i in range(1, n):
                e[i, y[parents[i]], y[i]] += w
        got, edge = pt.marginals(parents, u, pair)
        assert np.allclose(got, p / z) and np.allclose(edge, e / z)


def test_unseen_labelled_pages(model):
    good = total = 0
    for seed in range(900_000, 900_150):
        html = pt.labelled_page(seed)
        page = pt.Page(html)
        p = model.content(page)
        for n, t in page.blocks:
            total += len(t)
            good += len(t) * ((p[n] > 0.5) == (page.nodes[n].label == 1))
    assert good / total > 0.98


def test_page_edges(model, spark):
    html = ("<html><head><title>x</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home page</a></li></ul></nav>"
            "<article><h1>Caf&eacute;  &amp; co</h1><p><b>One\n two, three and four.<br><p>Next &lt;b&gt; line of text, with words.</p></article>"
            "<footer>&copy; somebody</footer></body></html>")
    assert model.extract(html) == "Café & co One two, three and four. Next <b> line of text, with words."
    df = spark.createDataFrame([(1, "u", html, "c"), (2, None, None, "c"), (None, "v", "", None), (4, "w", "<script>x</script>", ""), (1, "u", html, "c")],
                               "page_id long, url string, html string, text string")
    got = pt.extract_pages(df, model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(model.extract(html))), (1, len(model.extract(html))), (2, 0), (4, 0)]
    assert pt.extract_pages(df.limit(0), model).count() == 0


def test_omitted_end_tags(spark):
    def blocks(html):
        return [t for _, t in pt.Page(html).blocks]

    for head in ("<head>", "<head></head>", "<head><title>x</title><noscript><img>y</noscript><style>p{}</style><meta a=b>"):
        assert blocks(f"<html>{head}<body><p>One.</p><p>Two.</p>") == ["One.", "Two."]
        assert blocks(f"{head}<p>One.") == blocks(f"{head}One.") == ["One."]
    for options in ("<option value=a><option value=b>", "<option>a<optgroup label=x><option><div>b</div> c", "<option>a</option><option><b>b</b>"):
        assert blocks(f"<body><p>One.</p><datalist>{options}</datalist><p>Two.</p>") == ["One.", "Two."]
        assert blocks(f"<div><p>One.</p><select>{options}</select><p>Two.</p></div>") == ["One.", "Two."]


def test_toxicity(spark):
    r = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nt", "rst", "ll", "sk")]
    bad = ["idiot", "moron", "worthless", "disgusting"]

    def text(toxic):
        w = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        for _ in range(toxic * r.randint(2, 5)):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", ".", ","]))
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(1000, None, ""), (1001, "", ""), (None, "x", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.score_toxicity(docs, labels).collect()}
    assert len(got) == 403 and all(got[i].held_out == tx.in_test_fold(i) for i, *_ in rows)
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.95
    assert 0 <= got[1000].score == got[1001].score < 0.5
    assert tx.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_draws_long_texts_whole(spark):
    long = "calm words here " * 20000 + "idiot"
    docs = spark.createDataFrame([(1, long, "clash"), (2, "good day", ""), (2, "good day", ""), (3, None, ""), (4, "never labelled", ""), (6, "x" * 50000, "")],
                                 "doc_id long, text string, y string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (6, 0), (6, 1), (99, 1)], "doc_id long, toxic int")
    keep = [d for d in (1, 2, 3, 6) if not tx.in_test_fold(d)]
    want = {(t, y) for d, t, y in ((1, long, 1), (2, "good day", 0), (3, "", 0), (6, "x" * 50000, 1)) if d in keep}
    assert set(tx.training_sample(docs, labels)) == want and 1 in keep and len(keep) > 2
    model = tx.train([(f"calm words here you idiot {i} go on", 1) for i in range(20)] + [(f"calm words here all day {i} go on", 0) for i in range(20)])
    assert model.score(long) > 0.8 > model.score(long[:-5]) and 0 <= model.score("x" * 100000) <= 1  # the last word of a long text
    assert model.score("you 1diot!") > 0.9 > model.score("all day")  # a misspelling that the sample does not hold


def test_grams_of_many_words_at_once():
    ws = ["", "a", "hate", "aaaaaaaa", "naïve,", "日本語テキスト", "a😀b😀c", "(word)", "߿ࠀ￿𐀀", "x" * 40]
    bucket, place = tx.bags(ws)
    assert [sorted(bucket[place == i].tolist()) for i in range(len(ws))] == [tx.grams(w) for w in ws]
    r = np.random.default_rng(0)
    model = tx.Model(r.standard_normal((tx.BUCKETS, tx.DIM)), r.standard_normal((tx.DIM, 2)), np.zeros(2), (1.0, 0.0))
    texts = ["", "one two", " ".join(ws * 3), "hate"]
    assert np.allclose([model.word(w) for w in ws], [model.per_gram[tx.grams(w)].mean() for w in ws], atol=1e-12)
    assert model.scores(texts) == [model.score(t) for t in texts] and model.scores([]) == []
