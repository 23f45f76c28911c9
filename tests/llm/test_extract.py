"""HTML extraction: the network's gradient, held-out accuracy on layouts it hasn't seen, and awkward pages."""

import random

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F

from tessera.llm import blstm, extract, layouts

DDL = "page_id long, url string, html string"


def prose(r, n=12):
    return " ".join("".join(r.choice("aeiou") + r.choice("bdklmnrst") for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def plain_page(r):
    body = [prose(r, r.randint(4, 40)) for _ in range(r.randint(1, 9))]
    menu = "".join(f'<li><a href="/{i}">{prose(r, 1)}</a></li>' for i in range(4))
    return f'<html><head><title>{body[0]}</title></head><body><nav><ul>{menu}</ul></nav><div class="ad">{prose(r)}</div><article><h1>{body[0]}</h1>' + "".join(f"<p>{x}</p>" for x in body[1:]) + f"</article><footer>&copy; {prose(r, 3)}</footer></body></html>", "\n".join(body)


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, f"u{i}", plain_page(r)[0]) for i in range(80)]
    return extract.fit(spark.createDataFrame([*rows, *rows[:40], (None, None, None)], DDL))


def test_gradient_is_that_of_the_loss(monkeypatch):
    r = random.Random(3)
    slots = layouts.Slots()
    pages = [layouts.features(layouts.blocks(plain_page(r)[0]), slots) for _ in range(3)]
    labels = [np.array([r.random() < 0.5 for _ in p[1]], np.float32) for p in pages]
    p = {k: v.astype(np.float64) for k, v in blstm.start(2).items()}
    grad, _ = blstm._gradients(p, pages, labels)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        losses = []
        for step in (1e-3, -1e-3):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += step
            losses.append(blstm._gradients(q, pages, labels)[1])
        assert abs((losses[0] - losses[1]) / 2e-3 - grad[k][at]) < 0.02 * abs(grad[k][at]) + 1e-4, k


def test_pages_that_were_not_learned_from(model):
    r, slots = random.Random(99), layouts.Slots()
    pages = [plain_page(r) for _ in range(200)]
    got = extract.article_texts(model, [p for p, _ in pages], slots)
    assert sum(g == w for g, (_, w) in zip(got, pages)) >= 198


def test_layouts_that_were_not_learned_from(model):
    slots, right, n = layouts.Slots(), 0, 300
    for k in range(n):
        r = random.Random(10**6 + k)
        html = layouts.rendered(r, [prose(r, r.randint(3, 40)) for _ in range(r.randint(2, 12))], [prose(r) for _ in range(9)])
        want = "\n".join(t.replace(layouts.MARK, "") for _, t, _ in layouts.blocks(html) if layouts.MARK in t)
        right += extract.article_texts(model, [html.replace(layouts.MARK, "")], slots)[0] == want
    assert right >= 0.93 * n


def test_a_page_in_words(model):
    html = """<html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body><header><h1>The Daily</h1><nav><a href=/>Home</a> <a href=/b>Sport</a></nav></header>
    <div class="cookie-notice">We use cookies to make this site better.</div><main><article><h1>Big &amp; new</h1><p>One <b>two</b>
    three,&nbsp;four&#46; <!-- no --><p>Second part &lt;here&gt;, with words.<div class="ad">Buy it now for less.</div></article></main>
    <section class="comments"><h2>Comments</h2><p>I liked this text a lot.</p></section><footer>&copy; 2020"""
    assert extract.article_texts(model, [html], layouts.Slots()) == ["Big & new\nOne two three, four.\nSecond part <here>, with words."]


def test_blocks_of_broken_html():
    texts = lambda h: [t for _, t, _ in layouts.blocks(h)]
    assert texts("<p>a<b>b<p>c</b>d</p></div>e<br>f<li>g<li>h<style>p{}</style>i") == ["ab", "cd", "e", "f", "g", "hi"]
    assert texts("") == texts("<!-- x -->") == texts("<div><script>1</script></div>") == [] and texts("a & b &lt; &#x41;") == ["a & b < A"]
    deep = "<div class='x'>" * 3000 + "in" + "</div>" * 2000 + "out"
    assert texts(deep) == ["in", "out"]


def test_awkward_rows(spark, model):
    r = random.Random(5)
    html, text = plain_page(r)
    long = html.replace("</article>", "".join(f"<p>{prose(r, 30)}</p>" for _ in range(3000)) + "</article>")
    docs = spark.createDataFrame([(1, "u", html), (1, "u", html), (None, None, None), (2, "u", ""), (3, None, long), (4, "u", "no markup at all")], DDL)
    for c in ("text", "n_chars", "own", "model"):
        docs = docs.withColumn(c, F.lit("x"))
    got = extract.main_texts(docs, model=model).collect()
    assert [x.text for x in got if x.page_id == 1] == [text, text] and all(x.n_chars == len(x.text) for x in got)
    assert next(x for x in got if x.page_id is None).text == next(x for x in got if x.page_id == 2).text == ""
    assert next(x for x in got if x.page_id == 3).text.count("\n") == text.count("\n") + 3000
    assert extract.main_texts(spark.createDataFrame([], DDL), model=model).count() == 0


def test_an_empty_table_and_pages_without_prose(spark):
    monkey = extract.RENDERED
    extract.RENDERED = 1
    try:
        assert extract.lessons([])[0] and extract.lessons(["<p>x"])[0]
    finally:
        extract.RENDERED = monkey
    assert extract.main_texts(spark.createDataFrame([], DDL)).count() == 0
