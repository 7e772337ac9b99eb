from __future__ import annotations

from itertools import product

import numpy as np

from evalspark.llm import extract as X


def texts(page):
    return [b.text for b in X.blocks(page)]


def test_blocks_of_broken_markup():
    assert texts(None) == texts("") == texts("<p> </p><script>x</script>") == []
    assert texts('<script>var t="</p>";</script><p>a<b>b</b> &amp; c<br>d<p>e</div></article>f') == ["ab & c d", "e", "f"]
    assert texts("<!-- <p>no</p> --><ul><li>a<li>b</ul>3 < 4 <3 <a title='>'>t</a><![CDATA[x]]>") == ["a", "b", "3 < 4 <3 t"]
    assert texts("<div>a<style>p{}</style>b<textarea><p>no</textarea><p>c</p>d</div><!-- open") == ["ab", "c", "d"]
    assert texts("<p>&eacute;&#233;&#xe9;&nbsp;x&unknown;\n\n y") == ["ééé x&unknown; y"]
    assert texts("<title>no</title>plain") == ["plain"]
    assert texts("<script>never closed <p>x") == []
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000 + "</x>" * 3000) == ["deep"]
    assert texts('<a href="never closed>x</a><p>y</p>')[-1] == "y"
    assert len(texts("<p>" + "word " * 200_000)[0]) == 999_999


def test_viterbi_equals_enumeration():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        weights = {f: tuple(rnd.normal(size=2)) for f in "abcde"}
        field = X.Field(weights, rnd.normal(size=(2, 2)))
        page = [list(rnd.choice(list("abcdez"), 3)) for _ in range(rnd.integers(1, 8))]

        def score(y, page=page, field=field, weights=weights):
            s = sum(weights.get(f, (0, 0))[k] for fs, k in zip(page, y, strict=True) for f in fs)
            return s + sum(field.moves[a][b] for a, b in zip(y, y[1:], strict=False))
        best = max(product((0, 1), repeat=len(page)), key=score)
        assert abs(score(field.decode(page)) - score(best)) < 1e-9


def test_training_raises_the_likelihood_of_the_labels():
    pages = [([["x"], ["y"], ["x"]], [1, 0, 1]), ([["y"], ["y"]], [0, 0]), ([["x"]], [1])]
    field = X.train(pages)
    assert [field.decode(x) for x, _ in pages] == [y for _, y in pages]


def test_held_out_accuracy():
    field = X.default_field()
    good = total = 0
    for page, labels in X.labelled_pages(150, seed=77):
        found = X.blocks(page)
        assert len(found) == len(labels)
        got = field.decode(X.features(found))
        good += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert good / total > 0.98


def test_extract_rows(spark):
    page = ('<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy it now.</div>'
            "<article><h1>Head line</h1><p>First part of it, as told.</p><p><b>Unclosed one here.<br></article>"
            "<div class='comments'><p>I liked this very much.</p></div><footer>&copy; host</footer></body></html>")
    rows = [(1, "u", page, "x", 2), (1, "u", page, "x", 2), (2, None, None, None, None), (None, "v", "", "y", 1), (3, "w", "<nav>no</nav>", "z", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = X.extract(df).collect()
    want = "Head line\nFirst part of it, as told.\nUnclosed one here."
    assert sorted((str(r["page_id"]), r["url"], r["text"]) for r in got) == sorted(
        [("1", "u", want), ("1", "u", want), ("2", None, ""), ("None", "v", ""), ("3", "w", "")], key=lambda x: (x[0], str(x[1])))
    assert X.extract(df.limit(0)).count() == 0


def test_the_given_pages(spark):
    """Every block of the article, and nothing else, by a plain pattern."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in X.extract(pages).collect()}
    for r in pages.collect():
        a = re.sub(r"</?(?:h1|p)[^>]*>", "\n", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        a = re.sub("<[^>]*>", "", a.replace("<br>", " "))
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in a.split("\n")) if x)


def test_formulas_and_fallback_text_are_text_of_the_page():
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p>") == ["Let x=1 be so."]
    assert texts('<p>A <svg><path d="M0"/><title>no</title><text>label</text></svg> b</p><p>c</p>') == ["A label b", "c"]
    assert [("t:math" in b.marks, b.text) for b in X.blocks("<p>a <math><mi>x</mi></math></p><p>b</p>")] == [(True, "a x"), (False, "b")]
    for tag in ("object", "canvas", "audio", "video", "noscript"):
        assert texts(f"<p>a</p><{tag}><p>b</p>c</{tag}><p>d</p>") == ["a", "b", "c", "d"]
        assert "t:" + tag in X.blocks(f"<{tag}>x</{tag}>")[0].marks
    for tag in ("object", "canvas", "audio", "video", "noscript", "svg", "math"):
        assert texts(f"<article><p>a</p><{tag}><p>b</p><p>c</p></article><p>d</p>") == ["a", "b", "c", "d"]  # never closed
    for tag in ("script", "style", "textarea", "iframe", "template"):
        assert texts(f"<p>a</p><{tag}><p>b</p></{tag}><p>d</p>") == ["a", "d"]


def test_the_field_decides_on_fallback_text():
    field = X.default_field()
    for tag in ("object", "canvas", "audio", "video", "noscript", "svg", "math"):
        page = (f"<body><nav><ul><li><a href=/a>Home</a></li></ul><{tag}>Menu</{tag}></nav><article><h1>Head line</h1><p>First part of it, as told.</p>"
                f"<{tag}>Second part, as the fallback tells it.</{tag}><p>Third part of it, as told.</p></article><footer>&copy; host</footer></body>")
        assert X.main_text(page, field).split("\n") == [
            "Head line", "First part of it, as told.", "Second part, as the fallback tells it.", "Third part of it, as told."], tag
