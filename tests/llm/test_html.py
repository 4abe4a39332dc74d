import itertools
import math

from pointweave.llm import html as h

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>x";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies on this site to make it better.</p></div>
<article><h1>The   head &amp; line</h1><p>First para with <b>bold</b> and a<br>break, which is long enough to be read.<p>Second &lt;para&gt; &copy 2020 without an end
<ul><li>one thing<li>another thing</ul><form><p>Subscribe now</p><textarea>no</textarea></form></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I like this very much, thank you for writing it.</p></div></section>
<aside class="sidebar"><p>Other things to read</p></aside><footer>&copy; site</footer></body></html>"""
WANT = "The head & line\nFirst para with bold and a break, which is long enough to be read.\nSecond <para> © 2020 without an end\none thing\nanother thing"


def brute_force(model, page):
    """Marginals by enumeration."""
    total = [[0.0, 0.0] for _ in page.parent]
    for ys in itertools.product((0, 1), repeat=len(page.parent)):
        p = math.exp(model.root) if ys[0] else 1.0
        for i, y in enumerate(ys):
            p *= math.exp(model.node(page.tag[i], page.words[i])) if y else 1.0
            if i:
                p *= model.edge.get(page.tag[i], model.default)[ys[page.parent[i]]][y]
        for i, y in enumerate(ys):
            total[i][y] += p
    return [math.log(b / a) for a, b in total]


def test_page():
    assert h.trained().extract(PAGE) == WANT


def test_messages_equal_enumeration():
    model = h.trained()
    for html in ("<p>x</p>", "<div><p>one</p><ul><li><a>two</a></li></ul></div>", '<article class="post"><h1>a</h1><aside>b<p>c</p></aside></article>', "<foo>text</foo>", ""):
        page = h.Page(html)
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(model.marginals(page), brute_force(model, page), strict=True))


def test_held_out_pages():
    model, right, total = h.trained(), 0, 0
    for html in h.labelled_pages(150, seed=77):
        page = h.Page(html)
        for text, odds, label in zip(page.text, model.marginals(page), page.label):
            if text is not None:
                total += 1
                right += (odds >= 0) == bool(label)
    assert right >= 0.98 * total > 1000


def test_layouts_that_training_does_not_hold():
    """Each layout by hand: the text that has to come out, whatever stands around it."""
    a, b = "One two three, four five six seven eight nine ten.", "Some more text goes on here, longer than the first line of it was, and then ends."
    junk = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>', "<footer>&copy; some site</footer>"
    layouts = {
        f"<article><div>{a}</div></article>": a,
        f"<main><div>{b}</div></main>": b,
        f"<article><section><div><p>{a}</p><p>{b}</p></div></section></article>": f"{a}\n{b}",
        f"<p>{a}</p><p>{b}</p>": f"{a}\n{b}",
        f"<article>{a}<hr>{b}</article>": f"{a}\n{b}",
        f"<div><div><div><p>{b}</p><p>{a}</p></div></div></div>": f"{b}\n{a}",
        f'<div id="content">{a}<br>{b}</div>': f"{a} {b}",
        f"<main><article><h1>Head</h1><dl><dt>{a}</dt><dd>{b}</dd></dl></article></main>": f"Head\n{a}\n{b}",
    }
    for body, want in layouts.items():
        for before, after in (("", ""), junk):
            assert h.trained().extract(f"<html><body>{before}{body}{after}</body></html>") == want


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<article><p>" + "deep text that goes on and on. " * 20 + "</p></article>" + "</div>" * 3000
    long = "<article>" + "<p>para of words &amp; more words here</p>" * 20000 + "</article>"
    pages = [None, "", "just text without any markup, but rather long so that it reads well", "<", "<article><p>a < b and c > d</p></article>", '<article><p class="x>broken</p></article>', "<script>never ends", "<!-- never ends", "</p></div>", deep, long, PAGE, "<article><p>x" + "\x00� é\U0001f600</p>"]
    rows = [(i // 2, None if i % 3 else "u", p, "clash", "") for i, p in enumerate(pages * 2)]
    got = h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = [r.text for r in got]
    assert texts.count("") >= 2 and texts.count(WANT) == 2 and "a < b and c > d" in texts
    assert texts.count("\n".join(["para of words & more words here"] * 20000)) == 2
    assert h.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
