import itertools
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from tesserae.llm.html import blocks, content_blocks, costs, edges, main_text, minimum_cut


def test_cut_is_the_least_labelling():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 8)
        a, b = ([rng.uniform(0, 3) for _ in range(n)] for _ in range(2))
        links = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda x: sum(b[i] if x[i] else a[i] for i in range(n)) + sum(w for i, j, w in links if x[i] != x[j])  # noqa: B023, E731
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(minimum_cut(np.array(a), np.array(b), links)) - best) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header"><a href="/">Home</a> The site</header><nav><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></nav>
<!-- ad 1 --><div class="ad">Buy this now, it is cheap. Really cheap, today only.</div><div id="cookie-notice">We use cookies on this site. Accept them all.</div>
<article><h1>A title &amp; more</h1><p><b>First paragraph, with   a
break<br>and &eacute;ntities &lt;kept&gt;.</p><p>Ok.</p><ul><li>An item of the article itself.</li></ul><p>Last paragraph of the text, it is longer than others.<aside>Read next: something else entirely.</aside></article>
<form><label>Name</label><input value="x"><button>Send it</button></form><div class="comments"><p>I liked this text a lot, thank you for it.</p></div>
<footer>&copy; 2020 &middot; Somebody. All rights reserved.</footer></body></html>"""


def test_article_only():
    assert content_blocks(PAGE) == ["A title & more", "First paragraph, with a break and éntities <kept>.", "Ok.", "An item of the article itself.", "Last paragraph of the text, it is longer than others."]


def test_pages_without_markup_hints():
    page = "<body><div><a href=x>Home</a> | <a href=y>News</a></div><div><p>" + "A long paragraph of plain text, with commas. " * 6 + "</p><p>" + "Another one follows it here. " * 5 + "</p></div></body>"
    assert [t[:6] for t in content_blocks(page)] == ["A long", "Anothe"]


def test_odd_markup():
    assert [b.text for b in blocks("<p>a<p>b</i></p>c<td>d&#x41;&bogus;<!-- never closed")] == ["a", "b", "c", "dA&bogus;"]
    assert blocks("<script>never closed <p>x</p>") == [] and blocks("") == [] and blocks("a < b")[0].text == "a < b"


def test_frames(spark):
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", "<article><p>" + "word and word. " * 50_000 + "</p></article>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = main_text(df).collect()
    assert len(got) == 5 and {r.page_id: r.n_chars for r in got}[2] == 0 and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 15 * 50_000 - 1
    assert main_text(df.limit(0)).count() == 0


def test_every_page_keeps_its_article(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert content_blocks(r.html) == [b.text for b in blocks(inner)], r.page_id
        assert re.sub(r"\s+", " ", "".join(content_blocks(r.html)))


def pages():
    return [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if h and "<article>" in h]


def f1(strip):
    """F1 of blocks against <article> by the classifier alone and by the cut, and how many labels the cut changes."""
    hits, changed = np.zeros((2, 3)), 0
    for h in pages():
        at, end = h.index("<article>") + 9, h.index("</article>")
        n, k = len(blocks(strip(h[: at - 9]))), len(blocks(strip(h[at:end])))
        found = blocks(strip(h))
        truth = np.zeros(len(found), bool)
        truth[n : n + k] = True
        as_content, as_boilerplate = costs(found)
        both = as_content < as_boilerplate, minimum_cut(as_boilerplate, as_content, edges(found))
        changed += int((both[0] != both[1]).sum())
        hits += [[(x & truth).sum(), (x & ~truth).sum(), (~x & truth).sum()] for x in both]
    return [float(2 * t / (2 * t + p + n)) for t, p, n in hits], changed


NO_NAMES = re.compile(r'\s(?:class|id|role)="[^"]*"')
ELEMENTS = re.compile(r"<(/?)(?:nav|article|footer|header|aside|main|section)\b")


@pytest.mark.parametrize(("strip", "least"), [(lambda h: h, 1.0), (lambda h: NO_NAMES.sub("", h), 0.97), (lambda h: ELEMENTS.sub(r"<\1div", NO_NAMES.sub("", h)), 0.9)], ids=["as they are", "no names", "no names, no elements"])
def test_cut_decides(strip, least):
    (alone, cut), changed = f1(strip)
    assert changed > 0 and cut > alone and cut >= least


def test_small_pages_by_brute_force():
    """Of all labellings of a page's blocks the cut's costs least, and it is the text that comes out."""
    done = 0
    for h in [*pages()[:120], PAGE]:
        found = blocks(h)
        if not 2 <= len(found) <= 14:
            continue
        as_content, as_boilerplate = costs(found)
        links = edges(found)
        cost = lambda x: sum(as_content[i] if k else as_boilerplate[i] for i, k in enumerate(x)) + sum(w for a, b, w in links if x[a] != x[b])  # noqa: B023, E731
        best = min(itertools.product([False, True], repeat=len(found)), key=cost)
        assert content_blocks(h) == [b.text for b, k in zip(found, best, strict=True) if k]
        done += 1
    assert done > 20


def test_hostile_pages_take_linear_time():
    mixed = "".join(f"<p>{'A long sentence of text, it goes on. ' * 6}</p><ul><li><a href=x>menu</a></li></ul>" for _ in range(25_000))
    hostile = ["<a " * 340_000, '<a "> "' * 150_000, '<a ">x' * 160_000, "<div>x" * 60_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<![CDATA[" * 100_000, "<!--" * 250_000, "<script>" * 100_000, "<p>x" * 100_000, mixed]
    for page in hostile:
        began = time.perf_counter()
        content_blocks(page)
        assert time.perf_counter() - began < 10, page[:20]
    assert len(blocks(mixed)) == 50_000
    assert blocks("<div>" * 3000 + "deep")[0].depth == 3000 and [b.text for b in blocks("<p>a</p>" + "<a " * 10)] == ["a", "<a " * 9 + "<a"]
