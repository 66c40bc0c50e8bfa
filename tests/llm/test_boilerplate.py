"""Main texts: blocks of single pages, repeats against brute force over whole streams, and the query."""

import re
from html import unescape

import numpy as np
import pytest

from serospark.llm import boilerplate, queries
from serospark.llm.boilerplate import ARTICLE, CHROME, NEUTRAL, blocks

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("html, want", [
    ("", []),
    ("just text &amp; more", [(NEUTRAL, "just text & more")]),
    ("<p>one<p>two<br>three</p>f<b>o</b>ur", [(NEUTRAL, "one"), (NEUTRAL, "two three"), (NEUTRAL, "four")]),
    ("<nav><ul><li>a<li>b</ul></nav><p>c", [(CHROME, "a"), (CHROME, "b"), (NEUTRAL, "c")]),
    ("<article><h1>T&eacute;</h1><p>a &lt;b&gt; &#x41;</p><aside>no</aside>b</article>", [(ARTICLE, "Té"), (ARTICLE, "a <b> A"), (CHROME, "no"), (ARTICLE, "b")]),
    ("<div class='site-header'>x</div><div role=main>y</div><div id=cookieNotice>z</div>", [(CHROME, "x"), (ARTICLE, "y"), (CHROME, "z")]),
    ("<script>var a='</p><p>no'</script><!-- <p>no --><style>p{}</style><p>yes", [(NEUTRAL, "yes")]),
    ("<form><p>no</p><article>in a form</article><input></form>", [(CHROME, "no"), (ARTICLE, "in a form")]),
    ("<main>a<article class='comment'>no</article><section id=comments><p>no</p></section></main>", [(ARTICLE, "a"), (CHROME, "no"), (CHROME, "no")]),
    ("<p class=ad>no<p>yes", [(CHROME, "no"), (NEUTRAL, "yes")]),
    ("<article>a <span class='share'>no</span> b", [(ARTICLE, "a"), (CHROME, "no"), (ARTICLE, "b")]),
    ("<head><title>no</title><body class='post single'>x\xa0 y\n\tz", [(NEUTRAL, "x y z")]),
    ("<div><p>a</div></div></p>b<", [(NEUTRAL, "a"), (NEUTRAL, "b<")]),
    ("<p title='a > b' hidden>c<p broken='d", [(NEUTRAL, "c")]),
])
def test_blocks(html, want):
    assert blocks(html) == want


def brute(pages, length=boilerplate.LENGTH):
    """Texts of ``(host, html)`` by comparing every run of tokens of one page to those of all others of its host."""
    streams = []
    for host, html in pages:
        stretches, own = [], []
        for zone, text in [*blocks(html), (ARTICLE, "")]:
            if zone == ARTICLE:
                stretches += [["^", *own, "$"]] if own else []
                own = []
            else:
                own += text.split(" ")
        streams.append((host, html, stretches))
    runs = lambda s: [tuple(s[i:i + length]) for i in range(max(1, len(s) - length + 1))]
    made = []
    for host, html, stretches in streams:
        others = {r for h, t, ss in streams if h == host and t != html for s in ss for r in runs(s)}
        over = []
        for s in stretches:
            hit = [False] * len(s)
            for i, r in enumerate(runs(s)):
                if r in others:
                    hit[i:i + length] = [True] * len(hit[i:i + length])
            over += hit[1:-1]
        kept, read = [], blocks(html)
        for zone, text in read:
            n = len(text.split(" "))
            if zone == ARTICLE:
                kept.append(text)
                continue
            if zone == NEUTRAL and 2 * sum(over[:n]) < n:
                kept.append(text)
            over = over[n:]
        made.append(" ".join(kept or [t for z, t in read if z == NEUTRAL]))
    return made


def words(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def site():
    """Pages of two hosts without useful class names: menus, notices and passages that repeat on some pages only."""
    rng = np.random.default_rng(4)
    menu, notice, passage = (f"<div>{words(rng, 3)}</div><div>{words(rng, 4)}</div>", f"<div>{words(rng, 20)}</div>", words(rng, 60))
    pages = []
    for i in range(60):
        body = "".join(f"<p>{words(rng, int(rng.integers(1, 40)))}</p>" for _ in range(int(rng.integers(1, 6))))
        body += f"<p>{passage} {words(rng, 5)}</p>" if i % 7 == 0 else ""
        if i % 3 == 0:
            body = f"<article><p>{passage}</p>{body}</article>"
        pages.append((f"h{i % 2}.example.com", menu + body + (notice if i % 4 else "")))
    return [*pages, pages[0], pages[5], ("h0.example.com", ""), ("h9.example.com", menu + notice)]


def test_repeats_against_brute_force(spark, site):
    rows = [(i, f"http://{h}/x", html) for i, (h, html) in enumerate(site)]
    found = boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    want = brute(site)
    assert {r["page_id"]: r["text"] for r in found} == dict(enumerate(want))
    assert any(r["n_repeated"] for r in found) and not any("w" not in t for t in want[:60])


def test_edges(spark):
    kind = "page_id long, url string, html string, key long, page string, text string, keys int"
    long = "<p>" + "lorem " * 200_000
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "x", None), (2, "http://h/", ""), (3, "http://h/", long), (None, "http://h/", "<nav>only</nav>")]
    data = spark.createDataFrame([(*r, 1, "p", "t", 2) for r in rows], kind)
    found = sorted((str(r["page_id"]), r["text"][:20], len(r["text"])) for r in boilerplate.extract(data).collect())
    assert found == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("3", "lorem lorem lorem lo", 1_199_999), ("None", "", 0), ("None", "", 0)]
    assert boilerplate.extract(data.limit(0)).collect() == []


def test_query_against_articles(spark):
    """In these pages all text of the article, and nothing else, is wanted."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    want = {}
    for r in pages:
        inside = re.search(r"(?s)<article>(.*?)</article>", r["html"] or "")
        text = re.sub(r"<[^>]*>", lambda t: "" if t[0] in ("<b>", "</b>") else " ", inside[1] if inside else "")
        want[r["page_id"]] = (r["url"], " ".join(unescape(text).split()))
    rows = queries.QUERIES["op11_html_extraction"](spark, SF_DIR).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in rows} == want and len(rows) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
