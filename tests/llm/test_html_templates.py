import collections
import random
import re

from strandwise.llm.html_templates import extract, extracted, subtree_hashes

NAV = "<nav><ul><li>Home<li><a href='/x'>Über  uns</a></ul></nav>"


def test_parsing():
    assert extract("", set()) == ("", 0)
    assert extract("<p>a<b>b</b> c<p>d &lt;p&gt; &amp;amp;<br>e<script>var x='</p>'</script><!-- <p>no -->", set())[0] == "ab c\nd <p> &amp;\ne"
    assert extract("x</div></p>y <unclosed a='>'>z", set())[0] == "xy\nz"
    assert extract("<div>" * 5000 + "deep", set())[0] == "deep"
    assert subtree_hashes("<p>a  b</p>") == subtree_hashes("<p >a\nb</p>") != subtree_hashes("<p id=1>a b</p>")


def tree_lines(page):
    """Subtrees of the well-formed pages below, found by matching tags in the source."""
    found = []
    for m in re.finditer(r"<(\w+)[^>]*>", page):
        depth, at = 0, m.start()
        for t in re.finditer(r"<(/?)(\w+)[^>]*>", page[at:]):
            depth += -1 if t.group(1) else 1
            if not depth:
                found.append(page[at : at + t.end()])
                break
    return set(found)


def test_templates_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("red green blue grey pink".split()) + str(rng.randint(0, 3))
    pages = []
    for i in range(120):
        host = rng.choice(["hot.example", "hot.example", "b.example", "c.example"])
        body = f"<div><p>{word()}</p></div>" + (f"<ul><li>menu {host}</li><li>more</li></ul>" if rng.random() < 0.8 else "") + f"<section><h1>{word()} {i}</h1><p>{word()}</p><footer>{host} end</footer></section>"
        pages.append((i, f"https://{host}/p{i}", f"<html><body>{body}</body></html>"))
    by_host = collections.defaultdict(list)
    for i, u, h in pages:
        by_host[u.split("/")[2]].append((i, h))
    want = {}
    for host, rows in by_host.items():
        n = collections.Counter(s for _, h in rows for s in tree_lines(h))
        often = {s for s, k in n.items() if k >= 5 and k >= 0.2 * len(rows)}
        for i, h in rows:
            while hit := sorted((s for s in often if s in h), key=len, reverse=True):
                h = h.replace(hit[0], "\n")
            want[i] = [x for x in re.sub(r"<[^>]+>", "\n", h).split("\n") if x]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") if r.text else [] for r in extracted(docs).collect()}
    assert got == want
    # with a template table too large to be broadcast
    assert {r.page_id: r.text.split("\n") if r.text else [] for r in extracted(docs, broadcast_bytes=0).collect()} == want


def test_cases(spark):
    rows = [(i, f"http://a.example/{i}", f"<body>{NAV}<p>own {i}</p></body>") for i in range(6)]
    rows += [(7, "http://b.example/", f"<body>{NAV}<p>b</p></body>")] * 9
    rows += [(8, None, "<p>no url</p>"), (9, "http://a.example/n", None), (None, "http://a.example/e", ""), (10, "nonsense", "plain"), (11, "http://u:p@A.EXAMPLE:80/z", f"{NAV}<p>{'long ' * 50000}</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' host", "'d' digests", "0 body")
    got = collections.Counter((r.page_id, r.host, r.deleted, r.text.strip()[:20]) for r in extracted(docs).collect())
    assert got == collections.Counter((r.page_id, r.host, r.deleted, r.text.strip()[:20]) for r in extracted(docs, broadcast_bytes=0).collect())
    for i in range(6):
        assert got[(i, "a.example", 1, f"own {i}")] == 1
    # the same page nine times is one page of its host
    assert got[(7, "b.example", 0, "Home\nÜber uns\nb")] == 9
    assert got[(8, "", 0, "no url")] == got[(9, "a.example", 0, "")] == got[(None, "a.example", 0, "")] == got[(10, "", 0, "plain")] == got[(11, "a.example", 1, "long long long long ")] == 1
    assert extracted(docs.limit(0)).count() == 0


def test_a_host_with_dozens_of_template_variants(spark):
    """Every variant lies far below a fifth of its host; own paragraphs and copied articles of as many pages stay."""
    pages = []
    for i in range(480):
        v = i % 60
        nav = f"<nav><ul><li><a href='/{v}'>home {v}</a></li></ul></nav>"
        links = f"<div><a href='/a{v}'>a{v}</a> | <a href='/b'>b</a> | <a href='/c'>c</a></div>"
        advert = f"<div class='box ad'>buy {v}</div>"
        plain = f"<div><span>about site {i % 8}</span></div>"  # no furniture by its form, but on 60 pages of 480
        article = f"<article><h1>title {v}</h1><p>same words {v}</p><p>own {i}</p></article>"
        pages.append((i, f"http://big.example/{i}", f"<html><body>{nav}{links}{advert}{plain}{article}<footer>end {v}</footer></body></html>"))
    got = {r.page_id: (r.deleted, r.text) for r in extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: (5, f"title {i % 60}\nsame words {i % 60}\nown {i}") for i in range(480)}
