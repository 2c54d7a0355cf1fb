"""Template removal by counting: without any hint, against brute-force counts, and where hints mislead."""
import collections
import math
import random

from labelforge.llm import html_template as T


def prose(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def site(r, n, chrome, host):
    """n pages of a host: chrome around two own paragraphs, no telling tag or name anywhere."""
    rows, own = [], []
    for i in range(n):
        text = [prose(r, 30), prose(r, 40)]
        rows.append((f"https://{host}/{i}", f"<html><body><div class='x1'>{chrome[0]}</div><div class='x2'><h1>{text[0]}</h1><p>{text[1]}</p></div><section>{chrome[1]}</section></body></html>"))
        own.append("\n".join(text))
    return rows, own


def test_counting_alone_removes_an_unnamed_template(spark):
    r = random.Random(1)
    rows, want = [], []
    # 30 pages of one section among 200 unrelated pages of the same host: 13 % of it
    a, own = site(r, 30, ("<p>Shop all</p><p>Open daily</p>", "<ul><li>One</li><li>Two</li></ul>"), "big.example")
    b, other = [], []
    for i in range(200):
        t = [prose(r, 20), prose(r, 20)]
        b.append((f"https://big.example/other/{i}", f"<div><p>{t[0]}</p></div><div><p>{t[1]}</p></div>"))
        other.append("\n".join(t))
    rows, want = a + b, own + other
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id bigint, url string, html string").repartition(6)
    got = {x.page_id: x.text for x in T.extract(docs, hints=False).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert {x.page_id: x.text for x in T.extract(docs, hints=False, max_sent=0).collect()} == got  # by the join
    kept = {x.page_id: x.text for x in T.extract(docs, hints=False, min_pages=31).collect()}
    assert all("Shop all" in kept[i] for i in range(30))  # below the bound it stays


def test_template_subtrees_equal_brute_force_counts(spark):
    r = random.Random(2)
    parts = [f"<div><p>{prose(r, 3)}</p></div>" for _ in range(12)] + [f"<p>{prose(r, 4)}</p>" for _ in range(12)]
    rows = []
    for i in range(300):
        host = f"h{i % 3 if i % 2 else 0}.example"
        body = "".join(r.sample(parts, r.randrange(1, 5))) + f"<section><p>{prose(r, 5)}</p></section>"
        rows.append((i, f"http://{host}/{i}", body))
        if i % 10 == 0:
            rows.append((1000 + i, f"http://{host}/copy{i}", body))
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    pages, trees = collections.defaultdict(set), collections.defaultdict(set)
    for _, url, body in rows:
        host = url.split("/")[2]
        whole, found = T.subtrees(T.Page(body), host)
        pages[host].add(whole)
        for h, _, _, wide in found:
            trees[host, h, wide].add(whole)
    want = {(host, h) for (host, h, wide), on in trees.items()
            if len(on) >= max(T.MIN_PAGES, T.GROWTH * math.log2(len(pages[host]))) and (wide or 2 * len(on) >= len(pages[host]))}
    slim = docs.select(T.F.xxhash64("page_id", "url", "html").alias("key"), T._host(docs["url"]).alias("host"), "html")
    seen = slim.mapInArrow(lambda bs: T._subtree_rows(bs, True), "key bigint, host string, page bigint, tree bigint, wide boolean")
    assert {(x.host, x.tree) for x in T.template_subtrees(seen).collect()} == want and len(want) > 5


def text_of(spark, *html):
    docs = spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    return [x.text for x in sorted(T.extract(docs).collect(), key=lambda x: x.page_id)]


def test_hints_do_not_remove_the_pages_own_text(spark):
    long = "the body text of this page " * 20
    got = text_of(spark, f"<article>teaser card</article><div><p>{long}</p></div>",
                  f"<div class='content has-sidebar'><p>{long}</p><div class='sidebar'>links</div></div>",
                  f"<nav>menu</nav><article><p>{long}</p></article><div>small print</div><div class='comments'><p>{long}</p></div>",
                  "<p>only</p><form>search</form>", f"<body class='with-nav'><div id='footer-links'>x</div><p>{long}</p></body>")
    long = long.strip()
    assert got == [f"teaser card\n{long}", long, long, "only", long]


def test_a_quoted_paragraph_stays(spark):
    r = random.Random(3)
    quote = prose(r, 25)
    html = [f"<article><p>{prose(r, 30)}</p>{f'<p>{quote}</p>' if i % 4 == 0 else ''}<p>{prose(r, 30)}</p></article>" for i in range(100)]
    got = text_of(spark, *html)
    assert sum(quote in t for t in got) == 25
