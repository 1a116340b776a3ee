from maskframe.llm.htmltext import extract, host_of, hashed, main_text, op4_html_text, parse
from pyspark.sql import functions as F


def text(page, template=frozenset(), most=frozenset()):
    return main_text(page, set(template), set(most))


def test_blocks_entities_and_white_space():
    page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>a</a></li></ul></nav><!-- ad -->" \
        "<div class=\"ad\">Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two \n\t three&nbsp;four.<br><p>Five &lt;six&gt; &#233;&#x41;</p><p> </p><ul><li>i<li>ii</ul></article><footer>&copy; z</footer></body></html>"
    assert text(page) == "A & B\nOne two three four.\nFive <six> éA\ni\nii"


def test_what_is_not_content():
    page = "<body><header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>Body one.</p><form><input>Send</form><div class='share-buttons'>Share</div><aside>More</aside>" \
        "<p>Body <i>two</i>.</p><div id=comments><p>First!</p></div></article></main><div role=navigation>n</div><section class='comment-list'>c</section><p hidden>h</p><footer>f</footer></body>"
    assert text(page) == "T\nBody one.\nBody two."
    assert text("<body><div class=cookie-notice>We use</div><div id=content><p>Only this.</p></div><header>H</header><p>And this") == "Only this.\nAnd this"
    assert text("<article>a<p>b</article><article class=comment>c</article><article><p>d</article>") == "a\nb\nd"
    assert text("<article><p>load the header section with adder roads</p></article>") == "load the header section with adder roads"


def test_odd_markup():
    assert text("") == "" and text("plain  text") == "plain text"
    assert text("<p>a</b></div>b<p>c</p></p>d") == "ab\nc\nd"
    assert text("<script>never closed") == "" and text("<p>x<!-- never closed") == "x"
    assert text("<p>1 < 2 & 3 > 2</p>") == "1 < 2 & 3 > 2"
    assert text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert text("<p>" + "w " * 200_000 + "</p>") == ("w " * 200_000).strip()
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_classes_and_ids_in_an_article():
    page = '<article><h2 id="discussion">Discussion</h2><p>A</p><h2 id="related-work">Related</h2><p class="share-price">B</p><section id="legal"><p>Body</p></section>' \
        '<div class="related-work">C</div><pre>x <span class="comment"># why</span></pre><ul><li class="notice">D</li></ul><section id="comments" class="x"><p>First!</p></section>' \
        '<div class="social-share-buttons">S</div><div class="ad box">Buy</div><section class="comments"><p>Nice</p></section><table class="menu"><tr><td>z</table></article>'
    assert text(page) == "Discussion\nA\nRelated\nB\nBody\nC\nx # why\nD"


def test_attributes_by_their_states():
    assert text("<p>One <a title=it's>two</a> three</p><p>it's four</p>") == "One two three\nit's four"
    assert text("<p>One <a title=it's>two</a> three</p>") == "One two three"
    assert text("<p a='>' b=\">\" c = x/y d>in</p><p =a>b</p>") == "in\nb"
    assert text("<p>kept</p><a href='never closed>lost</a>") == "kept" and text("<p>kept</p><a href") == "kept"
    assert text("a</>b</3>c<!>d<?x?>e<!---->f<!-->g") == "abcdefg" and text("a<") == "a<" and text("</") == "</"
    assert text("<div hidden>a</div><div class=x hidden=until>b</div><div style='display: none'>c</div><div data-hidden=1>d</div>") == "d"


def test_time_is_linear():
    import time

    n = 100_000
    for page in ("<a " * n, "<div>" * n + "</x>" * n, "<b>" * n + "<p>x" * n, "<li>" * n, "<table><td>" * n, "<p><b>" * n, "<!--" * n, "<x a='" * n, "<" * n, "<script>" * n, "</" * n, "<article>" * n):
        began = time.perf_counter()
        text(page)
        assert time.perf_counter() - began < 20


def test_hashes_ignore_white_space():
    a, b, c = (hashed(parse(x)) for x in ("<div><p>a b</p></div>", "<div>\n<p>a  b</p>\n</div>", "<div><p>a c</p></div>"))
    assert {n.hash for n in a} == {n.hash for n in b} and not {n.hash for n in a} & {n.hash for n in c}


def test_templates_by_host(spark, tmp_path):
    rows = [(k, f"https://u@a.com:80/{k}", f"<body><div><p>Site a {'x' * (k % 2)}</p></div><div><p>Own text {k}.</p></div><div>All rights</div></body>") for k in range(12)]
    rows += [(100 + k, f"http://b{k}.org/", "<body><p>All rights</p><div>All rights</div></body>") for k in range(12)]
    rows += [(200 + k, "http://c.org/x", f"<body><article><h1>H{k}</h1><p>Same words in copies.</p><div>Follow us</div></article></body>") for k in range(20)]
    rows += [(300, None, None), (301, "nonsense", ""), (None, "http://d.net", "<p>x</p>"), (0, "http://A.com/z", "<div>All rights</div><p>z</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["url"]): r for r in op4_html_text(spark, str(tmp_path)).collect()}
    at = lambda i: [r["text"] for (p, _), r in got.items() if p == i]
    assert len(got) == len(rows)
    assert at(3) == ["Own text 3."] and at(100) == ["All rights\nAll rights"]
    assert sorted(at(0)) == ["Own text 0.", "z"]
    assert at(300) == at(301) == [""] and at(None) == ["x"]
    # repeated on all of a host's pages: the follow line goes, and so does a paragraph that every page has
    assert at(205) == ["H5"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    extra = extract(pages.withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).limit(3)).first()
    assert extra["text"] == 1 and extra["host"] == 2 and extra["text_"] is not None
    assert extract(pages.limit(0)).count() == 0


def test_counts_by_host_against_brute_force(spark):
    """Subtrees are counted by what they hold, written out, and pages by the text of their articles."""
    import random

    from maskframe.llm import htmltext as m

    r = random.Random(11)
    word = lambda: r.choice("ab cd ef gh ij".split())

    def page(host):
        parts = [f"<p>{word()} {word()} {r.randint(0, 3)}</p>", f"<div>Follow {host}</div>", f"<div><i>{word()}</i></div>", f"<h2>{word()}</h2>", f"<ul><li>{word()}</li></ul>", f"<p>Every {host}</p>", f"<span>{word()}</span>"]
        inner = "".join(r.sample(parts, r.randint(2, 6)))
        return f"<body><div>Site {host}</div>{f'<article>{inner}</article>' if r.random() < 0.7 else inner}<div>{word()}</div></body>"

    rows = [(k, f"http://{h}.org/{k}", page(h)) for h, n in (("x", 60), ("y", 25), ("z", 9), ("w", 3)) for k in range(n)]
    rows += [(100 + k, "http://x.org/", rows[0][2]) for k in range(40)]

    def written(node):
        inside = "".join("".join(c.split()) if isinstance(c, str) else written(c) for c in node.children)
        return f"<{node.tag}>{inside}" if inside else ""

    articles, holders = {}, {}
    for _, url, html in rows:
        host, root = url.split("/")[2], parse(html)
        article = m._text(root)
        articles.setdefault(host, set()).add(article)
        for node in hashed(root):
            if node.hash:
                holders.setdefault((host, written(node)), set()).add(article)
    want = []
    for k, url, html in rows:
        host, root = url.split("/")[2], parse(html)
        n = {x.hash: len(holders[host, written(x)]) for x in hashed(root) if x.hash}
        total = len(articles[host])
        template = {h for h, c in n.items() if c >= m.PAGES and c >= m.SHARE * total}
        want.append((k, url, main_text(html, template, {h for h in template if n[h] >= m.ARTICLE_PAGES and n[h] >= m.ARTICLE_SHARE * total})))
    got = [(x["page_id"], x["url"], x["text"]) for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()]
    assert sorted(got) == sorted(want) and any(t != main_text(h, set(), set()) for (_, _, t), (_, _, h) in zip(want, rows))


def test_copies_of_an_article_stay(spark):
    """Copies count once, with chrome of their own too, and recurring inline or paragraph content isn't a template."""
    one = "<article><h1>T</h1><p>Copied <b>words</b>.</p><div>A div of it.</div></article>"
    rows = [(k, "http://copies.org/", f"<body><nav>{k}</nav>{one}</body>") for k in range(12)]
    rows += [(20 + k, "http://copies.org/", f"<body><article><p>Else {k}</p></article></body>") for k in range(3)]
    rows += [(40 + k, "http://notes.org/", f"<body><article><p><b>Note:</b> own {k}.</p><div>Menu</div></article></body>") for k in range(12)]
    rows += [(60 + k, "http://bare.org/", f"<body><div>Menu</div><p>Copied <i>words</i>.</p><div>at {k}</div></body>") for k in range(6)]
    rows += [(70 + k, "http://bare.org/", f"<body><div>Menu</div><p><i>words</i> {k}</p></body>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(12)} == {"T\nCopied words.\nA div of it."}
    assert got[21] == "Else 1" and got[43] == "Note: own 3."
    assert got[61] == "Copied words.\nat 1" and got[72] == "words 2"


def test_hosts(spark):
    urls = ["http://A.b.c/d", "https://u:p@x.y:99?q", "ftp://z", "x.y/z", "", None, "http://"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of("u")).collect()]
    assert got == ["a.b.c", "x.y", "z", "", "", "", ""]


def test_whole_page_on_given_tables(spark):
    """Pages of the test tables are an article of known markup: compare with a plain reading of it."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    for p in pages:
        body = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", body)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
        assert got[p["page_id"]] == "\n".join(x for x in lines if x)
