"""Operators 4 and 5."""

import hashlib
import html
import re

from threadlens.llm import html_extract as H
from threadlens.llm import warc

SF01 = "/root/testdata/sf0.01"


BIG = "é\r\n\r\nWARC/1.1\r\nx" * 20


def pages(spark):
    rows = [(3, "http://a.b/x", BIG), (1, "http://a.b/y", BIG), (7, None, BIG), (None, "http://q\n/", BIG),
            (4, "u", None), (5, "u", ""), (6, "u", "small"), (8, "u", "small"), (3, "http://a.b/x", BIG)]
    return spark.createDataFrame([(*r, "d", 1, "t") for r in rows],
                                 "page_id long, url string, html string, digest string, n int, type string")


def test_captures(spark):
    got = sorted(map(tuple, warc.page_digests(pages(spark)).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n, h = len(BIG.encode()), sha(BIG)
    want = [(1, n, h, "response", None), (3, n, h, "revisit", 1), (3, n, h, "revisit", 1), (7, n, h, "revisit", 1),
            (None, n, h, "revisit", 1), (4, 0, sha(""), "response", None), (5, 0, sha(""), "response", None),
            (6, 5, sha("small"), "response", None), (8, 5, sha("small"), "response", None)]
    assert got == sorted(want, key=str)
    assert warc.page_digests(pages(spark).limit(0)).count() == 0


def test_transactions_are_nested(spark):
    path = warc.scratch(spark, "t")
    warc.write_archive(pages(spark), path)
    got = warc.transactions(warc.read_archive(spark, path)).collect()
    assert len(got) == 9
    for r in got:
        assert r.request.target_uri == r.target_uri and "payload-length: " in r.metadata.block
        if r.type == "response":
            assert "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest
    stray = spark.createDataFrame([("a", "request", None), ("b", "metadata", "nowhere")],
                                  "record_id string, type string, concurrent_to string")
    full = warc.read_archive(spark, path)
    for f in full.columns[3:]:
        stray = stray.withColumn(f, warc.F.lit(None).cast(full.schema[f].dataType))
    assert warc.transactions(full.unionByName(stray)).count() == 9


SITE = """<!DOCTYPE html><html><head><title>T {i}</title><script>var x = "<p>no</p>";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href=/a>Menu {i}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>side {i}</p></div>
<main><h1>Head &amp; line {i}</h1><p>First   part<br>of {words}.<p>Second <em>part</em> &copy; {i}
<div class="share">Share this</div><p>Always the same line here</p>
<form><input><label>Mail</label></form><!-- gone --><section class="reader-comments"><p>Nice {i}</p></section></main>
<aside>Aside</aside><div class="ad">Buy {i}</div><footer>&copy; Site</footer></body></html>"""


def test_extract_site(spark):
    rows = [(i, f"http://Site.example/{i}", SITE.format(i=i, words=" ".join(f"w{i}x{j}" for j in range(i + 2))), 1)
            for i in range(8)]
    rows += [(100, "http://other.example/", SITE.format(i=9, words="x"), 1), (101, None, None, 1), (102, "", "", 1),
             (None, "http://other.example/", "<p>a &lt;b&gt; &amp c", 1), (103, "x", "<div>unclosed <b>bold", 1),
             (100, "http://other.example/", SITE.format(i=9, words="x"), 1), (104, "y", "<nav>only menu", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted(map(tuple, H.extract(df).collect()), key=str)
    text = {r[0]: r[2] for r in got}
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    for i in range(8):
        words = " ".join(f"w{i}x{j}" for j in range(i + 2))
        # The line that stands on every page of the host is template; hosts with few pages keep it.
        assert text[i] == f"Head & line {i}\nFirst part of {words}.\nSecond part © {i}"
    assert text[100].endswith("Always the same line here")
    assert text[101] == text[102] == text[104] == "" and text[None] == "a <b> & c" and text[103] == "unclosed bold"
    assert H.extract(df.limit(0)).count() == 0


def test_odd_pages_and_layouts(spark):
    def page(i, layout):
        own = " ".join(f"w{i}x{j}" for j in range(i % 5 + 2))
        if layout == "a":
            return f"<html><body><p>Welcome to our site</p><article><p>{own}</p><p>Read all our terms</p></article></body></html>"
        return f"<html><body><div><p>Other words up here</p><p>{own}</p></div><div><p>Printed by our own press</p></div></body></html>"

    odd = ["<html><body><p>Not found", "<html><body><p>Welcome to", ""]
    one = [(i, "http://one.example/", page(i, "a")) for i in range(20)] + [
        (100 + i, "http://one.example/", x) for i, x in enumerate(odd)]
    two = [(200 + i, "http://two.example/", page(i, "ab"[i % 2])) for i in range(20)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(one + two, "page_id long, url string, html string")).collect()}
    for i in range(20):
        own = " ".join(f"w{i}x{j}" for j in range(i % 5 + 2))
        assert got[i] == got[200 + i] == own
    assert got[100] == "Not found" and got[101] == "Welcome to"


def test_extract_given_pages(spark):
    df = spark.read.parquet(f"{SF01}/pages.parquet")

    def plain(markup):
        body = re.search(r"<article>(.*)</article>", markup, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip()
                 for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        return "\n".join(p for p in parts if p)

    want = {r.page_id: plain(r.html) for r in df.collect()}
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want


def test_names_of_wrappers_and_headings():
    for name in ("layout has-sidebar", "no-sidebar", "comments-open", "with-comments", "hasSidebar", "page-with-menu"):
        for tag in ("div", "main", "article", "section"):
            assert H.main_text(f"<body><{tag} class='{name}'><p>Text</p></{tag}></body>", None) == "Text", (tag, name)
    for name in ("sidebar", "related", "form", "comments", "site-header"):
        assert H.main_text(f"<div id={name}>a<article><h1>T</h1><p>b</div>", None) == "T\nb", name
        assert H.main_text(f"<article id={name}><p>b</article>", None) == "b", name
        assert H.main_text(f"<main><div class={name}><article><p>b</article></div></main>", None) == "b", name
    ids = ("related-work", "search-engines", "feedback", "notice-1", "comments", "menu")
    text = "".join(f"<h2 id='{i}'>{i}</h2><p>Under {i}</p>" for i in ids)
    assert H.main_text(f"<article>{text}</article>", None).split("\n") == [x for i in ids for x in (i, f"Under {i}")]
    for t in ("<article><p>b</article>", "<main><p>b</main>"):
        assert H.main_text(f"<body><form id=aspnetForm><nav>m</nav>{t}</form>", None) == "b"
    assert H.main_text("<body><form><header>x</header><p>b</p><div><p>c</div></form>", None) == "b\nc"
    # Marked parts still go.
    for part in ("<form><h3>Mail us</h3><p>x</p></form>", "<div class='ad-slot'>x</div>", "<ul id='sidebar-left'><li>x</ul>",
                 "<div class='post-comments'><article class=comment><p>Nice</article></div>", "<p class=share>x</p>"):
        for tag in ("article", "main"):
            assert H.main_text(f"<{tag}><p>b</p>{part}</{tag}>", None) == "b", part
        assert H.main_text(f"<article><p>b</p></article>{part}", None) == "b", part
        assert H.main_text(f"<p>b</p>{part}", None) in ("b", "b\nNice"), part


def test_link_blocks():
    refs = [f"A. Author, B. Writer: a long title of work {i}" for i in range(5)]
    items = "".join(f"<li><a href=x>{r}</a>" for r in refs)
    menu = "".join(f"<li><a href=x>Page {i}</a>" for i in range(4))
    got = H.main_text(f"<body><ul>{menu}</ul><h1><a href=x>Linked head</a></h1><p><a href=y>See this</a>.</p><p>Text</p>"
                      f"<ol>{items}</ol></body>", None)
    assert got.split("\n") == ["Linked head", "See this.", "Text", *refs]
    few = "".join(f"<p><a>{'&amp;&lt;&eacute;' * 3}</a> and some more words {i}" for i in range(4))
    assert H.Page(few).blocks[0][4] == 9 / len("&<é&<é&<é and some more words 0") and len(H.main_text(few, None)) > 100


def test_hostile_markup_is_linear():
    for t in ("<" * 200_000, "<a " * 60_000, "<a b='" * 60_000, "<!--" * 60_000, "<p>" * 100_000, "</p>" * 100_000):
        H.main_text(t, None)
