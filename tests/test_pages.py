"""Page operators on small hand-written pages."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from webkiln import queries
from webkiln.functions import jsonld, text, urls
from webkiln.html.shred import parse, shred
from webkiln.operators import blocks, content, dispatch, metadata, removals, render
from webkiln.plans import extract as plan
from webkiln.sources import pages as sources
from webkiln.streaming import pages as streams

PAGE = """<!DOCTYPE html><html lang="en_US"><head><meta charset=utf-8><title>Big News | The Site</title>
<meta property="og:site_name" content="The Site"><meta name="Description" content="About &amp; more">
<meta property="og:image" content="/i.png"><link rel="shortcut icon" href="/f.ico">
<script type="application/ld+json">/* c */ {"@graph":[{"@type":"Article","headline":"Big News","author":[{"name":"Ann B"},{"name":"Cy D"}],
"datePublished":"2024-05-01"},{"x":1}]}</script><script>var t="</p>";</script></head>
<body><nav><a href="/x">x</a></nav><div class="ad">buy</div><div style="display:none">secret</div>
<article><h1>Big News</h1><p>First <b>bold <i>both</b> it</i> para, with commas, and <a href="../y?z=1#f">a link</a>.
<p>Second<img src="s.png" width="16"><ul><li>one<li>two<ol><li>deep</ol></ul>
<pre><code>a  &lt; b</code></pre><div class="article-byline">by Ann</div><a href="javascript:alert(1)" onclick="x()">bad</a>
<object data=x></object></article><footer>foot</footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://www.Site.org/a/b/c.html", PAGE), (2, None, None), (3, "http://e.com/", "plain <b>text"), (4, "http://e.com/t", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return shred(pages).cache()


def outline(html):
    return [(r[3], r[5] or r[7]) for r in parse(html)][3:]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<p>b", [(2, "p"), (3, "a"), (2, "p"), (3, "b")]),
        ("<p><b>a<p>b", [(2, "p"), (3, "b"), (4, "a"), (2, "p"), (3, "b"), (4, "b")]),
        ("<ul><li>a<li>b</ul>c", [(2, "ul"), (3, "li"), (4, "a"), (3, "li"), (4, "b"), (2, "c")]),
        ("a<br>b</p>", [(2, "a"), (2, "br"), (2, "b"), (2, "p")]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [(2, "table"), (3, "tbody"), (4, "tr"), (5, "td"), (6, "a"), (5, "td"), (6, "b"), (4, "tr"), (5, "td"), (6, "c")]),
        ("<textarea><p>&amp;</textarea>x", [(2, "textarea"), (3, "<p>&"), (2, "x")]),
        ("1 < 2 &lt; <!-- c --> 3", [(2, "1 "), (2, "<"), (2, " 2 < "), (2, " c "), (2, " 3")]),
    ],
)
def test_parse(html, want):
    assert outline("<body>" + html) == want


def test_intervals(nodes):
    rows = nodes.filter("page_id = 1").collect()
    by = {r.pre: r for r in rows}
    assert sorted(by) == list(range(len(rows)))
    for r in rows:
        if r.parent is not None:
            up = by[r.parent]
            assert up.pre < r.pre <= r.last <= up.last and r.depth == up.depth + 1 and r.parent_tag == up.tag


def test_metadata(pages, nodes):
    got = {r.page_id: r for r in metadata.page_metadata(pages, nodes).collect()}
    one = got[1]
    assert (one.title, one.description, one.domain, one.language) == ("Big News", "About & more", "site.org", "en-US")
    assert (one.favicon, one.image, one.author, one.published, one.site) == (
        "https://www.Site.org/f.ico", "/i.png", "Ann B, Cy D", "2024-05-01", "The Site")
    assert '"headline":"Big News"' in one.schema_org and '"x":1' not in one.schema_org
    assert (got[2].title, got[2].domain, got[2].favicon) == ("", "", "")
    assert metadata.meta_tags(nodes).count() == 3


def test_main_content_and_removal(pages, nodes):
    main = content.main_content(nodes)
    assert {r.page_id: r.tag for r in main.collect()} == {1: "article", 2: "body", 3: "body", 4: "body"}
    marked = removals.mark_victims(nodes, main)
    reasons = {(r.tag, r.reason) for r in marked.filter("page_id = 1 AND reason IS NOT NULL").collect()}
    assert {("nav", "exact"), ("footer", "exact"), ("div", "hidden"), ("div", "partial"), ("div", "exact"), ("img", "small_image")} <= reasons
    left = removals.remove(marked).filter("page_id = 1")
    assert left.filter("tag IN ('nav', 'footer', 'img', 'script')").count() == 0
    assert left.filter("text LIKE '%secret%' OR text LIKE '%by Ann%'").count() == 0


def test_extract(pages):
    got = {r.page_id: r for r in plan.extract(pages, plan.Options(markdown=True)).collect()}
    html, md = got[1].content, got[1].content_markdown
    assert html.startswith("<article><p>First <b>bold <i>both</i></b>") and "<h1" not in html and "<h2" not in html
    assert 'href="https://www.Site.org/a/y?z=1#f"' in html and "javascript" not in html and "onclick" not in html and "<object" not in html
    assert "a  &lt; b" in html
    assert "[a link](https://www.Site.org/a/y?z=1#f)" in md and "**bold *both***" in md and "- one" in md and "\n  1. deep" in md
    assert "```\na  < b\n```" in md
    assert got[3].content == "<body>plain <b>text</b></body>" and got[3].word_count == 2
    assert got[2].word_count == 0 and got[4].word_count == 0
    kept = plan.extract(pages, plan.Options(remove_partial=False)).filter("page_id = 1").first()
    assert "by Ann" in kept.content


def test_ladder(pages):
    nodes, main, about = plan.parsed(pages)
    for patterns, step in ((False, 1), (None, 3)):  # the byline comes back: more words; content patterns hold it until the last rung
        left = plan.with_ladder(nodes, main, about, plan.Options(remove_content_patterns=patterns))
        steps = {r.page_id: r.s for r in left.groupBy("page_id").agg(F.max("retry_step").alias("s")).collect()}
        assert steps[1] == step


def test_extract_climbs_the_ladder(pages, tmp_path):
    plain = {r.page_id: r for r in plan.extract(pages, plan.Options(markdown=True), ladder=False).collect()}
    got = {r.page_id: r for r in plan.extract(pages, plan.Options(markdown=True)).collect()}
    assert "by Ann" in got[1].content and "by Ann" in got[1].content_markdown and "by Ann" not in plain[1].content
    assert got[1].word_count > plain[1].word_count
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.page_extract_ladder(pages.sparkSession, str(tmp_path)).collect()
    assert {r.page_id: r.retry_step for r in rows} == {1: 3, 2: 0, 3: 0, 4: 0}
    for r in rows:
        assert {c: r[c] for c in got[1].asDict()} == got[r.page_id].asDict()


def test_table_layouts(spark):
    words = "some words of the story " * 14
    cell = lambda attrs, side="menu": f"<table {attrs}><tr><td>{side}</td><td id=x>{words}</td><td>foot</td></tr></table>"
    rows = {
        1: cell("width=600"), 2: cell("align=CENTER"), 3: cell('class="My-Content"'), 4: cell("width=600px"), 5: cell("width=400"), 6: cell(""),
        7: "<article>an entry point</article>" + cell("width=600"), 8: "<table width=600><tr><td>few words</td></tr></table>",
        9: f"<table align=center><tr><td>a</td><td><table><tr><td>{words}</td><td id=x>{words}</td></tr></table></td></tr></table>",
        10: f"<table width=600><tr><td>{words}</td><td id=x>{words}</td><td>b</td></tr></table>",
    }
    nodes = shred(spark.createDataFrame(list(rows.items()), "page_id long, html string"))
    found = content.main_content(nodes).join(nodes.select("page_id", "pre", F.col("attrs")["id"].alias("at")), ["page_id", "pre"])
    got = {r.page_id: (r.tag, r.at) for r in found.collect()}
    body = ("body", None)
    assert got == {1: ("td", "x"), 2: ("td", "x"), 3: ("td", "x"), 4: body, 5: body, 6: body, 7: ("article", None), 8: body,
                   9: ("td", None), 10: ("td", "x")}


WORDS = [
    ("", 0), ("   ", 0), ("hello", 1), ("hello world", 2), ("hello   world\n\tfoo", 3), ("你好世界", 4), ("hello 世界", 3), ("안녕 world", 3),
    ("ひらがな", 4), ("カタカナ", 4), ("a　b", 2), ("a b", 2), ("abc你好def", 4), ("don't stop", 2),
]


def test_words(spark):
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(WORDS)], "i int, t string, n int")
    assert rows.filter(text.count_words(F.col("t")) != F.col("n")).collect() == []


URLS = [
    ("/a", "https://e.com/x/y", "https://e.com/a"), ("a", "https://e.com/x/y", "https://e.com/x/a"), ("../a", "https://e.com/x/y/z", "https://e.com/x/a"),
    ("./a/./b", "https://e.com", "https://e.com/a/b"), ("?q", "https://e.com/x", "https://e.com/x?q"), ("//h/p", "https://e.com/", "https://h/p"),
    ("#f", "https://e.com/", "#f"), ("", "https://e.com/", ""), ("data:x", "https://e.com/", "data:x"), ("mailto:x", "https://e.com/", "mailto:x"),
    ("http://o/", "https://e.com/", "http://o/"), ("../../..", "https://e.com/a/b", "https://e.com/"), ("a", "", "a"),
]


def test_urls(spark):
    rows = spark.createDataFrame(URLS, "raw string, base string, want string")
    assert rows.withColumn("got", urls.resolve(F.col("raw"), F.col("base"))).filter("got <> want OR got IS NULL").collect() == []
    bad = spark.createDataFrame([("JavaScript:x", True), (" java\nscript:x", True), ("data:text/html,x", True), ("data:image/png", False), ("/x", False)], "u string, want boolean")
    assert bad.filter(urls.is_dangerous(F.col("u")) != F.col("want")).collect() == []
    srcset = spark.range(1).select(urls.resolve_srcset(F.lit("a.png 1x, /b.png 2x"), F.lit("http://e.com/d/")).alias("s"))
    assert srcset.first().s == "http://e.com/d/a.png 1x, http://e.com/b.png 2x"


def test_text_functions(spark):
    one = spark.range(1).select(
        text.clean_title(F.lit("Site - A title"), F.lit("site")).alias("a"),
        text.clean_title(F.lit("A title | Si.te"), F.lit("Si.te")).alias("b"),
        text.date_text(F.lit("Posted on 3 May 2021 by x")).alias("c"),
        text.tidy_markdown(F.lit("# T\n\nx [](u) y!![a](b)\n\n\n\nz\n")).alias("d"),
        jsonld.joined(jsonld.items(F.lit('[{"a":{"name":"n"}},{"a":"m","b":["x",{"name":"y"}]}]')), "a").alias("e"),
        jsonld.joined(jsonld.items(F.lit('[{"b":["x",{"name":"y"}]}]')), "b").alias("f"),
        jsonld.items(F.lit("not json")).isNull().alias("g"),
    ).first()
    assert tuple(one) == ("A title", "A title", "3 May 2021", "x  y! ![a](b)\n\nz", "n, m", "x, y", True)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.com/a/status/1", "twitter"), ("https://publish.twitter.com/x", "twitter"), ("https://bsky.app/p", "bluesky"),
        ("https://news.ycombinator.com/item?id=1", "hackernews"), ("https://news.ycombinator.com/", "generic"),
        ("https://en.wikipedia.org/wiki/X", "wikipedia"), ("https://a.substack.com/p/x", "substack"), ("https://chatgpt.com/share/1", "chatgpt"),
        ("https://netflix.com/", "twitter"), ("https://example.org/", "generic"), (None, "generic"),
    ],
)
def test_dispatch(spark, url, want):
    page = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert dispatch.dispatch(page).first().extractor == want


def test_registry(spark):
    page = spark.createDataFrame([(1, "https://own.example/")], "page_id long, url string")
    own = dispatch.Registry([("own", ("own.example",)), ("rest", ("re:.*",))]).register("late", ("own.example",))
    assert dispatch.dispatch(page, own).first().extractor == "own"
    assert own.names() == ["own", "rest", "late"]


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# c\n\n  http://a/ \nhttp://b/\n")
    assert sorted(r.url for r in sources.read_url_list(spark, str(tmp_path / "list.txt")).collect()) == ["http://a/", "http://b/"]
    (tmp_path / "p.html").write_text("<p>x\ny")
    assert sources.read_files(spark, str(tmp_path / "p.html")).first().html == "<p>x\ny"
    with pytest.raises(ValueError):
        sources.read_table(spark, "../x")
    bodies = [(1, "u", "text/html; charset=latin1", "é".encode("latin1")), (2, "u", "image/png", b"x"), (3, "u", None, "é".encode()),
              (4, "u", "text/html", b'<meta charset="iso-8859-1">\xe9')]
    got = {r.page_id: (r.html, r.error) for r in sources.decode_bodies(spark.createDataFrame(bodies, "page_id long, url string, content_type string, body binary")).collect()}
    assert got == {1: ("é", None), 2: (None, "NOT_HTML"), 3: ("é", None), 4: ('<meta charset="iso-8859-1">é', None)}
    with pytest.raises(ValueError, match="unknown property"):
        sources.project(spark.range(1), "nope")


def test_charsets(spark):
    texts = {"windows-1251": "Привет, мир", "Shift_JIS": "日本語の文", "gb2312": "简体中文", "EUC-KR": "한국어", "big5": "繁體中文"}
    rows = [(i, "u", f"text/html; charset={c}", t.encode(c)) for i, (c, t) in enumerate(texts.items())]
    rows += [(10, "u", None, '<meta charset="koi8-r">да'.encode("koi8-r")), (11, "u", "text/html; charset=no-such", b"a\xffb"), (12, "u", "text/html", None)]
    rows += [(13, "u", "text/html", b"ok \xe9"), (14, "u", "image/png; charset=gbk", b"x")]
    bodies = spark.createDataFrame(rows, "page_id long, url string, content_type string, body binary")
    got = {r.page_id: (r.html, r.error) for r in sources.decode_bodies(bodies).collect()}
    assert [got[i] for i in range(5)] == [(t, None) for t in texts.values()]
    assert [got[i] for i in range(10, 15)] == [('<meta charset="koi8-r">да', None), ("a\ufffdb", None), (None, None), ("ok \ufffd", None), (None, "NOT_HTML")]


def test_stream_equals_batch(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "in"))
    stream = streams.titles(streams.read_pages(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("titles").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("titles").collect()] == [tuple(r) for r in streams.titles(pages).collect()] == [(1, "Big News | The Site")]


def test_threads(spark):
    rows = [(1, 0, 0, "a", "x"), (1, 1, 1, "b", "y"), (1, 2, 2, "c", "z"), (1, 3, 0, "d", "w")]
    out = dispatch.comment_threads(spark.createDataFrame(rows, "g int, o int, d int, a string, t string"), "g", "o", "d", "a", "t").first()
    assert out.thread_html.count("<blockquote>") == 2 == out.thread_html.count("</blockquote>")
    assert out.thread_html.index("</blockquote></blockquote>") < out.thread_html.index("<strong>d")


def test_low_blocks(spark):
    html = """<article>text</article><div class="links"><a href=/a>One link</a> <a href=/b>two link</a> <a href=/c>three link</a></div>
    <section><h3>Related</h3><ul><li><a href=/1>x y</a><li><a href=/2>z w</a></ul></section>
    <div>This is a sentence with enough words, and it ends with a full stop here.</div><div class="share">Share now please</div>"""
    found = blocks.block_scores(shred(spark.createDataFrame([(1, html)], "page_id long, html string")))
    got = {(r.tag, r.words): (r.likely, r.score < 0) for r in found.collect()}
    assert got[("div", 6)] == (False, True) and got[("section", 3)][1] and got[("div", 15)] == (True, False) and got[("div", 3)] == (False, True)


def test_best_block(nodes):
    assert content.best_block(nodes, least=5.0).filter("page_id = 1").first().tag == "article"
    assert render.to_text(nodes).count() == 2


def test_entry_without_the_corpus_operators(tmp_path):
    """The page queries need neither the subpackage for corpora nor its pipeline."""
    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "webkiln", tmp_path / "webkiln", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):  # the driver takes the second away as well
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'page_extract' in names and 'pipeline' not in names; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
