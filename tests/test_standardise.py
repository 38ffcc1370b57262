"""Own pages for every rewriting of the main content."""

import pytest

from webkiln.html.shred import shred
from webkiln.operators import removals, render, standardise

PAGES = {
    # name: (title, what stands in the article, what is expected there)
    "spaces": ("", "<p>One   two    three   four</p>", "<p>One two three four</p>"),
    "no-break": ("", "<p>a b</p><pre>a b</pre>", "<p>a  b</p><pre>a b</pre>"),
    "comments": ("", "<p>Seen<!-- not seen --> text</p>", "<p>Seen text</p>"),
    "h1": ("Other", "<h1 class='x' lang='en'>Heading</h1><p>text</p>", '<h2 lang="en">Heading</h2><p>text</p>'),
    "title": ("The  Title", "<h1>the <i>title</i></h1><p>text</p><h1>The Title</h1><p>more</p>", "<p>text</p><h2>The Title</h2><p>more</p>"),
    "no title": ("", "<h1>Kept</h1><p>text</p>", "<h2>Kept</h2><p>text</p>"),
    "empties": ("", "<p>a</p><div></div><span>  </span><section><div><b> </b></div></section><p>b</p>", "<p>a</p><p>b</p>"),
    "may be empty": ("", "<p>a</p><div><img src='x.png'></div><table><tr><td></td></tr></table><p>b</p>", None),
    "commas": ("", "<p>a</p><div><span lang='t'>,</span><span lang='t'> </span></div><p>b</p>", "<p>a</p><p>b</p>"),
    "end heading": ("", "<p>a</p><div><h2>Gone</h2><h3>also</h3></div>", "<p>a</p>"),
    "kept heading": ("", "<h2>Kept</h2><p>a</p>", "<h2>Kept</h2><p>a</p>"),
    "breaks": ("", "<p>a<br> <br><br>\n<br>b<br><br>c</p>", "<p>a<br><br>b<br><br>c</p>"),
    "wrappers": ("", "<div class='wrapper'><div><div class='inner'><p>a</p><h2>b</h2></div></div></div><p>c</p>", "<p>a</p><h2>b</h2><p>c</p>"),
    "text div": ("", "<div id='k'>plain <b>bold</b> text</div>", "<p>plain <b>bold</b> text</p>"),
    "kept table": ("", "<div><div><table><tbody><tr><td>x</td></tr></tbody></table></div></div>", None),
    "mixed div": ("", "<section><div>text<p>para</p></div><p>x</p></section>", "text<p>para</p><p>x</p>"),
    "only paragraphs": ("", "<div role='main'><p>a</p><p>b</p></div>", "<p>a</p><p>b</p>"),
    "spans": ("", "<p><span>bare <span>nested</span></span> <span lang='de'>kept</span></p>", '<p>bare nested<span lang="de">kept</span></p>'),
    "script link": ("", "<p>see <a href='javascript:x()'>this</a> now</p>", "<p>see this now</p>"),
    "code link": ("", "<p>x <code>a <a href='/b'>b</a></code></p>", "<p>x <code>a b</code></p>"),
    "section link": ("", "<a href='#s'><h2>Head</h2></a><p>a</p>", "<h2>Head</h2><p>a</p>"),
    "heading link": ("", "<a href='http://e.org/x' title='t'><h3>Head <i>it</i></h3></a><p>a</p>", '<h3><a href="http://e.org/x">Head <i>it</i></a></h3><p>a</p>'),
    "permalink": ("", "<h2>A <a href='#a'>link</a></h2><h2>B<a class='heading-anchor' href='/x'>l</a></h2><h2>C <a href='/y'>¶</a></h2><p>a</p>", "<h2>A </h2><h2>B</h2><h2>C </h2><p>a</p>"),
    "real link": ("", "<h2><a href='http://e.org/y'>Real</a></h2><p>a</p>", '<h2><a href="http://e.org/y">Real</a></h2><p>a</p>'),
    "obsolete": ("", "<p>a</p><object data='x'><p>in</p></object><embed src='y'><p>b</p>", "<p>a</p><p>b</p>"),
    "dividers": ("", "<div><hr></div><hr><p>a</p><hr><p>b</p><hr> <hr>", "<p>a</p><hr><p>b</p>"),
    "preformatted": ("", "<p>a</p><code style='white-space: pre'>x  y</code>", "<p>a</p><pre><code>x  y</code></pre>"),
    "in pre": ("", "<pre><code style='white-space:pre'>x  y</code></pre>", "<pre><code>x  y</code></pre>"),
    "no style": ("", "<p>a <code>x</code></p>", "<p>a <code>x</code></p>"),
    "callout": ("", "<aside class='callout callout-tip'><div class='head'>Tip</div><div class='callout-content'><p>Inner</p></div></aside>", '<blockquote data-callout="tip"><p>Inner</p></blockquote>'),
    "callout whole": ("", "<aside class='callout'><p>All</p></aside>", '<blockquote data-callout="note"><p>All</p></blockquote>'),
    "paragraph role": ("", "<div role='paragraph' dir='ltr'>a <b>b</b></div>", '<p dir="ltr">a <b>b</b></p>'),
    "list role": (
        "",
        "<div role='list'><div role='listitem'><div class='label'>1)</div><div class='content'><div role='paragraph'>one</div></div></div>"
        "<div role='listitem'><div class='label'>2)</div><div class='content'>two<div role='list'><div role='listitem'>"
        "<span class='label'>-</span><div class='content'>sub</div></div></div></div></div></div>",
        "<ol><li><p>one</p></li><li>two <ul><li>sub</li></ul></li></ol>",
    ),
    "video": ("", "<p>a</p><lite-youtube videoid='q1' videotitle='V'></lite-youtube><p>b</p>", None),
    "attributes": ("", "<p class='x' onclick='y()' data-z='1' title='t'>a <code class='language-go'>b</code></p><p id='fn:1'>c</p><p class='callout-x'>d</p>", '<p title="t">a <code class="language-go">b</code></p><p id="fn:1">c</p><p class="callout-x">d</p>'),
    "inline siblings": ("", "<ul><li><a href='http://e.org/'>a</a><b>b</b>, c</li></ul>", '<ul><li><a href="http://e.org/">a</a> <b>b</b>, c</li></ul>'),
    "punctuation": ("", "<p>a , b​ ! c</p>", "<p>a, b! c</p>"),
}


def contents(spark, debug=False, only=PAGES):
    names = list(only)
    rows = [(i, "http://e.org/", f"<html><body><article>{PAGES[n][1]}</article></body></html>") for i, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = shred(pages)
    left = removals.subtree(nodes, nodes.filter("tag = 'article'"))
    titles = spark.createDataFrame([(i, PAGES[n][0] or None) for i, n in enumerate(names)], "page_id long, title string")
    out = render.to_html(standardise.standardise(left, titles, debug), pages).collect()
    return {names[r.page_id]: r.content.removeprefix("<article>").removesuffix("</article>") for r in out}


@pytest.fixture(scope="module")
def found(spark):
    return contents(spark)


@pytest.mark.parametrize("name", [n for n, (*_, expect) in PAGES.items() if expect is not None])
def test_shape(found, name):
    assert found[name] == PAGES[name][2]


def test_kept(found):
    assert '<img src="http://e.org/x.png">' in found["may be empty"] and "<td></td>" in found["may be empty"]
    assert found["kept table"] == "<div><table><tbody><tr><td>x</td></tr></tbody></table></div>"
    assert 'src="https://www.youtube.com/embed/q1"' in found["video"] and 'title="V"' in found["video"]


def test_debug_keeps_structure(spark):
    out = contents(spark, debug=True, only=["wrappers", "attributes", "end heading", "breaks"])
    assert '<div class="wrapper">' in out["wrappers"]
    assert '<p class="x" data-z="1" title="t">' in out["attributes"]
    assert "Gone" not in out["end heading"]
    assert out["breaks"].count("<br>") == 4
