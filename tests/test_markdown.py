"""Own pairs of HTML and Markdown, written straight from the node table."""

import pytest

from webkiln.html.shred import shred
from webkiln.operators import markdown, removals, render

PAIRS = {
    "paragraphs": ("<p>One <b>bold</b> and <i>it</i>.</p><p>Two</p>", "One **bold** and *it*.\n\nTwo"),
    "headings": ("<h2>Two</h2><p>x</p><h3>Three</h3>", "## Two\n\nx\n\n### Three"),
    "edges": ("<p>a<b> b </b>c <i></i>d</p>", "a **b** c d"),
    "strike": ("<p><del>old</del> <mark>new</mark></p>", "~~old~~ ==new=="),
    "break": ("<p>one<br>two</p>", "one  \ntwo"),
    "break in bold": ("<p><b>one<br></b></p><p>two</p>", "**one**\n\ntwo"),
    "rule": ("<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    "link": ('<p>see <a href="/x" title="T">this <b>one</b></a>, ok</p>', 'see [this **one**](http://e.org/x "T"), ok'),
    "empty link": ('<p>a <a href="/x"></a>b</p>', "a b"),
    "image": ('<p><img src="p.jpg" alt="A photo" title="My"></p>', '![A photo](http://e.org/p.jpg "My")'),
    "figure": ('<figure><img src="p.jpg" alt="A"><figcaption>Caption</figcaption></figure>', "![A](http://e.org/p.jpg)\n\nCaption"),
    "list": ("<ul><li>one</li><li>two<ol><li>deep</li><li>er</li></ol></li></ul><p>x</p>", "- one\n- two\n  1. deep\n  2. er\n\nx"),
    "loose list": ("<ul><li><p>one</p><p>more</p></li><li><p>two</p></li></ul>", "- one\n\n  more\n\n- two"),
    "start": ('<ol start="7"><li>a</li><li>b</li></ol>', "7. a\n8. b"),
    "quote": ("<blockquote><p>a</p><p>b</p><ul><li>c</li></ul></blockquote><p>d</p>", "> a\n>\n> b\n>\n> - c\n\nd"),
    "nested quote": ("<blockquote>a<blockquote>b</blockquote></blockquote>", "> a\n>\n> > b"),
    "quote in item": ("<ul><li>a<blockquote>b</blockquote></li></ul>", "- a\n\n  > b"),
    "callout": ('<blockquote data-callout="warning">Be careful</blockquote>', "> [!warning] Warning\n> Be careful"),
    "callout lines": ('<blockquote data-callout="tip"><p>a</p><p>b</p></blockquote>', "> [!tip] Tip\n> a\n>\n> b"),
    "alert": ('<div class="markdown-alert markdown-alert-note"><p>NOTE</p><p>Useful.</p></div>', "> [!NOTE]\n> Useful."),
    "code": ("<p>run <code>x  = 1</code> now</p>", "run `x = 1` now"),
    "block": ('<pre><code class="language-go">a {\n\n  b\n}</code></pre><p>x</p>', "```go\na {\n\n  b\n}\n```\n\nx"),
    "fences": ("<pre>a\n```\nb</pre>", "````\na\n```\nb\n````"),
    "block in item": ("<ul><li>a<pre><code>x\ny</code></pre></li></ul>", "- a\n\n  ```\n  x\n  y\n  ```"),
    "table": ("<table><thead><tr><th>Name</th><th>n</th></tr></thead><tbody><tr><td>a|b</td><td><b>1</b></td></tr></tbody></table>", "| Name | n     |\n|------|-------|\n| a\\|b | **1** |"),
    "no heading": ("<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>", "|   |   |\n|---|---|\n| a | b |\n| c |   |"),
    "spans": ('<table><tbody><tr><td colspan="2">a</td></tr></tbody></table>', '<table><tbody><tr><td colspan="2">a</td></tr></tbody></table>'),
    "reference": ('<p>Text<sup id="fnref:1"><a href="#fn:1">1</a></sup> more</p>', "Text[^1] more"),
    "notes": ('<div id="footnotes"><ol><li id="fn:1"><p>Note <a href="#fnref:1" class="footnote-backref">↩︎</a></p><p>more</p></li></ol></div>', "[^1]: Note\n\n    more"),
    "back link": ('<p>Note text <a href="#fnref:1" class="footnote-backref">↩︎</a></p>', "Note text"),
    "super": ("<p>mc<sup>2</sup>, H<sub>2</sub>O</p>", "mc<sup>2</sup>, H<sub>2</sub>O"),
    "formula": ('<p>Eq: <math alttext="x^2"><mi>x</mi></math> ok</p>', "Eq:$x^2$ ok"),
    "display": ('<p>a</p><math display="block" data-latex="x^2"></math>', "a\n\n$$\nx^2\n$$"),
    "katex": ('<p>F: <span class="katex" data-latex="a+b">junk</span></p>', "F:$a+b$"),
    "silent": ("<style>.x{}</style><p>a</p><script>b()</script><button>c</button><p>d</p>", "a\n\nd"),
    "svg": ('<p>Icon: <svg width="16"><circle r="4"></circle></svg></p>', 'Icon:<svg width="16"><circle r="4"></circle></svg>'),
    "video": ('<p>a</p><video src="m.mp4"></video><p>b</p>', 'a\n\n<video src="http://e.org/m.mp4"></video>\n\nb'),
    "youtube": ('<iframe src="https://www.youtube.com/embed/dQw4w9WgXcQ"></iframe>', "![](https://www.youtube.com/watch?v=dQw4w9WgXcQ)"),
    "tweet": ('<p>a</p><iframe src="https://platform.twitter.com/embed/Tweet.html?id=123"></iframe>', "a\n\n![](https://x.com/i/status/123)"),
}


@pytest.fixture(scope="module")
def found(spark):
    names = list(PAIRS)
    pages = spark.createDataFrame([(i, "http://e.org/", f"<html><body><article>{PAIRS[n][0]}</article></body></html>") for i, n in enumerate(names)], "page_id long, url string, html string")
    nodes = shred(pages)
    out = render.to_markdown(removals.subtree(nodes, nodes.filter("tag = 'article'")), pages).collect()
    return {names[r.page_id]: r.content_markdown for r in out}


@pytest.mark.parametrize("name", list(PAIRS))
def test_pair(found, name):
    assert found.get(name, "") == PAIRS[name][1]


def test_empty_and_unbalanced():
    assert markdown.write(iter([])) == ""
    assert markdown.write(iter([("uncell", "", ""), ("end", "", ""), ("text", "a", "")])) == "a"
