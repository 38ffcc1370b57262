"""Threads and transcripts of several sites in one plan."""

from pyspark.sql import functions as F

from webkiln.html.shred import shred
from webkiln.operators import discussions, dispatch

HN = """<table><tr class="athing comtr"><td><img src=s.gif width="0"></td><td><a class="hnuser">ann</a><div class="commtext c00">First</div></td></tr>
<tr class="athing comtr"><td><img src=s.gif width="80"></td><td><a class="hnuser">bob</a><div class="commtext c00">Deep <i>one</i></div></td></tr></table>"""
REDDIT = """<shreddit-comment author="cy" depth="0"><div slot="comment"><p>Top</p></div>
<shreddit-comment author="di" depth="1"><div slot="comment">Reply</div></shreddit-comment></shreddit-comment>"""
LWN = """<details class="CommentBox"><p class="CommentPoster">ed</p><div class="FormattedComment">Out</div>
<details class="CommentBox"><p class="CommentPoster">flo</p><div class="FormattedComment">In</div></details></details>"""
CLAUDE = """<div data-testid="user-message">Hi</div><div class="font-claude-response"><p>Hello</p></div>"""
PAGES = [
    (1, "https://news.ycombinator.com/item?id=1", HN), (2, "https://www.reddit.com/r/x/comments/1", REDDIT), (3, "https://lwn.net/Articles/1/", LWN),
    (4, "https://claude.ai/chat/1", CLAUDE), (5, "https://example.org/", HN), (6, "https://chatgpt.com/share/1", None),
]


def test_entries(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = discussions.entries(shred(pages).cache(), dispatch.dispatch(pages))
    got = {}
    for r in rows.orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append((r.depth, r.author, r.body))
    assert got == {
        1: [(0, "ann", "First"), (2, "bob", "Deep one")],
        2: [(0, "cy", "Top"), (1, "di", "Reply")],
        3: [(0, "ed", "Out"), (1, "flo", "In")],
        4: [(0, "You", "Hi"), (0, "Claude", "Hello")],
    }
    threads = dispatch.comment_threads(rows.withColumn("key", F.col("page_id")), "key", "place", "depth", "author", "body")
    assert {r.key: r.thread_html.count("<blockquote>") for r in threads.collect()} == {1: 2, 2: 1, 3: 1, 4: 0}
