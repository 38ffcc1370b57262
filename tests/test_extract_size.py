"""What keeps extraction in proportion to its pages: words counted once, rungs that cannot differ left out, one pass of standardisation."""

import numpy as np
from pyspark.sql import functions as F

from webkiln.functions.text import count_words
from webkiln.html.shred import shred
from webkiln.operators import content, patterns, removals, standardise
from webkiln.plans import extract as plan

#: Runs that go on from one text to the next, scripts that count by character, no-break and wide spaces, empty elements.
ODD = [
    "<article>ab<b>cd</b>ef <i> gh</i>ij<p>kl</p>mn<p></p><span>op</span></article>",
    "<article>漢<b>字ab</b>cd<i>漢</i>x<p>안녕</p>y カ<b>a</b></article>",
    "<article>a <b> b</b>　<i>c </i>:<p>d:</p><ul><li>e</li></ul>\x1cf</article>",
    "<article><p><b>one<br></p><p><b>two<br></p><p><b>three:</p><div><div>\n\t four\r\n</div></div></article>",
]


def _nodes(spark, pages):
    return shred(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).cache()


def test_words_of_subtrees_are_those_of_their_texts(spark):
    nodes = _nodes(spark, ODD)
    measured = content.measured(nodes)
    rows = content.subtree_totals(measured, measured.filter("kind = 'element'"))
    got = rows.select("page_id", "pre", "words", count_words("content_text").alias("want"), F.col("n_chars") == F.char_length("content_text")).collect()
    assert len(got) > 30 and all(r[2] == r[3] and r[4] for r in got)
    main = content.main_content(nodes)
    facts = {(r.page_id, r.pre): r for r in patterns.facts(removals.subtree(nodes, main), main).collect()}
    texts = {(r.page_id, r.pre): r.text for r in rows.select("page_id", "pre", F.btrim("content_text", F.lit(" \t\r\n")).alias("text")).collect()}
    words = {(r.page_id, r.pre): r.words for r in got}
    assert facts and all(r.text == texts[k] and r.words == words[k] for k, r in facts.items())
    for (page, pre), r in facts.items():  # an element around another one says the same where it has as many solid characters
        for (other, at), inner in facts.items():
            if page == other and pre < at and r.last >= inner.last:
                assert (r.text == inner.text) == (r.solid == inner.solid)


def test_rungs_that_cannot_differ_are_not_planned(spark):
    aside = '<div class="ad">An ad.</div>'  # outside of the main content: no rung brings it back
    body = "<p>A few words of a short story are told here, and no more.</p>"
    pages = [
        f"{aside}<article>{body}</article>", f'<article>{body}<div class="byline">by Ann</div></article>',
        f'<article>{body}<div style="display:none">more</div></article>', f'<div style="display:none"><article>{body}</article></div>',
    ]
    nodes = _nodes(spark, pages)
    main = content.main_content(nodes)
    for off, last in ((False, []), (None, [3])):
        steps = plan.Options(remove_content_patterns=off).steps()
        got = {r.page_id: r.can for r in plan._can_differ(removals.mark_steps(nodes, main, steps), main, steps).collect()}
        assert got == {0: last, 1: [1, 3], 2: [2, *last], 3: [2, *last]}


def test_standardisation_reads_its_nodes_once(spark, tmp_path):
    nodes = _nodes(spark, ODD[:1])
    removals.subtree(nodes, content.main_content(nodes)).write.parquet(f"{tmp_path}/inside")
    titles = spark.createDataFrame([(0, "t")], "page_id long, title string")
    rows = standardise.standardise(spark.read.parquet(f"{tmp_path}/inside"), titles)
    physical = rows._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("/inside") == 1
    marks = {(r.tag, r.parent_tag) for r in rows.filter("kind = 'element'").collect()}
    assert ("article", None) in marks and ("b", "article") in marks


def test_what_holds_nothing_leaves_as_its_definition_says():
    rng = np.random.default_rng(4)
    S = standardise
    kinds = [S.TEXT, S.TEXT | S.COMMA, 0, S.ELEMENT, S.ELEMENT | S.IS_DIV, S.ELEMENT | S.IS_SPAN, S.ELEMENT | S.IS_SPAN | S.BARE, S.ELEMENT | S.HEADING, S.ELEMENT | S.MAY_LACK]
    page, pre, last, kind = [], [], [], []
    for number in range(300):
        n = int(rng.integers(1, 12))
        chosen = [S.ELEMENT, *(int(rng.choice(kinds)) for _ in range(n - 1))]
        parent = [-1]
        for i in range(1, n):  # a random tree in document order: below the node before or one around it
            at = i - 1
            while parent[at] >= 0 and (not chosen[at] & S.ELEMENT or rng.random() < 0.5):
                at = parent[at]
            parent.append(at)
        ends = list(range(n))
        for i in reversed(range(1, n)):
            ends[parent[i]] = max(ends[parent[i]], ends[i])
        page += [number * 7 - 900] * n
        pre += [8 * i + 4 for i in range(n)]
        last += [8 * e + 7 for e in ends]
        kind += chosen
    rows = list(zip(page, pre, last, kind, strict=True))
    want = []
    for number in sorted(set(page)):
        own = [r for r in rows if r[0] == number and not r[3] & S.BARE]
        below = lambda r: [x for x in own if r[1] < x[1] <= r[2]]  # noqa: B023, E731
        commas = [
            r for r in own if r[3] & S.IS_DIV and any(x[3] & S.IS_SPAN for x in below(r))
            and not any((x[3] & S.ELEMENT and not x[3] & S.IS_SPAN) or (x[3] & S.TEXT and not x[3] & S.COMMA) for x in below(r))
        ]
        own = [r for r in own if not any(c[1] <= r[1] <= c[2] for c in commas)]
        said = max((r[1] for r in own if r[3] & S.TEXT and not any(h[3] & S.HEADING and h[1] < r[1] <= h[2] for h in own)), default=-1)
        solid = lambda r: r[3] & (S.TEXT | S.MAY_LACK)
        gone = [r for r in own[1:] if (r[3] & S.ELEMENT and not solid(r) and not any(map(solid, below(r)))) or (r[3] & S.HEADING and said < r[1])]
        want += [r for r in own if not any(g[1] <= r[1] <= g[2] for g in gone)]
    stays = S.holding(*(np.array(x, t) for x, t in zip((page, pre, last, kind), (np.int64, np.int32, np.int32, np.int32), strict=True)))
    assert [r for r, stay in zip(rows, stays, strict=True) if stay] == want and 0 < len(want) < len(rows)
    assert len(S.holding(*(np.zeros(0, np.int64),) * 4)) == 0


def test_removal_deals_the_nodes_once(spark, tmp_path):
    pages = ['<article><p>Text.</p><img src=a width=9><img src=a><img src=b></article><img src=a>', "<div><ul><li><a href=/x>x</a></li></ul></div><article>Text.</article>"]
    nodes = _nodes(spark, pages)
    content.measured(nodes).write.parquet(f"{tmp_path}/nodes")
    content.main_content(nodes).write.parquet(f"{tmp_path}/main")
    nodes.select("page_id", "pre").filter("tag = 'ul'").write.parquet(f"{tmp_path}/low")
    nodes, main, low = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("nodes", "main", "low"))
    marked = removals.mark_steps(nodes, main, ("small", "low"), low)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan_ = marked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [line for line in plan_.splitlines() if "Exchange hashpartitioning(page_id" in line and ", key" in line or "Exchange hashpartitioning(page_id" in line and ", pre" in line]
    got = {(r.page_id, r.tag, r.attrs.get("src")) for r in marked.filter("is_small OR is_low").collect()}
    assert got == {(0, "img", "a"), (1, "ul", None)} and marked.filter("is_small").count() == 3
