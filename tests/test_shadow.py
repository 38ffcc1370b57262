"""Shadow trees and streamed slots stand where a browser shows them."""

import pytest
from test_tables import written

from webkiln.html.shred import parse

RC = "<script>$RC('B:{0}','S:{1}')</script>"


def tree(html):
    """The body without its scripts."""
    return written(html).split(", script(")[0]


TREES = {
    "<div><template shadowrootmode=open><p>in</p><slot></slot></template>light</div>": "div(p('in'), slot(), 'light')",
    "<div><template shadowroot=open>a<template shadowrootmode=closed><b>c</b></template></template></div>": "div('a', b('c'))",
    "<div><template shadowrootmode=open></template>x</div>": "div('x')",
    "<div><template><p>inert</p></template></div>": "div(template(p('inert')))",
    "<main><template id=B:0></template><i>wait</i></main><div hidden id=S:0><p>one</p>two</div>" + RC.format(0, 0): "main(p('one'), 'two', i('wait'))",
    "<main><template id=B:0></template></main><div id=S:0>x<template id=B:1></template></div><div id=S:1><u>deep</u></div>"
    + RC.format(1, 1) + RC.format(0, 0): "main('x', u('deep'))",
    "<main><template id=B:0></template></main><div id=S:0></div>" + RC.format(0, 0): "main(template()), div()",
    "<main>m</main><div id=S:0>s</div>" + RC.format(0, 0): "main('m'), div('s')",
    "<p id=B:0>no template</p><div id=S:0>s</div>" + RC.format(0, 0): "p('no template'), div('s')",
    "<main>m<template id=B:0></template></main><div id=S:0>s<template id=B:0></template></div>" + RC.format(0, 0): "main('m', 's')",
    "<div id=S:0>s<template id=B:0></template></div><p>p</p>" + RC.format(0, 0): "p('p')",
    "<div id=S:0>a</div><div id=S:0>b</div><q><template id=B:0></template></q>" + RC.format(0, 0): "q('a')",
}


@pytest.mark.parametrize("html", list(TREES))
def test_tree(html):
    assert tree(html) == TREES[html]


def test_deep_shadow_trees():
    levels = 3000
    rows = parse("<div><template shadowrootmode=open>" * levels + "x" + "</template></div>" * levels)
    assert rows[-1][7] == "x" and rows[-1][3] == levels + 2
    assert all(r[1] == len(rows) - 1 for r in rows if r[5] != "head")
