"""Tree construction of tables: implied parts, what no table takes, tables in tables."""

import pytest

from webkiln.html.shred import parse

TREES = {
    "<table><tr><td>a<td>b<tr><td>c</table>x": "table(tbody(tr(td('a'), td('b')), tr(td('c')))), 'x'",
    "<table><td>z</table>": "table(tbody(tr(td('z'))))",
    "<table><thead><tr><th>h</th></tr><tbody><tr><td>c</table>": "table(thead(tr(th('h'))), tbody(tr(td('c'))))",
    "<table><caption>cap</caption><colgroup><col></colgroup><td>z</table>": "table(caption('cap'), colgroup(col()), tbody(tr(td('z'))))",
    "<table><div>x</div><tr><td>a</td></tr></table>": "div('x'), table(tbody(tr(td('a'))))",
    "<table>text<tr><td>a</td>more<b>bold</b></tr></table>y": "'text', 'more', b('bold'), table(tbody(tr(td('a')))), 'y'",
    "<table><p>one<p>two<tr><td>c</table>": "p('one'), p('two'), table(tbody(tr(td('c'))))",
    "<table><tbody><p>x<tr><i>y<td>c</table>": "p('x'), i('y'), table(tbody(tr(td('c'))))",
    "<table><table><tr><td>in</td></tr></table></table>": "table(), table(tbody(tr(td('in'))))",
    "<table><tr><td>o<table><tr>u<td>i</table></table>": "table(tbody(tr(td('o', 'u', table(tbody(tr(td('i'))))))))",
    "<div><td>lost</td></div>": "div('lost')",
    "<p>a<table><tr><td>b</td></tr></table>c": "p('a'), table(tbody(tr(td('b')))), 'c'",
    "<table><tr> <td>a</td> </tr> </table>": "table(tbody(tr(' ', td('a'), ' '), ' '))",
}


def written(html):
    rows = parse(html)
    for i, (pre, last, parent, depth, *_rest, parent_tag) in enumerate(rows):
        assert pre == i <= last and (parent is None or (rows[parent][0] < i <= rows[parent][1] and rows[parent][3] == depth - 1 and rows[parent][5] == parent_tag))

    def tree(i):
        if rows[i][4] != "element":
            return repr(rows[i][7])
        return f"{rows[i][5]}({', '.join(tree(j) for j, r in enumerate(rows) if r[2] == i)})"

    body = next(i for i, r in enumerate(rows) if r[5] == "body")
    return tree(body)[5:-1]


@pytest.mark.parametrize("html", list(TREES))
def test_table(html):
    assert written(html) == TREES[html]
