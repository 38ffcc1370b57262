"""CSS selectors as predicates over the node table.

A selector becomes boolean columns.  What a compound tests of the element itself is an
expression; a combinator or ``:has`` asks for other elements and becomes a window: an
ancestor is a running maximum of ends, a descendant a running minimum of starts from the
back, siblings share a parent, and parent and child meet where every element stands once
under its own number and once under its parent's.  Steps of all selectors that need
nothing from each other share their windows, and all windows are by page, so any number
of selectors costs one shuffle and is independent of how deep or wide a page is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_SIMPLE = re.compile(
    rf"(?P<tag>{_NAME}|\*)|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|:(?P<pseudo>[\w-]+)(?P<open>\()?"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*!]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iI])?\s*)?\]"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"(?:(?P<a>[+-]?\d*)n\s*(?P<b>[+-]\s*\d+)?|(?P<only>[+-]?\d+))\Z")


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


@dataclass(frozen=True)
class _Test:
    """A condition on an element, what it was written as, and after how many rounds of windows it is known."""

    column: Column
    key: str
    level: int = 0
    tag: str | None = None  # set if the condition is this tag and nothing else

    def __and__(self, other: _Test) -> _Test:
        return _Test(self.column & other.column, f"{self.key}&{other.key}", max(self.level, other.level))

    def __or__(self, other: _Test) -> _Test:
        return _Test(self.column | other.column, f"({self.key}|{other.key})", max(self.level, other.level))

    def __invert__(self) -> _Test:
        return _Test(~self.column, f"!({self.key})", self.level)


def _any_element() -> _Test:
    return _Test(F.col("kind") == "element", "*")


_PAGE, _FAMILY = ("page_id",), ("page_id", "parent")
_EARLIER, _LATER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def _over(columns: tuple[str, ...], rows: tuple[int, int]):
    return Window.partitionBy(*columns).orderBy("pre").rowsBetween(*rows)


def _neighbour(pick: Callable[..., Column], test: Column, rows: tuple[int, int]) -> Column:
    return pick(F.when(F.col("kind") == "element", test), ignorenulls=True).over(_over(_FAMILY, rows))


#: What a related element has to be, as a value of the element's own row.
RELATIONS: dict[str, Callable[[Column], Column]] = {
    "below": lambda t: F.max(F.when(t, F.col("last"))).over(_over(_PAGE, _EARLIER)) >= F.col("pre"),
    "holds": lambda t: F.min(F.when(t, F.col("pre"))).over(_over(_PAGE, _LATER)) <= F.col("last"),
    "after": lambda t: F.max(t).over(_over(_FAMILY, _EARLIER)),
    "before": lambda t: F.max(t).over(_over(_FAMILY, _LATER)),
    "next_to": lambda t: _neighbour(F.last, t, _EARLIER),
    "precedes": lambda t: _neighbour(F.first, t, _LATER),
}
#: combinator -> what it asks of the element on its right, and seen from the element on its left
COMBINATORS = {" ": ("below", "holds"), ">": ("child", "parent"), "+": ("next_to", "precedes"), "~": ("after", "before")}


class _Compiler:
    def __init__(self) -> None:
        self.steps: dict[str, tuple[str, Column, int, str]] = {}

    def related(self, relation: str, test: _Test) -> _Test:
        if relation == "child" and test.tag is not None:
            return _Test(F.coalesce(F.col("parent_tag") == test.tag, F.lit(False)), f"child[{test.key}]")
        return self.step(relation, test.column, f"{relation}[{test.key}]", test.level)

    def step(self, kind: str, column: Column, key: str, level: int = 0) -> _Test:
        known = self.steps.setdefault(key, (kind, column, level + 1, f"__match{len(self.steps)}"))
        return _Test(F.col(known[3]), key, known[2])

    def position(self, written: str, from_end: bool, of_type: bool) -> _Test:
        """``an+b`` for some n >= 0."""
        found = _NTH.match({"odd": "2n+1", "even": "2n"}.get(written := written.strip().lower(), written))
        if not found:
            raise ValueError(f"no position: {written!r}")
        a = 0 if found["only"] else int({"": "1", "+": "1", "-": "-1"}.get(found["a"], found["a"]))
        b = int(found["only"] or (found["b"] or "0").replace(" ", ""))
        family = (*_FAMILY, "tag") if of_type else _FAMILY
        rows = (0, Window.unboundedFollowing) if from_end else (Window.unboundedPreceding, 0)
        place = F.sum((F.col("kind") == "element").cast("int")).over(_over(family, rows))
        fits = place == b if a == 0 else (F.pmod(place - b, F.lit(abs(a))) == 0) & ((place >= b) if a > 0 else (place <= b))
        return self.step("value", fits, f"nth[{a},{b},{from_end},{of_type}]") & _any_element()

    def attribute(self, found: re.Match) -> _Test:
        name, op = _plain(found["attr"]).lower(), found["op"]
        value = F.col("attrs")[name]
        if op is None:
            return _Test(value.isNotNull(), f"[{name}]")
        wanted = next((found[g] for g in ("dq", "sq") if found[g] is not None), None)
        wanted = _plain(found["bare"]) if wanted is None else wanted
        key = f"[{name}{op}{wanted!r}{found['flag'] or ''}]"
        if found["flag"]:
            value, wanted = F.lower(value), wanted.lower()
        text = F.lit(wanted)
        if op in ("^=", "$=", "*=") and not wanted or op == "~=" and (not wanted or re.search(r"\s", wanted)):
            return _Test(F.lit(False), key)
        tests = {
            "=": lambda: value == text,
            "!=": lambda: value.isNull() | (value != text),
            "~=": lambda: F.array_contains(F.split(value, r"\s+"), wanted),
            "|=": lambda: (value == text) | F.startswith(value, F.lit(wanted + "-")),
            "^=": lambda: F.startswith(value, text),
            "$=": lambda: F.endswith(value, text),
            "*=": lambda: F.contains(value, text),
        }
        return _Test(F.coalesce(tests[op](), F.lit(False)), key)

    def pseudo(self, name: str, written: str | None) -> _Test:
        name = name.lower()
        if written is not None:
            if name == "not":
                return ~self.any_of(written)
            if name in ("is", "where", "matches"):
                return self.any_of(written)
            if name == "has":
                tests = [self.relative(*_split(part, relative=True)) for part in _parts(written)]
                return _any(tests)
            if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
                return self.position(written, "last" in name, name.endswith("of-type"))
        elif name in ("first-child", "last-child", "first-of-type", "last-of-type"):
            return self.position("1", name.startswith("last"), name.endswith("of-type"))
        elif name in ("only-child", "only-of-type"):
            of_type = name.endswith("of-type")
            return self.position("1", False, of_type) & self.position("1", True, of_type)
        elif name == "empty":
            return ~self.related("holds", _Test((F.col("kind") == "element") | ((F.col("kind") == "text") & (F.col("text") != "")), "content"))
        elif name == "root":
            return _Test(F.col("parent").isNull(), ":root")
        raise ValueError(f"no such selector: :{name}")

    def compound(self, written: str) -> _Test:
        test, at, simple = _any_element(), 0, 0
        while at < len(written):
            found = _SIMPLE.match(written, at)
            if not found or (found["tag"] and at):
                raise ValueError(f"no selector: {written!r}")
            at, simple = found.end(), simple + 1
            if found["tag"]:
                tag = _plain(found["tag"]).lower()
                test = _any_element() if tag == "*" else _Test(F.coalesce(F.col("tag") == tag, F.lit(False)), tag, 0, tag)
            elif found["id"]:
                value = _plain(found["id"])
                test = test & _Test(F.coalesce(F.col("attrs")["id"] == value, F.lit(False)), f"#{value}")
            elif found["cls"]:
                value = _plain(found["cls"])
                has = F.array_contains(F.split(F.col("attrs")["class"], r"\s+"), value)
                test = test & _Test(F.coalesce(has, F.lit(False)), f".{value}")
            elif found["attr"]:
                test = test & self.attribute(found)
            else:
                inner = None
                if found["open"]:
                    stop = _closing(written, at)
                    inner, at = written[at:stop], stop + 1
                test = test & self.pseudo(found["pseudo"], inner)
        if not simple:
            raise ValueError("empty selector")
        return test

    def complex(self, compounds: list[str], combinators: list[str]) -> _Test:
        test = self.compound(compounds[0])
        for combinator, compound in zip(combinators, compounds[1:], strict=True):
            test = self.related(COMBINATORS[combinator][0], test) & self.compound(compound)
        return test

    def relative(self, compounds: list[str], combinators: list[str]) -> _Test:
        """The same seen from the element that the first combinator starts at."""
        test = None
        for combinator, compound in reversed(list(zip(combinators, compounds, strict=True))):
            here = self.compound(compound)
            test = self.related(COMBINATORS[combinator][1], here if test is None else here & test)
        return test

    def any_of(self, written: str) -> _Test:
        return _any([self.complex(*_split(part)) for part in _parts(written)])


def _any(tests: list[_Test]) -> _Test:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _skip(written: str, at: int) -> int:
    """The end of the quoted or bracketed piece, or of the one character, at ``at``."""
    c = written[at]
    if c == "\\":
        return at + 2
    if c in "\"'":
        stop = written.find(c, at + 1)
        if stop < 0:
            raise ValueError(f"open quote: {written!r}")
        return stop + 1
    if c in "([":
        at += 1
        while at < len(written) and written[at] not in ")]":
            at = _skip(written, at)
        if at >= len(written):
            raise ValueError(f"open bracket: {written!r}")
    return at + 1


def _closing(written: str, at: int) -> int:
    return _skip(written, at - 1) - 1


def _parts(written: str) -> list[str]:
    """The selectors of a list, cut at commas outside brackets and quotes."""
    out, first, at = [], 0, 0
    while at < len(written):
        if written[at] == ",":
            out.append(written[first:at])
            first = at + 1
        at = _skip(written, at)
    return [*out, written[first:]]


def _split(written: str, relative: bool = False) -> tuple[list[str], list[str]]:
    """Compounds and the combinators between them; a relative selector begins with one, by default that of descendants."""
    written = written.strip()
    compounds, combinators, at = [], [], 0
    if relative:
        led = re.match(r"([>+~])\s*", written)
        combinators.append(led[1] if led else " ")
        at = led.end() if led else 0
    first = at
    while at < len(written):
        found = _COMBINATOR.match(written, at)
        if found:
            compounds.append(written[first:at])
            combinators.append(found[1] or " ")
            at = first = found.end()
        else:
            at = _skip(written, at)
    compounds.append(written[first:])
    if not all(compounds):
        raise ValueError(f"no selector: {written!r}")
    return compounds, combinators


def _families(rows: DataFrame, steps: list[tuple[str, Column, int, str]]) -> DataFrame:
    """Flags that go from parents to children and back, through groups of a parent and its children."""
    down = [s for s in steps if s[0] == "child"]
    up = [s for s in steps if s[0] == "parent"]
    group = Window.partitionBy("page_id", "__at")
    for own, sending in ((False, down), (True, up)):
        if not sending:
            continue
        # a row stands under its own number as parent, under its parent's as child; text has no children
        stands = F.array_compact(
            F.array(F.when(F.lit(own) | (F.col("kind") == "element"), F.struct(F.col("pre").alias("at"), F.lit(True).alias("own"))),
                    F.when(F.lit(not own) | (F.col("kind") == "element"), F.struct(F.col("parent").alias("at"), F.lit(False).alias("own"))))
        )
        sent = {s[3]: F.coalesce(F.max(F.when(F.col("__own") != own, s[1])).over(group), F.lit(False)) for s in sending}
        rows = rows.withColumn("__stand", F.explode(stands)).select("*", F.col("__stand.at").alias("__at"), F.col("__stand.own").alias("__own"))
        rows = rows.withColumns(sent).filter(F.col("__own") == own).drop("__stand", "__at", "__own")
    return rows


def match(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """The node table with a boolean column per selector (name -> selector list).

    Known: tags, ``*``, ids, classes, attributes with ``= != ~= |= ^= $= *=`` and the flag ``i``, the combinators of
    descendants, children and siblings, ``:not :is :where :has`` with whole selectors, ``:empty``, ``:root`` and positions
    among siblings.  Anything else is a ValueError.  Texts and comments match nothing.
    Names of attributes and tags are lower case, as in the node table; those of the columns must be new to it.
    """
    if taken := set(selectors) & set(nodes.columns):
        raise ValueError(f"columns that exist: {sorted(taken)}")
    compiler = _Compiler()
    tests = {name: compiler.any_of(selector) & _any_element() for name, selector in selectors.items()}
    rows, steps = nodes, list(compiler.steps.values())
    for level in range(1, max((s[2] for s in steps), default=0) + 1):
        now = [s for s in steps if s[2] == level]
        plain = {name: column if kind == "value" else RELATIONS[kind](column) for kind, column, _, name in now if kind not in ("child", "parent")}
        rows = rows.withColumns({name: F.coalesce(column, F.lit(False)) for name, column in plain.items()})
        rows = _families(rows, now)
    element = F.col("kind") == "element"
    return rows.select(*nodes.columns, *[F.coalesce(element & test.column, F.lit(False)).alias(name) for name, test in tests.items()])


def first_match(nodes: DataFrame, selector: str) -> DataFrame:
    """(page_id, pre, last, tag) of the first element of each page that the selector finds."""
    found = match(nodes, {"__found": selector}).filter("__found")
    return found.groupBy("page_id").agg(F.min_by(F.struct("pre", "last", "tag"), "pre").alias("m")).select("page_id", "m.*")
