"""JSON-LD as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Without HTML and script comments and CDATA marks; null unless it is an object or a list."""
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|/\*.*?\*/|<!\[CDATA\[|\]\]>|(?m)^\s*//.*$", "")
    text = F.btrim(text, F.lit(" \t\r\n;"))
    return F.when(text.rlike(r"(?s)^(\{.*\}|\[.*\])$"), text)


def items(text: Column) -> Column:
    """The items of one JSON-LD text: a list's entries, an @graph's entries, or the object."""
    value = F.try_parse_json(clean(text))
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        F.try_variant_get(value, '$["@graph"]', "array<variant>"),
        F.when(value.isNotNull(), F.array(value)),
    )


def is_valid(item: Column) -> Column:
    """It has a type, a schema.org or http id, or two of the usual properties."""
    kind = F.coalesce(F.try_variant_get(item, '$["@type"]', "string"), F.try_variant_get(item, "$.type", "string"), F.lit(""))
    id_ = F.coalesce(F.try_variant_get(item, '$["@id"]', "string"), F.lit(""))
    usual = ["name", "description", "url", "image", "author", "publisher"]
    held = sum(F.try_variant_get(item, f"$.{p}", "variant").isNotNull().cast("int") for p in usual)
    return (kind != "") | id_.contains("schema.org") | id_.contains("http") | (held >= 2)


def _unlisted(found: Column) -> Column:
    """Variants with the entries of lists in their lists' places."""
    return F.flatten(F.transform(found, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def _get(found: Column, at: str) -> Column:
    """What stands at a path of each variant, where something does."""
    return F.filter(F.transform(found, lambda v: F.try_variant_get(v, at, "variant")), lambda v: v.isNotNull())


def values(found: Column, path: str) -> Column:
    """All filled texts at a dotted path of the items: strings, names of objects, and numbers in lists.

    Lists may stand anywhere on the path, ``[n]`` takes the n-th entry of one.  A lone number
    or truth value and an object without a name give nothing.
    """
    for step in path.split("."):
        if step.startswith("["):
            found = _get(found, f"${step}")
        else:
            found = _get(_unlisted(found), f'$["{step}"]')

    def text(v: Column, listed: Column) -> Column:
        kind, name = F.schema_of_variant(v), F.try_variant_get(v, "$.name", "variant")
        plain = (kind == "STRING") | (listed & kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"))
        named = F.when(F.schema_of_variant(name) == "STRING", name)
        return F.try_variant_get(F.when(plain, v).otherwise(named), "$", "string")

    def texts(v: Column) -> Column:
        entries = F.try_variant_get(v, "$", "array<variant>")
        return F.transform(F.coalesce(entries, F.array(v)), lambda e: text(e, entries.isNotNull()))

    return F.filter(F.flatten(F.transform(found, texts)), lambda t: F.coalesce(t, F.lit("")) != "")


def joined(found: Column, path: str) -> Column:
    """The texts at a path of all items, joined by commas; empty where there are none."""
    return F.coalesce(F.array_join(values(found, path), ", "), F.lit(""))


def n_types(found: Column) -> Column:
    """How many different types the items name."""
    return F.size(F.array_distinct(values(found, "@type"))).cast("int")
