"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain(url: Column) -> Column:
    """The host without a leading ``www.``; empty where there is none."""
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def is_dangerous(url: Column) -> Column:
    """javascript:, vbscript: and data:text/html, whatever the case, spaces or control characters."""
    plain = F.lower(F.regexp_replace(url, r"[\x00-\x20]+", ""))
    return plain.rlike(r"^(javascript:|vbscript:|data:text/html)")


def _without_dots(path: Column) -> Column:
    """RFC 3986 dot segments removed, as a fold over the segments."""
    parts = F.split(path, "/", -1)
    size = F.size(parts)

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    folded = F.aggregate(parts, F.expr("CAST(array() AS array<string>)"), step)
    closes = F.element_at(parts, size).isin(".", "..")
    return F.concat(F.array_join(folded, "/"), F.when(closes, F.lit("/")).otherwise(F.lit("")))


def resolve(raw: Column, base: Column) -> Column:
    """``raw`` against ``base``; empty, fragment-only, data:, javascript:, mailto: and absolute urls stay."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    tail = F.regexp_extract(raw, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(raw, r"^([^?#]*)", 1)
    absolute = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
    query = F.concat(root, F.when(path == "", F.lit("/")).otherwise(path), tail)
    return (
        F.when((raw == "") | raw.rlike(r"(?i)^(#|[a-z][a-z0-9+.\-]*:)") | (root == ""), raw)
        .when(F.startswith(raw, F.lit("//")), F.concat(scheme, raw))
        .when(own == "", query)
        .otherwise(F.concat(root, _without_dots(absolute), tail))
    )


def resolve_srcset(srcset: Column, base: Column) -> Column:
    def one(entry: Column) -> Column:
        url = F.regexp_extract(entry, r"^\s*(\S+)", 1)
        rest = F.rtrim(F.regexp_extract(entry, r"^\s*\S+(.*)$", 1))
        return F.concat(resolve(url, base), rest)

    return F.array_join(F.transform(F.filter(F.split(srcset, ","), lambda e: F.trim(e) != ""), one), ", ")


def canonical(url: Column) -> Column:
    """The url without scheme, www/m/blog prefix, query, fragment, ``.html`` and closing slash."""
    plain = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    plain = F.regexp_replace(plain, r"[?#].*$", "")
    plain = F.regexp_replace(plain, r"^(www|m|blog)\.", "")
    return F.regexp_replace(plain, r"(\.html)?/*$", "")


#: What counts readers, by its url.
TRACKING = [r"pixel\.gif", r"1x1\.gif", r"tracking\.gif", "analytics", "metrics", "beacon"]


def is_tracking_pixel(src: Column) -> Column:
    return src.rlike(f"(?i)({'|'.join(TRACKING)})")


def citation_domain(url: Column) -> Column:
    """The host as it is written, without port, brackets and a leading ``www.``; empty without a host.

    A url that cannot be read (control characters, broken escapes outside the query) stays as it is.
    """
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    broken = url.rlike(r"[\x00-\x1F\x7F]|^[^?#]*%(?![0-9A-Fa-f]{2})|^[^#]*#.*%(?![0-9A-Fa-f]{2})")
    return F.when(broken, url).otherwise(F.regexp_replace(F.regexp_replace(found, r"^\[|\]$", ""), r"^www\.", ""))


def fragment_text(url: Column) -> Column:
    """What ``#:~:text=`` quotes, as `` — start...`` if it names start and end, else `` — text``; empty without it."""
    quoted = F.regexp_extract(url, r"(?s)^.*?#:~:text=(.*)\z", 1)
    quoted = F.replace(F.coalesce(F.try_url_decode(quoted), F.lit("")), F.lit("%2C"), F.lit(","))
    start = F.trim(F.substring_index(quoted, ",", 1))
    ends = F.when(F.contains(quoted, F.lit(",")), F.concat(start, F.lit("..."))).otherwise(F.trim(quoted))
    return F.when(url.isNotNull(), F.when(start == "", "").otherwise(F.concat(F.lit(" — "), ends)))


def unwrap_redirect(href: Column) -> Column:
    """The url in the query's first ``u``, decoded twice; without one, or where that fails, ``href`` itself."""
    pairs = F.split(F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1), "&")
    named = F.filter(pairs, lambda p: p.rlike(r"^u(=[^;]*)?\z") & F.try_url_decode(p).isNotNull())
    value = F.try_url_decode(F.regexp_replace(F.get(named, F.lit(0)), "^u=?", ""))
    return F.coalesce(F.try_url_decode(F.nullif(value, F.lit(""))), href)


def large_image(src: Column) -> Column:
    """The url of an image service that takes ``name`` as the size, asking for the large one."""
    return (
        F.when(F.contains(src, F.lit("&name=")), F.regexp_replace(src, r"&name=\w+", "&name=large"))
        .when(F.contains(src, F.lit("?")), F.concat(src, F.lit("&name=large")))
        .otherwise(F.concat(src, F.lit("?name=large")))
    )
