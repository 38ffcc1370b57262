"""Image, code and formula helpers as Catalyst expressions; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webkiln.functions.text import trim_space
from webkiln.functions.urls import is_tracking_pixel

#: Names of code languages.
CODE_LANGUAGES = """
abap actionscript ada adoc agda antlr4 applescript arduino armasm asciidoc aspnet atom bash batch c clojure cmake cobol
coffeescript cpp c++ crystal csharp cs dart django dockerfile dotnet elixir elm erlang fortran fsharp gdscript gitignore glsl
golang go gradle graphql groovy haskell hs haxe hlsl html idris java javascript js jsx jsdoc json jsonp julia kotlin latex lisp
elisp livescript lua makefile markdown md markup masm mathml matlab mongodb mysql nasm nginx nim nix objc ocaml pascal perl php
postgresql powershell prolog puppet python regex rss ruby rb rust scala scheme shell sh solidity sparql sql ssml svg swift tcl
terraform tex toml typescript ts tsx unrealscript verilog vhdl webassembly wasm xml yaml yml zig
""".split()

#: Class parts of images that only decorate.
DECORATIVE = ["icon", "avatar", "emoji", "bullet", "decoration", "logo-small"]

#: Images of less base64 text than this are placeholders.
PLACEHOLDER_CHARS = 133
#: Images narrower or lower than this are decoration.
DECORATIVE_PX = 50


def class_tokens(classes: Column) -> Column:
    """The words of a class attribute."""
    return F.filter(F.split(classes, r"[\s\x{85}\p{Z}]+"), lambda token: token != "")


def has_class(classes: Column, name: str) -> Column:
    return F.array_contains(class_tokens(classes), name)


def has_callout_class(classes: Column) -> Column:
    """A class ``callout`` or ``callout-*``."""
    return F.exists(class_tokens(classes), lambda token: token.rlike(r"^callout(-|\z)"))


def class_language(classes: Column) -> Column:
    """What follows ``language-`` or ``lang-`` in the first class that starts so; else empty."""
    named = F.filter(class_tokens(classes), lambda token: token.rlike("^lang(uage)?-"))
    return F.when(F.size(named) > 0, F.regexp_replace(F.get(named, F.lit(0)), "^lang(uage)?-", "")).otherwise(F.when(classes.isNotNull(), ""))


def is_code_language(name: Column) -> Column:
    return name.isin(CODE_LANGUAGES)


def tidy_code(code: Column) -> Column:
    """Code without outer white space, with four spaces for a tab, plain spaces and one empty line at most."""
    code = F.replace(F.replace(trim_space(code), F.lit("\t"), F.lit("    ")), F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(code, r"\n{3,}", "\n\n")


def looks_like_latex(text: Column) -> Column:
    """A pair of dollar signs or braces in one line, a command, ``^`` or ``_``."""
    return text.rlike(r"(?d)\$.*\$|\\\w|\{.*\}|\^|_")


def is_svg_data(src: Column) -> Column:
    return F.startswith(src, F.lit("data:image/svg+xml"))


def is_placeholder(src: Column) -> Column:
    """A small base64 image; drawings (svg) may be small and still mean something."""
    head = F.regexp_extract(src, r"^(data:image/[^;]+;base64,)", 1)
    small = F.octet_length(src) - F.octet_length(head) < PLACEHOLDER_CHARS
    return (head != "") & ~F.startswith(head, F.lit("data:image/svg+xml;")) & small


def is_image_url(src: Column) -> Column:
    """Not a data: url, and an image by its ending or by a word in it."""
    plain = trim_space(src)
    named = plain.rlike(r"(?d)(?i:\.(jpg|jpeg|png|webp|gif|avif)(\?.*)?\z)|image|img|photo")
    return ~F.startswith(src, F.lit("data:")) & named


def first_of_srcset(srcset: Column) -> Column:
    """The first url of a srcset that is no drawing; urls may hold commas.  Empty where there is none."""
    srcset = trim_space(srcset)
    entries = F.regexp_extract_all(srcset, F.lit(r"(?d)(.+?)\s+\d+(?:\.\d+)?[wx]"), F.lit(1))
    entries = F.transform(entries, lambda e, i: trim_space(F.when(i > 0, F.regexp_replace(e, "^[, ]+", "")).otherwise(e)))
    entries = F.filter(entries, lambda e: (e != "") & ~is_svg_data(e))
    alone = F.regexp_extract(srcset, r"^(\S+)", 1)
    return F.when(F.size(entries) > 0, F.get(entries, F.lit(0))).when(~is_svg_data(alone), alone).otherwise(F.when(srcset.isNotNull(), ""))


def is_caption(text: Column) -> Column:
    """Ten bytes or more that are no url, file name, number or ISO date."""
    text = trim_space(text)
    empty = text.rlike(r"^https?://|(?i)^[\w\-./\\]+\.(jpg|jpeg|png|gif|webp|svg)\z|^\d+\z|^\d{4}-\d{2}-\d{2}\z")
    return (F.octet_length(text) >= 10) & ~empty


def is_decorative(width: Column, height: Column, classes: Column, src: Column) -> Column:
    """An image that is small by its attributes, decorates by its class or counts readers; nulls are attributes that lack."""

    def small(side: Column) -> Column:
        return F.coalesce(side.rlike(r"^[+-]?\d+\z") & (side.try_cast("long") < DECORATIVE_PX), F.lit(False))

    named = F.coalesce(F.lower(classes).rlike("|".join(DECORATIVE)), F.lit(False))
    return small(width) | small(height) | named | F.coalesce(is_tracking_pixel(src), F.lit(False))
