"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCRIPTS = r"\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}"
CJK = f"[{_SCRIPTS}]"
#: No character of those scripts comes before; a range is tested much faster than scripts.
_MAY_BE_CJK = r"[\x{1100}-\x{10FFFF}]"


def count_words(text: Column | str) -> Column:
    """Runs of non-space count one; every Han, Hangul, Hiragana or Katakana character too."""
    text = F.col(text) if isinstance(text, str) else text
    runs = lambda t: F.regexp_count(t, F.lit(r"(?U)\S+"))
    cjk = F.regexp_count(text, F.lit(CJK)) + runs(F.regexp_replace(text, CJK, " "))
    return F.when(text.rlike(_MAY_BE_CJK), cjk).otherwise(runs(text)).cast("int")


def in_run(char: Column) -> Column:
    """Whether one character belongs to a run of non-space, as ``count_words`` counts them."""
    return char.rlike(rf"(?U)^[^\s{_SCRIPTS}]")


def is_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z", "")


def is_word_char(char: Column) -> Column:
    """Starts with an ASCII letter, digit or underscore."""
    return char.rlike("^[0-9A-Za-z_]")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty; else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def clean_title(title: Column, site: Column) -> Column:
    """Without a trailing ``| Site`` or a leading ``Site |`` part (also - – —), any case."""
    mark = r"\s*[|\-–—]\s*"
    quoted = F.concat(F.lit("\\Q"), site, F.lit("\\E"))
    after = F.regexp_replace(title, F.concat(F.lit("(?i)" + mark), quoted, F.lit(r"\s*$")), F.lit(""))
    before = F.regexp_replace(title, F.concat(F.lit(r"(?i)^\s*"), quoted, F.lit(mark)), F.lit(""))
    return F.trim(F.when(F.coalesce(site, F.lit("")) == "", title).when(after != title, after).otherwise(before))


def language_code(code: Column) -> Column:
    return F.translate(code, "_", "-")


def date_text(text: Column) -> Column:
    """The first date of a short text: ISO, ``3 May 2020`` or ``May 3, 2020``; else empty."""
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    pattern = rf"(?i)(\d{{4}}-\d{{2}}-\d{{2}}[T0-9:.+Z\-]*|\d{{1,2}}\s+{month}\s+\d{{4}}|{month}\s+\d{{1,2}},?\s+\d{{4}})"
    return F.when(F.octet_length(text) <= 200, F.regexp_extract(text, pattern, 1)).otherwise("")


#: Months as a byline spells them.
MONTHS = "January February March April May June July August September October November December".split()


def posted_date(text: Column) -> Column:
    """The day of the first ``Posted May 3, 2020`` as 2020-05-03; else empty."""
    day = F.regexp_extract(text, r"(?i)Posted\s+(\w+\s+\d{1,2},\s+\d{4})", 1)
    parts = rf"^({'|'.join(MONTHS)}) \s*(\d{{1,2}}), \s*(\d{{4}})"
    month, date, year = (F.regexp_extract(day, parts, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("string")
    return F.when(month == "", "").otherwise(F.concat_ws("-", year, F.lpad(number, 2, "0"), F.lpad(date, 2, "0")))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` code points, then an ellipsis."""
    return F.when(F.char_length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)


def tidy_markdown(text: Column) -> Column:
    """Drop a leading first-level heading and empty links, unglue ``!`` from images, cap blank lines."""
    text = F.regexp_replace(text, r"^\s*# [^\n]*\n+", "")
    text = F.regexp_replace(text, r"(?<!!)\[\s*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"!(?=!\[)", "! ")
    return F.btrim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))
