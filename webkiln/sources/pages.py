"""Where pages come from and where records go."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 5 * 1024 * 1024


#: Names of further charsets that pages use, and the codecs that read them.
CHARSETS = {
    **{f"{w}-{n}": f"cp{n}" for w in ("windows", "x-cp") for n in (874, *range(1250, 1259))},
    **{f"cp{n}": f"cp{n}" for n in (866, 874, 932, 936, 949, 950, *range(1250, 1259))},
    **{f"iso-8859-{n}": f"iso8859_{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)},
    "iso-8859-9": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874", "latin2": "iso8859_2", "latin5": "cp1254",
    "koi8-r": "koi8_r", "koi8-u": "koi8_u", "ibm866": "cp866", "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic",
    "gbk": "gb18030", "gb2312": "gb18030", "gb18030": "gb18030", "x-gbk": "gb18030", "big5": "big5hkscs", "big5-hkscs": "big5hkscs",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "euc-jp": "euc_jp",
    "x-euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "windows-949": "cp949",
}


@F.pandas_udf(T.StringType())
def _decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes that a charset does not know become U+FFFD."""
    return pd.Series([None if b is None else bytes(b).decode(CHARSETS[c], "replace") for b, c in zip(body, charset, strict=True)], dtype=object)


def check_path(path: str) -> str:
    """Refuse paths that climb out of their folder."""
    if ".." in path.replace("\\", "/").split("/"):
        raise ValueError("directory traversal: " + path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet pages with page_id, url and html."""
    return spark.read.parquet(check_path(path)).select("page_id", "url", "html")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML files, one page each; the url is unknown and the id is the path's hash."""
    files = spark.read.text(check_path(path), wholetext=True)
    return files.select(F.xxhash64("_metadata.file_path").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("value").alias("html"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed urls of a list, without blank lines and # comments."""
    lines = spark.read.text(check_path(path)).select(F.trim("value").alias("url"))
    return lines.filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def decode_bodies(bodies: DataFrame) -> DataFrame:
    """(page_id, url, content_type, body binary) to pages with an ``error`` column.

    Bodies that are no HTML or too large get an error and no html; the charset comes
    from the content type, else from a meta tag in the first kilobyte, else UTF-8.
    Bodies of an unknown charset are read as UTF-8.  Bytes that do not fit the charset
    become U+FFFD.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    start = F.decode(F.substring("body", 1, 1024), "ISO-8859-1")
    named = F.coalesce(
        F.nullif(F.regexp_extract(kind, r"charset=[\"']?([a-z0-9_\-]+)", 1), F.lit("")),
        F.nullif(F.lower(F.regexp_extract(start, r"(?i)<meta[^>]+charset=[\"']?([a-z0-9_\-]+)", 1)), F.lit("")),
        F.lit("utf-8"),
    )
    latin = named.isin("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii")
    html = F.when(latin, F.decode("body", "ISO-8859-1")).when(named.isin("utf-16", "utf-16le", "utf-16be"), F.decode("body", "UTF-16")).otherwise(F.coalesce("other", F.make_valid_utf8(F.col("body").cast("string"))))
    error = F.when((kind != "") & ~kind.rlike("html|xml|text/"), F.lit("NOT_HTML")).when(F.octet_length("body") > MOST_BYTES, F.lit("TOO_LARGE"))
    known = named.isin(*CHARSETS) & error.isNull()
    bodies = bodies.withColumn("other", _decoded(F.when(known, F.col("body")), F.when(known, named)))
    return bodies.select("page_id", "url", F.when(error.isNull(), html).alias("html"), error.alias("error"))


def write_records(records: DataFrame, path: str, form: str = "parquet") -> None:
    records.write.format(form).save(check_path(path))


def project(records: DataFrame, name: str) -> DataFrame:
    """One property by name, whatever its case; an unknown name lists the known ones."""
    known = {c.lower(): c for c in records.columns}
    if name.lower() not in known:
        raise ValueError(f"unknown property {name}; known: {', '.join(sorted(known.values()))}")
    return records.select("page_id", known[name.lower()])
