"""Page corpus scan. A page that cannot be used becomes a status row, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.functions.urls import site_of, with_scheme
from pagetables.sources.charsets import charset_of, decoded

MAX_HTML_BYTES = 5_000_000


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", content_type: str | None = None) -> DataFrame:
    """page_id, url, html of a crawled corpus.

    Where `html` holds bytes, they are read by their charset (`charset_of`); `content_type` names the column with the
    content type of the answer, if there is one. Text is taken as it is. What cannot be read is replaced.
    """
    rows = spark.read.format(fmt).load(path)
    if rows.schema["html"].dataType.typeName() != "binary":
        return rows.select("page_id", "url", F.make_valid_utf8(F.col("html").cast("string")).alias("html"))
    return decode_pages(rows, content_type)


def decode_pages(rows: DataFrame, content_type: str | None = None) -> DataFrame:
    """page_id, url, html of pages whose `html` holds bytes."""
    known = rows.withColumn("_charset", charset_of("html", None if content_type is None else F.col(content_type)))
    return known.select("page_id", "url", decoded("html", F.col("_charset")).alias("html"))


def read_page_files(spark: SparkSession, path: str, url: Column | None = None) -> DataFrame:
    """Raw files as pages, read by their byte order mark or meta charset.

    `url` gives a page's address from `path`; by default the last part of the path is the percent-encoded address.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.html?$", "")
    named = files.withColumn("_name", name)
    return decode_pages(named.select(
        F.xxhash64("path").alias("page_id"),
        (F.expr("coalesce(try_url_decode(_name), _name)") if url is None else url).alias("url"),
        F.col("content").alias("html"),
    ))


def page_status(pages: DataFrame, max_bytes: int = MAX_HTML_BYTES) -> DataFrame:
    """Status of every page: ok, or the reason why it is left out."""
    size = F.octet_length("html")
    site = site_of(with_scheme("url"))
    reason = (
        F.when(site.isNull(), F.lit("invalid address"))
        .when(F.col("html").isNull(), F.lit("no content"))
        .when(size > max_bytes, F.lit("page too large"))
        .otherwise(F.lit("ok"))
    )
    return pages.select(
        "page_id", "url", site.alias("site"), size.alias("n_bytes"), reason.alias("status")
    )


def usable_pages(pages: DataFrame, max_bytes: int = MAX_HTML_BYTES) -> DataFrame:
    """Pages that pass the status check, cheap tests first, plus their site."""
    return (
        pages.filter(F.col("html").isNotNull() & (F.octet_length("html") <= max_bytes))
        .withColumn("site", site_of(with_scheme("url")))
        .filter(F.col("site").isNotNull())
    )
