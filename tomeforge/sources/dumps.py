"""Page dumps in XML, plain or compressed, as DataFrames.

Spark reads concatenated bzip2 streams as one file, so a full scan needs no index. For reads of
chosen streams by offset see :mod:`tomeforge.sources.multistream`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions import wikitext as W

PAGE = (
    "title string, ns int, id bigint, redirect struct<_title:string>, "
    "revision struct<id:bigint, timestamp:timestamp, contributor:struct<username:string, id:bigint, ip:string>, text:struct<_VALUE:string>>, "
    "_corrupt_record string"
)


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every <page> of the dump; one that can't be parsed has its text in _corrupt_record.

    White space around texts is kept, entities are resolved. Unknown elements are passed over.
    """
    reader = spark.read.format("xml").options(rowTag="page", ignoreSurroundingSpaces="false", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return reader.schema(PAGE).load(path)


def read_history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The pages of a dump of all revisions, a row for each revision, of the shape of :func:`read_dump`."""
    reader = spark.read.format("xml").options(rowTag="page", ignoreSurroundingSpaces="false", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    several = PAGE.replace("revision struct<", "revision array<struct<").replace("text:struct<_VALUE:string>>", "text:struct<_VALUE:string>>>")
    found = reader.schema(several).load(path)
    return found.select("title", "ns", "id", "redirect", F.explode_outer("revision").alias("revision"), "_corrupt_record")


def pages_of(dump: DataFrame, compat_ids: bool = False) -> DataFrame:
    """(page_id, title, is_redirect, redirect_to, text) of parsed pages.

    `compat_ids` takes the last id ahead of the text, the contributor's or the revision's, as the page's.
    """
    page_id = F.coalesce("revision.contributor.id", "revision.id", "id") if compat_ids else F.col("id")
    return dump.where(F.col("title").isNotNull() | F.col("id").isNotNull()).select(
        page_id.alias("page_id"),
        "title",
        F.col("redirect").isNotNull().alias("is_redirect"),
        F.col("redirect._title").alias("redirect_to"),
        F.col("revision.text._VALUE").alias("text"),
    )


def articles(pages: DataFrame) -> DataFrame:
    """Pages that are no redirects, with text and a title outside the hidden namespaces."""
    return raw_pages(pages).where(~W.is_filtered_title(F.col("title")))


def raw_pages(pages: DataFrame, filter_titles: bool = False) -> DataFrame:
    """Pages that are no redirects and have text, whatever their title; `filter_titles` leaves out hidden namespaces."""
    kept = pages.where(~F.col("is_redirect") & F.col("text").isNotNull())
    return kept.where(~W.is_filtered_title(F.col("title"))) if filter_titles else kept
