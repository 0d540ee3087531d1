"""Separated text of anchors, and wiki-shaped views of plain document and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_anchor_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(surface, entity) from tab-separated anchors: the last two fields; lines of one field have no entity and are left out."""
    line = F.col(column)
    fields = F.struct(F.substring_index(F.substring_index(line, "\t", -2), "\t", 1).alias("surface"), F.substring_index(line, "\t", -1).alias("entity"))
    # exploded instead of filtered: a filter would work out the line a second time where it is computed
    return lines.select(F.inline(F.when(F.contains(line, F.lit("\t")), F.array(fields))))


def read_anchor_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_anchor_lines(spark.read.text(path))


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, is_redirect, redirect_to, text) from web pages: their relative links become wiki links. No HTML is an empty text."""
    linked = F.regexp_replace("html", '<a href="/([^"]*)">([^<]*)</a>', "[[$1|$2]]")
    return pages.select("page_id", F.col("url").alias("title"), F.lit(False).alias("is_redirect"), F.lit(None).cast("string").alias("redirect_to"), F.coalesce(linked, F.lit("")).alias("text"))


def spread(frame: DataFrame) -> DataFrame:
    """The rows over all cores where the files give fewer tasks than there are, as one small row group does.

    Large inputs have more splits than the cluster has cores and stay as they are.
    """
    wanted = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= wanted else frame.repartition(wanted)


#: What a title of a source begins with.
NAMESPACES = {"src0": "Template:", "src1": "File:", "src2": "Wikipedia:", "src3": "List of ", "src4": "Portal:", "src5": "User talk:"}
#: Documents of fewer characters stand for redirects, as those are the shortest pages of a wiki.
REDIRECT_CHARS = 300


def document_pages(documents: DataFrame) -> DataFrame:
    """(page_id, title, is_redirect, redirect_to, text) from documents, marked up as wiki pages.

    A capitalised word and the next become a link with a fragment and a label, a sentence's last
    word three links one of which is nested, the words behind a comma five that a flat counter
    takes or leaves for what is written in them, and the language and source categories behind a
    references heading. Sources stand for namespaces. A document without text, language or source
    is a page with an empty text: known not to be null, so no filter computes the markup a second time.
    """
    prefix = F.lit("")
    for source, name in NAMESPACES.items():
        prefix = F.when(F.col("source") == source, F.lit(name)).otherwise(prefix)
    body = F.regexp_replace("text", "([A-Z][a-z]+) ([a-z]+)", "[[$1#sec| $2 ]]")
    body = F.regexp_replace(body, " ([a-z]+)[.]", " [[$1]] [[:File:$1]] [[File:$1.jpg|thumb|see [[$1]]]].")
    body = F.regexp_replace(body, ", ([a-z]+) ([a-z]+)", ", [[$1<b]] [[$2|see User talk:$1]] [[Talk File talk:$2]] [[ :$1]] [[<$2]] ")
    short = F.col("n_chars") < REDIRECT_CHARS
    return documents.select(
        F.col("doc_id").alias("page_id"),
        F.concat(prefix, F.col("source"), F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
        F.coalesce(short, F.lit(False)).alias("is_redirect"),
        F.when(short, F.concat(F.col("source"), F.lit(" "), (F.col("doc_id") + 1).cast("string"))).alias("redirect_to"),
        F.coalesce(F.concat(body, F.lit("==References== [[Category:"), F.col("lang"), F.lit("|k]] [[Category:"), F.col("source"), F.lit("]]")), F.lit("")).alias("text"),
    )
