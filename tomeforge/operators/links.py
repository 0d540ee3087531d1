"""What pages hold: their anchors and categories, the edges between them, redirects and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.functions import wikitext as W
from tomeforge.sources.dumps import articles


def page_records(pages: DataFrame) -> DataFrame:
    """(title, id, anchors, categories) of every article; ids are text."""
    return articles(pages).select(
        "title", F.col("page_id").cast("string").alias("id"), W.page_anchors(F.col("text")).alias("anchors"), W.page_categories(F.col("text")).alias("categories")
    )


def index_documents(pages: DataFrame) -> DataFrame:
    """(page_id, title, text) of every article."""
    return articles(pages).select("page_id", "title", "text")


def page_edges(pages: DataFrame) -> DataFrame:
    """(id, title, pos, page, surface) of every article: one row for each anchor, in order from 0."""
    links = articles(pages).select(F.col("page_id").cast("string").alias("id"), "title", F.posexplode(W.link_candidates(W.before_references(F.col("text")))).alias("pos", "c"))
    return links.select("id", "title", "pos", W.anchor_page(F.col("c")).alias("page"), W.anchor_surface(F.col("c")).alias("surface"))


def page_category_rows(pages: DataFrame) -> DataFrame:
    """(id, category) of every article: one row for each category."""
    return articles(pages).select(F.col("page_id").cast("string").alias("id"), F.explode(W.page_categories(F.col("text"))).alias("category"))


def edges(records: DataFrame) -> DataFrame:
    """The rows of :func:`page_edges` from records that are stored already."""
    anchors = records.select("id", "title", F.posexplode("anchors").alias("pos", "a"))
    return anchors.select("id", "title", "pos", F.col("a.page").alias("page"), F.col("a.surface").alias("surface"))


def redirects(pages: DataFrame) -> DataFrame:
    """(from, to) of redirects that name their target and come from a valid alias."""
    named = pages.where(F.col("redirect_to").isNotNull() & W.is_valid_alias(F.col("title")))
    return named.select(F.col("title").alias("from"), F.col("redirect_to").alias("to"))


def templates(pages: DataFrame) -> DataFrame:
    """(title, page) of the template namespace, redirects included."""
    return pages.where(W.is_template_title(F.col("title")) & F.col("text").isNotNull()).select("title", F.col("text").alias("page"))
