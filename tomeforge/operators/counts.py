"""How often a surface form stands for an entity, and what follows from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions import wikitext as W
from tomeforge.sources.dumps import articles, raw_pages


def _count(keys: DataFrame) -> DataFrame:
    """Partial counts before the shuffle, so a frequent pair crosses once for each task."""
    return keys.groupBy("surface", "entity").agg(F.count(F.lit(1)).alias("n"))


def _keys(links: DataFrame) -> DataFrame:
    """(surface, entity) of raw links (c)."""
    # named first: what is read twice would be worked out twice
    parsed = links.select(W.anchor_page(F.col("c")).alias("page"), W.anchor_surface(F.col("c")).alias("label"))
    return parsed.select(W.surface_key(F.col("page"), F.col("label")).alias("surface"), W.entity_key(F.col("page")).alias("entity"))


def _raw_links(pages: DataFrame, filter_titles: bool) -> DataFrame:
    # exploded in place: a named array would first be filtered by its size, which computes it twice
    return raw_pages(pages, filter_titles).select(F.explode(W.link_candidates(F.col("text"))).alias("c"))


def anchor_counts_flat(pages: DataFrame, filter_titles: bool = False) -> DataFrame:
    """(surface, entity, n) over whole raw texts, without links that begin with ``:`` or ``<`` or name a talk namespace anywhere."""
    return _count(_keys(_raw_links(pages, filter_titles).where(W.counts_in_flat(F.col("c")))))


def anchor_counts_raw(pages: DataFrame, filter_titles: bool = False) -> DataFrame:
    """(surface, entity, n) over whole raw texts, with all targets."""
    return _count(_keys(_raw_links(pages, filter_titles)))


def nest(counts: DataFrame) -> DataFrame:
    """(surface, entities): a map from entity to count, by entity, for each surface."""
    entries = F.array_sort(F.collect_list(F.struct("entity", "n")))
    return counts.groupBy("surface").agg(F.map_from_entries(entries).alias("entities"))


def anchor_counts_nested(pages: DataFrame, filter_titles: bool = False) -> DataFrame:
    return nest(anchor_counts_raw(pages, filter_titles))


def anchor_counts_page(pages: DataFrame) -> DataFrame:
    """(surface, entity, n) over articles' bodies, ahead of the last references heading."""
    return _count(_keys(articles(pages).select(F.explode(W.link_candidates(W.before_references(F.col("text")))).alias("c"))))


def anchor_counts_lines(anchors: DataFrame) -> DataFrame:
    """(surface, entity, n) of parsed anchor lines, as they stand."""
    return _count(anchors)


def merge_counts(*counts: DataFrame) -> DataFrame:
    """The sum of several count tables."""
    both = counts[0].select("surface", "entity", "n")
    for other in counts[1:]:
        both = both.unionByName(other.select("surface", "entity", "n"))
    return both.groupBy("surface", "entity").agg(F.sum("n").alias("n"))


def at_least(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("n") >= least)


def occurrences(counts: DataFrame) -> DataFrame:
    """(surface, wiki_occurrences): all uses of a surface form."""
    return counts.groupBy("surface").agg(F.sum("n").cast("double").alias("wiki_occurrences"))


def commonness(counts: DataFrame) -> DataFrame:
    """(surface, entity, n, commonness): the share of a surface form's uses that stand for the entity.

    Sums are aggregated and joined, not windowed: a surface with very many entities is then
    summed before the shuffle, and a join's hot key can be split by adaptive execution.
    """
    total = counts.groupBy("surface").agg(F.sum("n").alias("_total"))
    return counts.join(total, "surface").select("surface", "entity", "n", (F.col("n") / F.col("_total")).alias("commonness"))


def surface_forms(counts: DataFrame) -> DataFrame:
    """(text, anchors, wiki_occurrences): each surface form with a map of its entities' counts."""
    entries = F.array_sort(F.collect_list(F.struct("entity", F.col("n").cast("double").alias("n"))))
    grouped = counts.groupBy(F.col("surface").alias("text")).agg(F.map_from_entries(entries).alias("anchors"), F.sum("n").cast("double").alias("wiki_occurrences"))
    return grouped


def is_empty(anchors: Column) -> Column:
    return F.cardinality(anchors) == 0


def surface_sources(counts: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(surface, entity, n, source): anchors, titles and redirects as ways to name an entity.

    An extension: the plan of it is known, but no result to compare with.
    """
    titles = pages.where(~F.col("is_redirect")).select(F.lower("title").alias("surface"), F.col("title").alias("entity"), F.lit(0).cast("bigint").alias("n"), F.lit("title").alias("source"))
    aliases = redirects.select(F.lower("from").alias("surface"), F.col("to").alias("entity"), F.lit(0).cast("bigint").alias("n"), F.lit("redirect").alias("source"))
    return counts.select("surface", "entity", "n", F.lit("anchor").alias("source")).unionByName(titles).unionByName(aliases)
