"""Lookups in counts: exact, by prefix, by regular expression, and by likelihood.

Tables written by :func:`tomeforge.operators.sinks.write_counts` are ordered by surface, so
equality and prefixes skip row groups by their statistics, and so does a regular expression that
begins with plain characters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.functions import wikitext as W
from tomeforge.operators.counts import commonness
from tomeforge.sources.shared import kept


def entities_for(counts: DataFrame, surface: str) -> DataFrame:
    """(entity, n) of one surface form."""
    return counts.where(F.col("surface") == surface).select("entity", "n")


def fetch_one(counts: DataFrame, surface: str) -> DataFrame:
    """(key, n): the rows of one surface form under their joined keys."""
    return counts.where(F.col("surface") == surface).select(W.pair_key(F.col("surface"), F.col("entity")).alias("key"), "n")


def plain_beginning(pattern: str) -> str:
    """Characters that every match of the pattern begins with; none where it has alternatives, groups or classes first."""
    if "|" in pattern:
        return ""
    plain = re.match(r"[\w ]*", pattern).group()
    return plain[:-1] if pattern[len(plain) : len(plain) + 1] in ("*", "?", "{", "+") else plain


def by_regex(counts: DataFrame, pattern: str) -> DataFrame:
    """(entity, n) of all surfaces that match the whole pattern; of several with one entity the last surface counts."""
    key = W.pair_key(F.col("surface"), F.col("entity"))
    if plain := plain_beginning(pattern):
        counts = counts.where(F.col("surface").startswith(plain))
    return counts.where(key.rlike(f"(?s)^(?:{pattern})\t.*$")).groupBy("entity").agg(F.max_by("n", "surface").alias("n"))


def by_prefix(counts: DataFrame, prefix: str) -> DataFrame:
    """(key, entity, n) of the keys that begin with the prefix, by count, then entity.

    A prefix with a tab names its surface in full, which Parquet statistics can use; otherwise
    surfaces that begin with it are those whose keys do.
    """
    surface, tab, entity = prefix.partition("\t")
    found = counts.where(F.col("surface") == surface).where(F.col("entity").startswith(entity)) if tab else counts.where(F.col("surface").startswith(surface))
    return found.select(W.pair_key(F.col("surface"), F.col("entity")).alias("key"), "entity", "n").orderBy("n", "entity", "key")


def surface_form(matches: DataFrame, text: str) -> DataFrame:
    """One row (text, anchors, wiki_occurrences) from (entity, n); no match gives an empty map and 0."""
    entries = F.array_sort(F.collect_list(F.struct("entity", F.col("n").cast("double").alias("n"))))
    return matches.agg(F.map_from_entries(entries).alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("wiki_occurrences")).select(F.lit(text).alias("text"), "anchors", "wiki_occurrences")


def wiki_matches(counts: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(surface, entity, n, commonness) at or above the threshold."""
    return commonness(counts).where(F.col("commonness") >= threshold)


def mention_commonness(mentions: DataFrame, counts: DataFrame) -> DataFrame:
    """The mentions (surface, entity, ...) with their commonness; 0 for a pair that isn't known.

    Which side is broadcast, if any, is left to Spark, which knows their sizes. Counts are read twice, so
    they are kept in the shared folder.
    """
    known = commonness(kept(counts)).select("surface", "entity", "commonness")
    return mentions.join(known, ["surface", "entity"], "left").withColumn("commonness", F.coalesce("commonness", F.lit(0.0)))


def top_entities(counts: DataFrame, k: int) -> DataFrame:
    """(surface, entity, n, place): the k most frequent entities of every surface; ties by entity."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("n"), "entity"))
    return counts.withColumn("place", place).where(F.col("place") <= k)
