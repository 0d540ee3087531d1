"""Whole runs over a dump, each step left out where its result exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomeforge.operators import counts, links, search, sinks
from tomeforge.sources import dumps, indices
from tomeforge.sources.settings import Settings


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing at `path`."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def page_indices(spark: SparkSession, settings: Settings) -> DataFrame:
    """(offset, page_ids), built once in compact lines."""
    if not exists(spark, settings.page_indices):
        sinks.write_lines(indices.pages_by_offset(indices.read_index(spark, settings.index)), settings.page_indices, indices.compact_lines)
    return indices.read_compact(spark, settings.page_indices)


def template_indices(spark: SparkSession, settings: Settings) -> DataFrame:
    if not exists(spark, settings.template_indices):
        sinks.write_lines(indices.templates_by_offset(spark.read.text(settings.index)), settings.template_indices, indices.compact_lines)
    return indices.read_compact(spark, settings.template_indices)


def build_counts(spark: SparkSession, settings: Settings) -> None:
    """Indices, the templates file and the ordered anchor counts."""
    page_indices(spark, settings)
    chosen = template_indices(spark, settings)
    if not exists(spark, settings.templates):
        from tomeforge.sources.multistream import read_pages_at

        sinks.write_lines(links.templates(read_pages_at(settings.dump, chosen)), settings.templates, sinks.templates_text)
    if not exists(spark, settings.anchor_counts):
        sinks.write_counts(counts.anchor_counts_flat(_pages(spark, settings)), settings.anchor_counts)


def _pages(spark: SparkSession, settings: Settings) -> DataFrame:
    return dumps.pages_of(dumps.read_dump(spark, settings.dump))


def build_index(spark: SparkSession, settings: Settings) -> None:
    """The search index of all articles; a rerun replaces it whole."""
    sinks.write_index(search.build_index(_pages(spark, settings)), settings.search_index)


def extend_index(spark: SparkSession, settings: Settings) -> int:
    """Add the articles whose ids the index doesn't have yet, and say how many; it is built where there is none."""
    found = search.build_index(_pages(spark, settings))
    if not exists(spark, settings.search_index):
        sinks.write_index(found, settings.search_index)
        return spark.read.parquet(settings.search_index).count()
    before = spark.read.parquet(settings.search_index)
    had = before.count()
    sinks.write_index(found.join(before.select("id"), "id", "left_anti"), settings.search_index, more=True)
    return spark.read.parquet(settings.search_index).count() - had


def write_anchors(spark: SparkSession, settings: Settings) -> None:
    """One line for each anchor of each article."""
    sinks.write_lines(links.page_edges(_pages(spark, settings)), settings.anchors, sinks.edges_tsv)


#: What :func:`write_rows` can write: lines from the pages of a dump.
ROWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pages": lambda pages: sinks.pages_json(links.page_records(pages)),
    "categories": lambda pages: sinks.categories_tsv(links.page_records(pages)),
    "categories-json": lambda pages: sinks.categories_jsonl(links.page_records(pages)),
    "anchors-json": lambda pages: sinks.anchors_jsonl(links.page_records(pages)),
    "redirects": lambda pages: sinks.redirects_tsv(links.redirects(pages)),
}


def write_rows(spark: SparkSession, settings: Settings, name: str, path: str) -> None:
    """Lines of one kind of `ROWS`, or ``titles`` from the dump's index, as text."""
    if name == "titles":
        sinks.write_lines(indices.titles_of(spark.read.text(settings.index)), path, sinks.title_ids_tsv)
    else:
        sinks.write_lines(_pages(spark, settings), path, ROWS[name])
