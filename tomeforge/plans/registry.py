"""Named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions import wikitext as W
from tomeforge.operators import counts as C
from tomeforge.operators import linking, links, lookup, search, sinks
from tomeforge.plans import runs
from tomeforge.plans.oracle import SQL
from tomeforge.sources import dumps, indices, multistream, tables
from tomeforge.sources.settings import Settings
from tomeforge.sources.shared import new_path
from tomeforge.streaming import counts as streaming

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _found[function.__name__] = function
    return function


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.document_pages(tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.html_pages(tables.spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.anchor_counts_flat(_wiki(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_records(_wiki(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build_index(_wiki(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines of the document pages: some share an offset."""
    offset = F.expr("length(text) div 64").cast("string")
    return _wiki(spark, sf_dir).where("text is not null").select(F.concat(offset, F.lit(":"), F.col("page_id").cast("string"), F.lit(":"), F.col("title")).alias("value"))


def _pairs(entries) -> F.Column:
    """A map as sorted ``entity=n`` texts, which every SQL engine can tell."""
    return F.array_sort(F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("k"), F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string")).alias("v"))))


def _listed(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn(column, F.transform(_pairs(F.col(column)), lambda e: e["v"]))


@_query
def anchor_counts_flat(spark, sf_dir):
    return _flat(spark, sf_dir)


@_query
def anchor_counts_flat_html(spark, sf_dir):
    return C.anchor_counts_flat(_html(spark, sf_dir))


@_query
def anchor_counts_nested(spark, sf_dir):
    return _listed(C.anchor_counts_nested(_wiki(spark, sf_dir)), "entities")


@_query
def anchor_counts_page(spark, sf_dir):
    return C.anchor_counts_page(_wiki(spark, sf_dir))


@_query
def anchor_counts_lines(spark, sf_dir):
    return C.anchor_counts_lines(tables.parse_anchor_lines(sinks.edges_tsv(links.page_edges(_wiki(spark, sf_dir)))))


@_query
def anchor_counts_min2(spark, sf_dir):
    return sinks.counts_tsv(C.anchor_counts_page(_wiki(spark, sf_dir)))


@_query
def merged_counts(spark, sf_dir):
    wiki = _wiki(spark, sf_dir)
    return C.merge_counts(C.anchor_counts_flat(wiki), C.anchor_counts_page(wiki))


@_query
def surface_occurrences(spark, sf_dir):
    return C.occurrences(_flat(spark, sf_dir))


@_query
def commonness(spark, sf_dir):
    return C.commonness(_flat(spark, sf_dir))


@_query
def commonness_html(spark, sf_dir):
    return C.commonness(C.anchor_counts_flat(_html(spark, sf_dir)))


@_query
def wiki_matches_threshold(spark, sf_dir):
    return lookup.wiki_matches(_flat(spark, sf_dir), 0.4)


@_query
def mention_commonness(spark, sf_dir):
    edges = links.page_edges(_wiki(spark, sf_dir))
    mentions = edges.select(F.col("id").cast("bigint").alias("page_id"), F.col("pos").cast("bigint").alias("i"), W.surface_key(F.col("page"), F.col("surface")).alias("surface"), W.entity_key(F.col("page")).alias("entity"))
    return lookup.mention_commonness(mentions, _flat(spark, sf_dir))


@_query
def surface_forms(spark, sf_dir):
    return _listed(C.surface_forms(_flat(spark, sf_dir)), "anchors")


@_query
def surface_sources(spark, sf_dir):
    wiki = _wiki(spark, sf_dir)
    return C.surface_sources(C.anchor_counts_flat(wiki), wiki, links.redirects(wiki))


@_query
def key_counts(spark, sf_dir):
    return sinks.key_counts(_flat(spark, sf_dir))


@_query
def entities_for_surface(spark, sf_dir):
    return lookup.entities_for(_flat(spark, sf_dir), "of")


@_query
def fetch_one(spark, sf_dir):
    return lookup.fetch_one(_flat(spark, sf_dir), "the")


@_query
def prefix_lookup(spark, sf_dir):
    return lookup.by_prefix(_flat(spark, sf_dir), "th")


@_query
def prefix_lookup_surface(spark, sf_dir):
    return lookup.by_prefix(_flat(spark, sf_dir), "the\t")


@_query
def regex_lookup(spark, sf_dir):
    return lookup.by_regex(_flat(spark, sf_dir), "th[ae].*")


@_query
def surface_form_of(spark, sf_dir):
    return _listed(lookup.surface_form(lookup.entities_for(_flat(spark, sf_dir), "of"), "of"), "anchors")


@_query
def top_entities(spark, sf_dir):
    return lookup.top_entities(_flat(spark, sf_dir), 3)


@_query
def raw_page_scan(spark, sf_dir):
    return dumps.raw_pages(_wiki(spark, sf_dir)).select("page_id", "text")


@_query
def article_scan(spark, sf_dir):
    return links.index_documents(_wiki(spark, sf_dir))


@_query
def filtered_titles(spark, sf_dir):
    title = F.col("title")
    return _wiki(spark, sf_dir).select(
        "title", W.is_filtered_title(title).alias("hidden"), W.is_valid_alias(title).alias("valid_alias"), W.is_template_title(title).alias("is_template"),
        W.title_stripped(title).alias("stripped"), W.title_stripped(title, cut=True).alias("cut"),
    )


@_query
def link_candidates(spark, sf_dir):
    found = dumps.raw_pages(_wiki(spark, sf_dir)).select("page_id", F.posexplode(W.link_candidates(F.col("text"))).alias("pos", "link"))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@_query
def page_anchors(spark, sf_dir):
    return links.page_edges(_wiki(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


@_query
def page_categories(spark, sf_dir):
    return links.page_category_rows(_wiki(spark, sf_dir)).withColumn("qualified", W.fully_qualified_category(F.col("category")))


@_query
def anchor_kinds(spark, sf_dir):
    """Kinds of all link targets, those that the anchor scan leaves out included."""
    every = F.regexp_extract_all(W.closed_part(F.col("text")), F.lit(r"(?s)\[\[(?=(.*?)\]\])"), F.lit(1))
    targets = dumps.raw_pages(_wiki(spark, sf_dir)).select(F.explode(every).alias("c")).select(F.substring_index("c", "|", 1).alias("page"))
    return targets.groupBy("page").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", W.anchor_kind(F.col("page")))


@_query
def find_indices(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.select("doc_id", F.transform(W.positions_of(F.col("text"), F.lit("nn")), lambda i: i.cast("bigint")).alias("places"))


def _rows(formatter: Callable[[DataFrame], DataFrame], source: Query, name: str) -> None:
    _found[name] = lambda spark, sf_dir: formatter(source(spark, sf_dir))


def _outlinks(records: DataFrame) -> DataFrame:
    return records.select("id", W.outlinks(F.col("anchors")).alias("outlinks"))


for _name, _formatter in {
    "pages_json": sinks.pages_json,
    "categories_tsv": sinks.categories_tsv,
    "categories_jsonl": sinks.categories_jsonl,
    "categories_jsonl_compat": lambda r: sinks.categories_jsonl(r, compat=True),
    "anchors_jsonl": sinks.anchors_jsonl,
    "anchors_jsonl_compat": lambda r: sinks.anchors_jsonl(r, compat=True),
    "outlinks": _outlinks,
}.items():
    _rows(_formatter, _records, _name)
for _name, _formatter in {
    "anchors_tsv": lambda w: sinks.edges_tsv(links.page_edges(w)),
    "redirects": links.redirects,
    "redirects_tsv": lambda w: sinks.redirects_tsv(links.redirects(w)),
    "templates": links.templates,
    "templates_text": lambda w: sinks.templates_text(links.templates(w)),
}.items():
    _rows(_formatter, _wiki, _name)
for _name, _formatter in {
    "index_lines": indices.parse_index_lines,
    "index_by_offset": lambda x: indices.pages_by_offset(indices.parse_index_lines(x)),
    "template_index": indices.templates_by_offset,
    "compact_index": lambda x: indices.compact_lines(indices.pages_by_offset(indices.parse_index_lines(x))),
    "compact_index_read": lambda x: indices.parse_compact_lines(indices.compact_lines(indices.pages_by_offset(indices.parse_index_lines(x)))),
    "title_ids_tsv": lambda x: sinks.title_ids_tsv(indices.titles_of(x)),
}.items():
    _rows(_formatter, _lines, _name)


@_query
def nth_offset(spark, sf_dir):
    offset = indices.nth_offset(indices.parse_index_lines(_lines(spark, sf_dir)), 5)
    return spark.range(1).select(F.lit(offset).cast("bigint").alias("offset"))


@_query
def search_index(spark, sf_dir):
    return _index(spark, sf_dir)


@_query
def index_size(spark, sf_dir):
    return search.index_size(_index(spark, sf_dir))


@_query
def phrase_df(spark, sf_dir):
    return search.phrase_df(_index(spark, sf_dir), "of the")


@_query
def phrases_df(spark, sf_dir):
    wanted = spark.createDataFrame([(p,) for p in ("of the", "the", "la de", "In THE", "not in any text at all", "...")], "phrase string")
    return search.phrases_df(_index(spark, sf_dir), wanted)


@_query
def mutual_outlinks(spark, sf_dir):
    return search.mutual_outlinks(_index(spark, sf_dir), ["the", "of"])


_GROUPS = [(0, "The"), (0, "the"), (1, "of"), (1, "and"), (1, "the"), (2, "nowhere to be found")]


@_query
def mutual_outlinks_of(spark, sf_dir):
    return search.mutual_outlinks_of(_index(spark, sf_dir), spark.createDataFrame(_GROUPS, "group int, title string"))


@_query
def link_probability(spark, sf_dir):
    return linking.link_probability(_flat(spark, sf_dir), _index(spark, sf_dir))


@_query
def relatedness(spark, sf_dir):
    titles = sorted({t for _, t in _GROUPS if " " not in t})
    pairs = spark.createDataFrame([(a, b) for a in titles for b in titles if a < b], "a string, b string")
    return linking.relatedness(_index(spark, sf_dir), pairs)


@_query
def entity_links(spark, sf_dir):
    """Mentions in all texts of the benchmark, linked by what is known from the documents: an extension without a result to match.

    Counts and the index are stored first, as an application has them; every part of the plan reads them.
    """
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("text_id"), "text")
    counts = _written(spark, "counts", lambda p: sinks.write_counts(_flat(spark, sf_dir), p))
    index = _written(spark, "index", lambda p: sinks.write_index(_index(spark, sf_dir), p))
    return linking.link(texts, spark.read.parquet(counts), spark.read.parquet(index))


def _written(spark: SparkSession, name: str, write: Callable[[str], object]) -> str:
    write(path := new_path(spark, name))
    return path


@_query
def dump_pages(spark, sf_dir):
    """Pages written as a compressed XML dump and read from it."""
    path = _written(spark, "dump.xml", lambda p: sinks.write_dump(_wiki(spark, sf_dir), p))
    return dumps.pages_of(dumps.read_dump(spark, path))


def _streams(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(path of a multistream dump, its parsed index) of the document pages, 100 to a stream."""
    dump, index = new_path(spark, "streams"), new_path(spark, "index")
    dump = dump.removeprefix("file:") if dump.startswith("file:") else dump
    sinks.write_lines(multistream.write_streams(sinks.dump_xml(_wiki(spark, sf_dir)), dump), index, compression="bzip2")
    return dump, indices.read_index(spark, index)


@_query
def dump_templates(spark, sf_dir):
    """Templates from the streams that hold any, found by the index and opened by their offsets."""
    path, index = _streams(spark, sf_dir)
    chosen = index.where(W.is_template_title(F.col("title")))
    return links.templates(multistream.read_pages_at(path, chosen))


@_query
def dump_streams(spark, sf_dir):
    """(first_id, pages, lines) of every stream of a dump: its pages by the index, and its lines that begin one."""
    path, index = _streams(spark, sf_dir)
    lines = multistream.lines_of(multistream.read_streams_at(path, index)).groupBy("offset").agg(F.count_if(F.col("line").startswith("<page>")).alias("lines"))
    first = index.groupBy("offset").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("pages"))
    return lines.join(first, "offset").select("first_id", "pages", "lines")


@_query
def dump_one_stream(spark, sf_dir):
    """Titles of the stream with the second smallest offset."""
    path, index = _streams(spark, sf_dir)
    lines = multistream.lines_of(multistream.one_stream(spark, path, index, 1))
    titles = lines.select(F.regexp_extract("line", "<title>(.*?)</title>", 1).alias("title"))
    return titles.where("title <> ''")


@_query
def page_indices_stored(spark, sf_dir):
    """The index by offset, built by the first call and loaded by the second."""
    lines = _written(spark, "lines", lambda p: sinks.write_lines(_lines(spark, sf_dir), p))
    settings = Settings(dump="", index=lines, page_indices=new_path(spark, "pages"), template_indices=new_path(spark, "templates"))
    runs.page_indices(spark, settings)
    return runs.page_indices(spark, settings)


@_query
def template_indices_stored(spark, sf_dir):
    lines = _written(spark, "lines", lambda p: sinks.write_lines(_lines(spark, sf_dir), p))
    settings = Settings(dump="", index=lines, page_indices=new_path(spark, "pages"), template_indices=new_path(spark, "templates"))
    runs.template_indices(spark, settings)
    return runs.template_indices(spark, settings)


@_query
def anchor_lines_file(spark, sf_dir):
    """Counts of anchor lines that are written and read again."""
    path = _written(spark, "anchors.tsv", lambda p: sinks.write_lines(links.page_edges(_wiki(spark, sf_dir)), p, sinks.edges_tsv))
    return C.anchor_counts_lines(tables.read_anchor_lines(spark, path))


@_query
def counts_store(spark, sf_dir):
    """All counts from the ordered store."""
    path = _written(spark, "counts", lambda p: sinks.write_counts(_flat(spark, sf_dir), p))
    return spark.read.parquet(path)


@_query
def counts_store_lookup(spark, sf_dir):
    """One surface form from the ordered store, by a pushed filter."""
    path = _written(spark, "counts", lambda p: sinks.write_counts(_flat(spark, sf_dir), p))
    return lookup.entities_for(spark.read.parquet(path), "of")


@_query
def index_store_phrase(spark, sf_dir):
    """A phrase asked of a stored index, to which the second half of its documents is added later."""
    index, path = _index(spark, sf_dir), new_path(spark, "index")
    sinks.write_index(index.where("id % 2 = 0"), path)
    sinks.write_index(index.where("id % 2 <> 0 or id is null"), path, more=True)
    return search.phrase_df(spark.read.parquet(path), "of the")


@_query
def key_split(spark, sf_dir):
    keys = sinks.key_counts(_flat(spark, sf_dir))
    return keys.select(W.key_surface(F.col("key")).alias("surface"), W.key_entity(F.col("key")).alias("entity"), "n")


@_query
def form_is_empty(spark, sf_dir):
    forms = [lookup.surface_form(lookup.entities_for(_flat(spark, sf_dir), t), t) for t in ("of", "no such form")]
    return forms[0].unionByName(forms[1]).select("text", C.is_empty(F.col("anchors")).alias("is_empty"), "wiki_occurrences")


@_query
def streamed_counts(spark, sf_dir):
    """Counts of page files that arrive as a stream, summed over its batches."""
    pages = _written(spark, "arriving", lambda p: _wiki(spark, sf_dir).write.parquet(p))
    target = new_path(spark, "streamed")
    streaming.count_stream(streaming.page_stream(spark, pages), target, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).groupBy("surface", "entity").agg(F.sum("n").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commonness of every surface form."""
    return _found["commonness"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
