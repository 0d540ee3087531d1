"""Output: rows as text in one column `value`, and writers to Parquet and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions import wikitext as W
from tomeforge.operators.links import edges


def pages_json(records: DataFrame) -> DataFrame:
    """One JSON object a page; an anchor is {"Direct": page} or {"Label": {"surface", "page"}}."""

    def tagged(a: Column) -> Column:
        label = F.when(a["surface"].isNotNull(), F.struct(a["surface"].alias("surface"), a["page"].alias("page")))
        return F.struct(F.when(a["surface"].isNull(), a["page"]).alias("Direct"), label.alias("Label"))

    page = F.struct("title", "id", F.transform("anchors", tagged).alias("anchors"), "categories")
    return records.select(F.to_json(page, {"ignoreNullFields": "true"}).alias("value"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))


def categories_tsv(records: DataFrame) -> DataFrame:
    """id, title and quoted categories; quotes inside get a backslash."""
    names = F.array_join(F.transform("categories", _quoted), ",")
    return records.select(F.concat_ws("\t", "id", "title", names).alias("value"))


def categories_jsonl(records: DataFrame, compat: bool = False) -> DataFrame:
    """{"id", "title", "categories"}; with `compat`, the older form of an unquoted id, an unescaped title and a comma behind."""
    if compat:
        names = F.array_join(F.transform("categories", _quoted), ",")
        return records.select(F.concat(F.lit('{"id":'), F.col("id"), F.lit(',"title":"'), F.col("title"), F.lit('","categories":['), names, F.lit("]},")).alias("value"))
    return records.select(F.to_json(F.struct("id", "title", "categories")).alias("value"))


def anchors_tsv(records: DataFrame) -> DataFrame:
    """id, title, surface and page of each anchor; without a label the page stands for it."""
    return edges_tsv(edges(records))


def edges_tsv(rows: DataFrame) -> DataFrame:
    """The same lines from (id, title, page, surface)."""
    return rows.select(F.concat_ws("\t", "id", "title", F.coalesce("surface", "page"), "page").alias("value"))


def anchors_jsonl(records: DataFrame, compat: bool = False) -> DataFrame:
    """{"id", "title", "anchors"} with target pages alone; `compat` as for categories."""
    targets = F.transform("anchors", lambda a: a["page"])
    if compat:
        names = F.array_join(F.transform(targets, _quoted), ",")
        return records.select(F.concat(F.lit('{"id":'), F.col("id"), F.lit(',"title":"'), F.col("title"), F.lit('","anchors":['), names, F.lit("]},")).alias("value"))
    return records.select(F.to_json(F.struct("id", "title", targets.alias("anchors"))).alias("value"))


def redirects_tsv(redirects: DataFrame) -> DataFrame:
    return redirects.select(F.concat_ws("\t", "from", "to").alias("value"))


def templates_text(templates: DataFrame) -> DataFrame:
    return templates.select(W.template_text(F.col("title"), F.col("page")).alias("value"))


def title_ids_tsv(titles: DataFrame) -> DataFrame:
    return titles.select(F.concat_ws("\t", F.col("page_id").cast("string"), "title").alias("value"))


def counts_tsv(counts: DataFrame, least: int = 2) -> DataFrame:
    """surface, entity and count of the pairs that occur `least` times or more."""
    return counts.where(F.col("n") >= least).select(F.concat_ws("\t", "surface", "entity", F.col("n").cast("string")).alias("value"))


def key_counts(counts: DataFrame) -> DataFrame:
    """(key, n) by key in byte order, which is Spark's order of strings."""
    return counts.select(W.pair_key(F.col("surface"), F.col("entity")).alias("key"), "n").orderBy("key")


def write_lines(rows: DataFrame, path: str, formatter: Callable[[DataFrame], DataFrame] | None = None, compression: str = "none") -> None:
    """Write `formatter(rows)`, or the rows, as lines of text: one file for each partition."""
    (rows if formatter is None else formatter(rows)).write.mode("overwrite").option("compression", compression).text(path)


def print_lines(rows: DataFrame, write: Callable[[str], object]) -> None:
    """Hand the lines to `write`, a partition at a time, without line ends."""
    for row in rows.toLocalIterator():
        write(row[0])


def write_counts(counts: DataFrame, path: str) -> None:
    """Parquet ordered by surface and entity, so that lookups skip files and row groups."""
    counts.repartitionByRange("surface", "entity").sortWithinPartitions("surface", "entity").write.mode("overwrite").parquet(path)


def write_index(index: DataFrame, path: str, more: bool = False) -> None:
    """The index as Parquet; with `more`, its documents are added to those that are there, all or none of them."""
    index.write.mode("append" if more else "overwrite").parquet(path)


def write_dump(pages: DataFrame, path: str, compression: str = "bzip2") -> None:
    """(page_id, title, is_redirect, redirect_to, text) as XML files that :func:`tomeforge.sources.dumps.read_dump` reads."""
    redirect = F.when(F.col("is_redirect"), F.struct(F.coalesce("redirect_to", F.lit("")).alias("_title")))
    text = F.when(F.length("text") > 0, F.struct(F.struct(F.lit("preserve").alias("_space"), F.col("text").alias("_VALUE")).alias("text")))
    rows = pages.select("title", F.col("page_id").alias("id"), redirect.alias("redirect"), text.alias("revision"))
    rows.write.mode("overwrite").format("xml").options(rowTag="page", rootTag="mediawiki", compression=compression).save(path)


def dump_xml(pages: DataFrame) -> DataFrame:
    """(page_id, title, value): a <page> element for each of (page_id, title, is_redirect, redirect_to, text); what is null or empty is left out."""

    def escaped(value: Column) -> Column:
        for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
            value = F.replace(value, F.lit(raw), F.lit(name))
        return value

    def element(head: str, value: Column, tail: str) -> Column:
        return F.coalesce(F.concat(F.lit(head), value, F.lit(tail)), F.lit(""))

    redirect = F.when(F.col("is_redirect"), F.coalesce(F.concat(F.lit('<redirect title="'), escaped(F.col("redirect_to")), F.lit('" />')), F.lit("<redirect />"))).otherwise("")
    text = element('<revision><text xml:space="preserve">', F.nullif(escaped(F.col("text")), F.lit("")), "</text></revision>")
    page = F.concat(F.lit("<page>"), element("<title>", escaped(F.col("title")), "</title>"), element("<id>", F.col("page_id").cast("string"), "</id>"), redirect, text, F.lit("</page>"))
    return pages.select("page_id", "title", page.alias("value"))
