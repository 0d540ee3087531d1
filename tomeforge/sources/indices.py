"""Dump indices: which pages a compressed stream holds, by the stream's byte offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _number(value: Column) -> Column:
    return value.try_cast("bigint")


def parse_index_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(offset, page_id, title, is_valid) of ``offset:page_id:title`` lines; a title keeps its colons.

    What isn't a number becomes null, and the line counts as invalid.
    """
    parts = F.split(F.col(column), ":", 3)
    fields = lines.select(
        _number(F.get(parts, F.lit(0))).alias("offset"), _number(F.get(parts, F.lit(1))).alias("page_id"), F.get(parts, F.lit(2)).alias("title")
    )
    return fields.withColumn("is_valid", F.col("offset").isNotNull() & F.col("page_id").isNotNull())


def read_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of index files, compressed or not, parsed."""
    return parse_index_lines(spark.read.text(path))


def pages_by_offset(index: DataFrame) -> DataFrame:
    """(offset, page_ids) of valid lines, ids ascending."""
    valid = index.where(F.col("offset").isNotNull() & F.col("page_id").isNotNull())
    return valid.groupBy("offset").agg(F.array_sort(F.collect_list("page_id")).alias("page_ids"))


def template_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that name the template namespace anywhere."""
    return lines.where(F.contains(F.col(column), F.lit("Template:")))


def templates_by_offset(lines: DataFrame, column: str = "value") -> DataFrame:
    return pages_by_offset(parse_index_lines(template_lines(lines, column), column))


def compact_lines(by_offset: DataFrame) -> DataFrame:
    """``offset id,id,...`` as one column, value."""
    ids = F.array_join(F.transform("page_ids", lambda i: i.cast("string")), ",")
    return by_offset.select(F.concat_ws(" ", F.col("offset").cast("string"), ids).alias("value"))


def parse_compact_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(offset, page_ids) from compact lines; of several lines with one offset the last one wins.

    Last is by order of files, their blocks and the lines in them.
    """
    parts = F.split(F.col(column), " ", 2)
    ids = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), ","), _number), lambda i: i.isNotNull())
    rows = lines.select(
        _number(F.get(parts, F.lit(0))).alias("offset"), ids.alias("page_ids"), F.monotonically_increasing_id().alias("_at")
    )
    return rows.where(F.col("offset").isNotNull()).groupBy("offset").agg(F.max_by("page_ids", "_at").alias("page_ids"))


def read_compact(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_compact_lines(spark.read.text(path))


def titles_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """(page_id, title) as text, from the lines with two colons at least."""
    parts = F.split(F.col(column), ":", 3)
    return lines.where(F.size(parts) == 3).select(F.get(parts, F.lit(1)).alias("page_id"), F.get(parts, F.lit(2)).alias("title"))


def nth_offset(by_offset: DataFrame, n: int) -> int | None:
    """The n-th smallest distinct offset, from 0; None if there are fewer. A bounded sort, no collection of all."""
    least = by_offset.select("offset").distinct().orderBy("offset").limit(n + 1).agg(F.max("offset"), F.count("offset")).first()
    return least[0] if least[1] == n + 1 else None
