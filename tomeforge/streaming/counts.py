"""Anchor counts kept up to date while page files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tomeforge.operators.counts import anchor_counts_flat


def page_stream(spark: SparkSession, path: str, schema: str = "page_id bigint, title string, is_redirect boolean, redirect_to string, text string") -> DataFrame:
    """Parquet files of pages under `path`, as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def count_stream(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Add each batch's (surface, entity, n) to the Parquet table `target`, once for each batch number.

    Counts add up, so a reader sums over batches; the state is the table and nothing is held in memory.
    """

    def add(batch: DataFrame, number: int) -> None:
        anchor_counts_flat(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
