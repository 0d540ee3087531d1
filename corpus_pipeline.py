"""From raw documents to packed training sequences: five operators, each over what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomeforge.llm import decontaminate, ngram_join, packing, pii, toxicity
from tomeforge.llm.common import written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model, trained on the labels, doesn't reject.

    Null and empty texts stay, whatever their id; repeated rows go or stay together. Without labels of
    both classes, or without documents, nothing is rejected.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id.

    Rows with a null id and texts without words stay; rows that repeat an id go or stay together. No
    documents give none.
    """
    return ngram_join.drop_near_copies(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts, and those with a null id, hold none and stay; repeated rows go or stay together;
    an empty benchmark or no documents are no special case.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars set anew where a text changed.

    Null and empty texts stay as they are; overlaps go to the better scored span, then the longer, then
    the earlier; repeated rows change alike; no documents give none.
    """
    return pii.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every piece of every document and their place in sequences of 2,048 tokens.

    Null and empty texts are an end mark alone; null ids are kept; repeated rows are packed as often as
    they occur; ties in length go by id, piece and row; no documents give none.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_copies", near_copies_out),
    ("decontamination", leaks_out),
    ("pii", private_out),
    ("packing", packed),
]

#: SQL can train neither the model of the first stage nor fill bins by first fit; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
