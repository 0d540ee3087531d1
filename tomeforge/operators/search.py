"""Search over pages: phrase frequency and common out-links.

The index is a table (id, title, content, outlinks): content as normalised words between blanks,
outlinks as an array of titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.functions import words
from tomeforge.functions import wikitext as W
from tomeforge.operators.links import index_documents


def build_index(pages: DataFrame) -> DataFrame:
    """(id, title, content, outlinks) of every article; links of the whole text count, underscores for blanks."""
    targets = F.transform(W.link_candidates(F.col("text")), lambda c: F.replace(W.anchor_page(c), F.lit(" "), F.lit("_")))
    return index_documents(pages).select(F.col("page_id").cast("bigint").alias("id"), "title", words.normalized(F.col("text")).alias("content"), targets.alias("outlinks"))


def index_size(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("n"))


def phrase_df(index: DataFrame, phrase: str) -> DataFrame:
    """One row (n): documents that hold the phrase's words next to each other; 0 for a phrase without words."""
    return index.agg(F.count_if(words.has_phrase(F.col("content"), F.lit(phrase))).alias("n"))


#: Phrases of up to so many bytes in all are sent to every task; more meet the n-grams in a shuffle.
BROADCAST_BYTES = 16 << 20
#: So many phrases are sought in the texts themselves.
FEW = 16


def phrases_df(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, n) for a table of phrases (phrase): documents' n-grams of the wanted lengths meet the phrases.

    One scan gives the n-grams of all lengths, each once a document. Those that no phrase asks for
    are dropped by a semi-join before anything is counted: a broadcast one where the phrases' size
    is within `BROADCAST_BYTES`. Up to `FEW` phrases are sought in the texts, and no n-grams are made.
    """
    wanted = phrases.select("phrase").distinct().withColumn("_p", F.trim(words.phrase_pattern(F.col("phrase"))))
    sizes = wanted.where("_p is not null").groupBy(F.size(F.split("_p", " ")).alias("k")).agg(F.sum(F.octet_length("_p") + 16).alias("b")).collect()
    if not sizes:
        return wanted.select("phrase", F.lit(0).cast("bigint").alias("n"))
    asked = wanted.where("_p is not null").select("_p").distinct()
    few = asked.limit(FEW + 1).collect()
    if len(few) <= FEW:
        held = [F.count_if(F.contains("content", F.lit(f" {r['_p']} "))).alias(f"n{i}") for i, r in enumerate(few)]
        found = F.array(*(F.struct(F.lit(r["_p"]).alias("_p"), F.col(f"n{i}").alias("n")) for i, r in enumerate(few)))
        counted = index.agg(*held).select(F.inline(found))
        return wanted.join(counted, "_p", "left").select("phrase", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    content = index.select(F.split(F.trim("content"), " ").alias("_w"))
    grams = F.array_distinct(F.concat(*(words.grams(F.col("_w"), k) for k in sorted(r["k"] for r in sizes))))
    if sum(r["b"] for r in sizes) <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    counted = content.select(F.explode(grams).alias("_p")).join(asked, "_p", "left_semi").groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counted, "_p", "left").select("phrase", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def mutual_outlinks(index: DataFrame, titles: list[str], compat: bool = False) -> DataFrame:
    """One row (n): documents that link to all titles; 0 for no titles.

    Blanks and underscores are the same. With `compat`, a title has to equal a single word of the
    linked titles, as an index of words has it.
    """
    if not titles:
        return index.agg(F.lit(0).cast("bigint").alias("n"))
    links = F.col("outlinks")
    if compat:
        links = F.flatten(F.transform(links, words.indexed_words))
    wanted = [t if compat else t.replace(" ", "_") for t in titles]
    test = F.array_contains(links, wanted[0])
    for title in wanted[1:]:
        test = test & F.array_contains(links, title)
    return index.agg(F.count_if(test).alias("n"))


def postings(index: DataFrame) -> DataFrame:
    """(title, id): each linked title once for each document."""
    return index.select("id", F.explode(F.array_distinct("outlinks")).alias("title"))


def mutual_outlinks_of(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, n) for a table of groups (group, title): documents that link to all titles of the group."""
    wanted = groups.select("group", F.replace("title", F.lit(" "), F.lit("_")).alias("title")).distinct()
    size = wanted.groupBy("group").agg(F.count(F.lit(1)).alias("_k"))
    met = postings(index).join(wanted, "title").groupBy("group", "id").agg(F.count(F.lit(1)).alias("_m"))
    full = met.join(size, "group").where(F.col("_m") == F.col("_k")).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return size.join(full, "group", "left").select("group", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
