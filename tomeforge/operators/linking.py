"""Entity linking after the method that Ferragina and Scaiella published (CIKM 2010): an extension.

Mentions are word n-grams that are known surface forms. Link probability is a form's uses as an
anchor over the documents that hold it, relatedness the Milne-Witten measure over in-links, and a
mention's entity the one that the other mentions of its text vote for most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeforge.functions import words
from tomeforge.operators.counts import commonness
from tomeforge.operators.search import phrases_df, postings
from tomeforge.sources.shared import kept


def longest_form(counts: DataFrame) -> int:
    """Words of the longest surface form, 1 at least."""
    return counts.agg(F.max(F.size(words.indexed_words(F.col("surface"))))).first()[0] or 1


def mentions(texts: DataFrame, counts: DataFrame, most_words: int | None = None) -> DataFrame:
    """(text_id, pos, surface): n-grams that are surface forms; `texts` is (text_id, text).

    They have up to `most_words` words, or as many as the longest form has. One scan gives all lengths.
    """
    found = F.col("_w")
    lengths = range(1, (most_words or longest_form(counts)) + 1)
    named = [F.transform(words.grams(found, k), lambda g, i: F.struct(i.alias("pos"), g.alias("surface"))) for k in lengths]
    grams = texts.select("text_id", words.indexed_words(F.col("text")).alias("_w")).select("text_id", F.explode(F.concat(*named)).alias("g"))
    grams = grams.select("text_id", F.col("g.pos").alias("pos"), F.col("g.surface").alias("surface"))
    return grams.join(counts.select("surface").distinct(), "surface", "left_semi").select("text_id", "pos", "surface")


def link_probability(counts: DataFrame, index: DataFrame) -> DataFrame:
    """(surface, link_probability): anchor uses over document frequency, 1 at most; 0 where no document holds the form.

    Uses are read several times, so they are kept in the shared folder and counted once.
    """
    uses = kept(counts.groupBy("surface").agg(F.sum("n").alias("_uses")))
    df = phrases_df(index, uses.select(F.col("surface").alias("phrase")))
    joined = uses.join(df, F.col("phrase") == F.col("surface"))
    return joined.select("surface", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("_uses") / F.col("n"))).otherwise(0.0).alias("link_probability"))


def relatedness(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, relatedness) for pairs of titles: Milne-Witten over the documents that link to both, between 0 and 1.

    A document counts once for each pair of the wanted titles that it links to, and counts are added up
    before they are shuffled: a pair never meets all documents of its titles. The counts are kept in the shared folder.
    """
    wanted = pairs.select("a", "b").distinct()
    titles = wanted.select(F.explode(F.array("a", "b")).alias("title")).distinct()
    held = postings(index).join(titles, "title", "left_semi").groupBy("id").agg(F.collect_set("title").alias("_t"))
    met = held.select("id", "_t", F.explode("_t").alias("x")).select("id", "x", F.explode("_t").alias("y")).where("x = y or x < y and id is not null")
    met = kept(met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    degree = met.where("x = y").select("x", F.col("n").alias("d"))
    total = index.agg(F.count(F.lit(1)).alias("_all"))
    sized = (
        wanted.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
        .join(met.withColumnRenamed("n", "_both"), ["x", "y"])
        .join(degree.select(F.col("x").alias("a"), F.col("d").alias("_da")), "a")
        .join(degree.select(F.col("x").alias("b"), F.col("d").alias("_db")), "b")
        .crossJoin(F.broadcast(total))  # one row
    )
    far = (F.log(F.greatest("_da", "_db")) - F.log("_both")) / (F.log("_all") - F.log(F.least("_da", "_db")))
    near = F.when(F.col("_all") == F.least("_da", "_db"), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - far))
    return wanted.join(sized.select("a", "b", near.alias("relatedness")), ["a", "b"], "left").select("a", "b", F.coalesce("relatedness", F.lit(0.0)).alias("relatedness"))


def link(texts: DataFrame, counts: DataFrame, index: DataFrame, least_probability: float = 0.0, least_commonness: float = 0.02, most_words: int | None = None) -> DataFrame:
    """(text_id, pos, surface, entity, score): for each mention the entity with most votes, ties by commonness, then name.

    Each other mention of the text votes for an entity by the mean, over its own senses, of relatedness
    times commonness. The score is the mean of link probability and the votes' mean (to 9 decimals); a
    text's only mention has votes of 0. What a surface form thinks of an entity doesn't depend on the
    text, so it is worked out once for all texts in which the two meet, and votes are added up by
    text and entity instead of by pairs of mentions. Only forms that the texts mention are weighed; mentions,
    their senses and votes, which follow the texts, are kept in the shared folder.
    """
    named = kept(mentions(texts, counts, most_words))
    own = kept(counts.join(named.select("surface").distinct(), "surface", "left_semi"))
    likely = link_probability(own, index).where(F.col("link_probability") >= least_probability)
    senses = commonness(own).where(F.col("commonness") >= least_commonness).select("surface", "entity", F.replace("entity", F.lit(" "), F.lit("_")).alias("a"), "commonness")
    found = kept(named.join(likely, "surface").join(senses, "surface"))
    forms = found.select("text_id", "pos", "surface").distinct().groupBy("text_id", "surface").agg(F.count(F.lit(1)).alias("_k"))
    size = forms.groupBy("text_id").agg(F.sum("_k").alias("_m"))
    met = found.select("text_id", "a").distinct().join(forms, "text_id")
    thought = met.select("a", "surface").distinct().join(senses.select("surface", F.col("a").alias("b"), F.col("commonness").alias("_c")), "surface")
    votes = kept(thought.join(relatedness(index, thought.select("a", "b")), ["a", "b"]).groupBy("a", "surface").agg(F.avg(F.col("relatedness") * F.col("_c")).alias("_v")))
    total = met.join(votes, ["a", "surface"]).groupBy("text_id", "a").agg(F.sum(F.col("_k") * F.col("_v")).alias("_s"))
    scored = found.join(total, ["text_id", "a"]).join(votes, ["a", "surface"]).join(size, "text_id")
    mean = F.when(F.col("_m") > 1, F.round((F.col("_s") - F.col("_v")) / (F.col("_m") - 1), 9)).otherwise(0.0)
    best = F.row_number().over(Window.partitionBy("text_id", "pos", "surface").orderBy(F.desc("votes"), F.desc("commonness"), "entity"))
    ranked = scored.withColumn("votes", mean).withColumn("_n", best).where("_n = 1")
    return ranked.select("text_id", "pos", "surface", "entity", ((F.col("link_probability") + F.col("votes")) / 2).alias("score"))
