import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeforge.functions import words
from tomeforge.functions import wikitext as W

SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
MARK = "==References=="


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def model_candidates(text):
    out, at = [], text.find("[[")
    while at >= 0:
        end = text.find("]]", at + 2)
        rest = text[at + 2 :]
        if end >= 0 and not rest.startswith("#") and not re.match("[A-Za-z]+:", rest):
            out.append(text[at + 2 : end])
        at = text.find("[[", at + 2)
    return out


def model_parse(c):
    if "|" in c:
        page, label = c.split("|", 1)
        return page.strip(SPACE).split("#", 1)[0], label.strip(SPACE).strip("'") or None
    whole = c.strip(SPACE)
    return (whole[: c.index("#")] if "#" in c else whole), None


def model_anchors(text):
    cut = text.rfind(MARK)
    return [model_parse(c) for c in model_candidates(text if cut < 0 else text[:cut])]


def model_categories(text):
    cut, out = text.rfind(MARK), []
    tail = text if cut < 0 else text[cut:]
    at = tail.find("[[")
    while at >= 0:
        end = tail.find("]]", at + 2)
        if end >= 0 and tail.startswith("Category:", at + 2):
            out.append(tail[at + 11 : end].split("|", 1)[0])
        at = tail.find("[[", at + 2)
    return out


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("[[File:x|see [[foo]]]]", [("foo", None)]),
        ("[[a [[b]] c]]", [("a [[b", None), ("b", None)]),
        ("[[#sec]] [[Category:X]] [[open", []),
        ("[[:File:x]]", [(":File:x", None)]),
        ("[[User talk:z]]", [("User talk:z", None)]),
        ("[[p|]]", [("p", None)]),
        ("[[p|''it'']]", [("p", "it")]),
        ("[[p|a|b]]", [("p", "a|b")]),
        ("[[p #f|s]]", [("p ", "s")]),
        ("[[  page#ab]]", [("page#a", None)]),
        ("[[  page]]", [("page", None)]),
        ("[[  page  |  label  ]]", [("page", "label")]),
        ("[[page#anchor]]", [("page", None)]),
        ("[[page#anchor|  label  ]]", [("page", "label")]),
        ("x ==References== [[y]] [[Category:K|k]]", []),
        ("", []),
    ],
)
def test_anchors(spark, text, wanted):
    assert [tuple(a) for a in one(spark, W.page_anchors(F.col("t")), t=text)] == wanted


def test_nulls_stay_null(spark):
    for column in (W.page_anchors(F.col("t")), W.page_categories(F.col("t")), W.positions_of(F.col("t"), F.lit("a")), W.utrim(F.col("t")), words.normalized(F.col("t"))):
        assert one(spark, column, t=None) is None


def test_categories_of_examples(spark):
    assert one(spark, W.page_categories(F.col("t")), t="x ==References== [[y]] [[Category:K|k]]") == ["K"]
    assert one(spark, W.page_categories(F.col("t")), t="[[[Category:X]]") == []


PIECES = st.lists(st.sampled_from(["[[", "]]", "|", "#", "File:", "Category:", MARK, " ", "'", "a", "é", "　", "\n", "[", "]", ":", "s:", "<"]), max_size=24).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=30, max_size=60))
def test_markup_against_a_model(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", W.link_candidates(F.col("t")).alias("c"), W.page_anchors(F.col("t")).alias("a"), W.page_categories(F.col("t")).alias("k")).collect()
    for row in rows:
        assert row["c"] == model_candidates(row["t"])
        assert [tuple(a) for a in row["a"]] == model_anchors(row["t"])
        assert row["k"] == model_categories(row["t"])


def test_overlapping_positions(spark):
    find = W.positions_of(F.col("h"), F.col("n"))
    assert one(spark, find, h="abaabaaaababbbaaaababbaab", n="b") == [1, 4, 9, 11, 12, 13, 18, 20, 21, 24]
    assert one(spark, find, h="aaaa", n="aa") == [0, 1, 2]
    assert one(spark, find, h="x.\\E.y.\\E", n=".\\E") == [1, 6]
    for h, n in (("", "a"), ("a", ""), ("a", "ab")):
        assert one(spark, find, h=h, n=n) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abé.", max_size=30), st.text("abé.", max_size=3)), min_size=20, max_size=40))
def test_positions_against_a_model(spark, pairs):
    frame = spark.createDataFrame(pairs, "h string, n string")
    for h, n, found in frame.select("h", "n", W.positions_of(F.col("h"), F.col("n"))).collect():
        assert found == [i for i in range(len(h)) if n and h.startswith(n, i)]


def test_titles_and_kinds(spark):
    t = F.col("t")
    assert one(spark, W.is_filtered_title(t), t="User talk:x") and not one(spark, W.is_filtered_title(t), t="Talk:x")
    assert not one(spark, W.is_valid_alias(t), t="List of x") and one(spark, W.is_valid_alias(t), t="list of x")
    for text, kind in (("Image:a", "file"), ("wikt:a", "wiktionary"), ("s:a", "wikisource"), ("v:a", "wikiversity"), ("hdl:a", "handle"), ("x", None)):
        assert one(spark, W.anchor_kind(t), t=text) == kind
    assert one(spark, W.title_stripped(t), t="a (b)") == "a (b)" and one(spark, W.title_stripped(t, cut=True), t="a (b)") == "a "
    assert one(spark, W.fully_qualified_category(t), t="K") == "Category:K"


def test_keys(spark):
    t = F.col("t")
    assert one(spark, W.key_surface(t), t="a\tb\tc") == "a" and one(spark, W.key_entity(t), t="a\tb\tc") == "b\tc" and one(spark, W.key_entity(t), t="a") is None
    assert one(spark, W.surface_key(F.col("p"), F.col("s")), p=" Page ", s=None) == "page"
    assert one(spark, W.surface_key(F.col("p"), F.col("s")), p="Page", s="　The ONE ") == "the one"


def test_words(spark):
    t = F.col("t")
    assert one(spark, words.normalized(t), t="Of, THE ét-1!") == " of the ét 1 "
    assert one(spark, words.has_phrase(words.normalized(t), F.lit("one, two")), t="Zero one TWO three")
    long = "x" * 40
    assert not one(spark, words.has_phrase(words.normalized(t), F.lit("a b")), t=f"a {long} b")
    assert not one(spark, words.has_phrase(words.normalized(t), F.lit("...")), t="a b")
    assert one(spark, words.grams(words.indexed_words(t), 2), t="a b c") == ["a b", "b c"] and one(spark, words.grams(words.indexed_words(t), 2), t="a") == []
