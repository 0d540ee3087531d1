import collections
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tomeforge.functions import wikitext
from tomeforge.operators import counts, linking, links, lookup, search, sinks
from tomeforge.streaming.counts import count_stream, page_stream

PAGE = "page_id bigint, title string, is_redirect boolean, redirect_to string, text string"
ROWS = [
    (1, 'He said "hi"', False, None, "[[B|the b]] [[B]] [[C|the b]] [[Category:K]]"),
    (2, "Two", False, None, "see [[B]] and [[C c]] ==References== [[D]] [[Category:K|x]] [[Category:L]]"),
    (3, "File:x", False, None, "[[B|the b]]"),
    (4, "R", True, "Two", "#REDIRECT [[Two]]"),
    (5, "List of r", True, "Two", None),
    (6, "Template:T", True, None, "[[B]]"),
    (None, None, False, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, PAGE).cache()


@pytest.fixture(scope="module")
def flat(pages):
    return counts.anchor_counts_flat(pages).cache()


def as_map(frame):
    return {(r["surface"], r["entity"]): r["n"] for r in frame.collect()}


def test_counts(pages, flat):
    assert as_map(flat) == {("the b", "B"): 2, ("b", "B"): 2, ("the b", "C"): 1, ("c c", "C c"): 1, ("d", "D"): 1}
    assert as_map(counts.anchor_counts_page(pages)) == {("the b", "B"): 1, ("b", "B"): 2, ("the b", "C"): 1, ("c c", "C c"): 1}
    nested = {r["surface"]: r["entities"] for r in counts.anchor_counts_nested(pages).collect()}
    assert nested["the b"] == {"B": 2, "C": 1}
    assert as_map(counts.merge_counts(flat, flat)) == {k: 2 * v for k, v in as_map(flat).items()}
    assert as_map(counts.at_least(flat)) == {("the b", "B"): 2, ("b", "B"): 2}
    assert {r["surface"]: r["wiki_occurrences"] for r in counts.occurrences(flat).collect()}["the b"] == 3.0


def test_the_flat_counter_looks_at_raw_links(spark):
    texts = ["[[a<b]]", "[[x|see User talk:y]]", "[[Talk User talk:z]]", "[[ :File:x]]", "[[:File:x]]", "[[<ref]]", "[[File talk: of|t]]"]
    pages = spark.createDataFrame([(i, "T", False, None, t) for i, t in enumerate(texts)], PAGE)
    assert as_map(counts.anchor_counts_flat(pages)) == {("a<b", "a<b"): 1, (":file:x", ":File:x"): 1}
    assert sum(as_map(counts.anchor_counts_raw(pages)).values()) == 7


@pytest.mark.parametrize("rows", [links.page_edges, links.page_category_rows, counts.anchor_counts_page, counts.anchor_counts_flat])
def test_markup_is_parsed_once(spark, rows):
    plan = rows(spark.createDataFrame(ROWS, PAGE))._jdf.queryExecution().optimizedPlan().toString()
    # a part of the plan is a line; its operator comes first
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert plan.count("regexp_extract_all") == 1 and not any("regexp" in f for f in filters)


def test_stored_records_give_the_same_edges(pages):
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(links.edges(links.page_records(pages)).na.fill("~")) == rows(links.page_edges(pages).na.fill("~"))


def test_plain_beginnings():
    wanted = {"the.*": "the", "th[ae].*": "th", "": "", "a*b": "", "ab?": "a", "a|b": "", "(x)": "", "of the": "of the", "x{2}": "", "ab+c": "a", "\\d": "", "ñu.": "ñu"}
    assert {p: lookup.plain_beginning(p) for p in wanted} == wanted


def test_commonness_and_lookups(spark, flat):
    share = {(r["surface"], r["entity"]): r["commonness"] for r in counts.commonness(flat).collect()}
    assert share[("the b", "B")] == pytest.approx(2 / 3) and share[("b", "B")] == 1.0
    assert lookup.wiki_matches(flat, 2 / 3).count() == 4
    asked = spark.createDataFrame([("the b", "C"), ("the b", "Z"), (None, None)], "surface string, entity string")
    assert sorted(r["commonness"] for r in lookup.mention_commonness(asked, flat).collect()) == pytest.approx([0, 0, 1 / 3])
    assert {tuple(r) for r in lookup.entities_for(flat, "the b").collect()} == {("B", 2), ("C", 1)}
    assert {r["key"] for r in lookup.fetch_one(flat, "b").collect()} == {"b\tB"}
    assert [r["n"] for r in lookup.by_prefix(flat, "the b\t").collect()] == [1, 2]
    assert {r["entity"] for r in lookup.by_prefix(flat, "the").collect()} == {"B", "C"}
    assert {tuple(r) for r in lookup.by_regex(flat, ".*b").collect()} == {("B", 2), ("C", 1)}
    form = lookup.surface_form(lookup.entities_for(flat, "the b"), "the b").first()
    assert form["anchors"] == {"B": 2.0, "C": 1.0} and form["wiki_occurrences"] == 3.0
    nothing = lookup.surface_form(lookup.entities_for(flat, "zzz"), "zzz")
    assert nothing.first()["wiki_occurrences"] == 0.0 and nothing.select(counts.is_empty(F.col("anchors"))).first()[0]
    assert lookup.top_entities(flat, 1).where("surface = 'the b'").first()["entity"] == "B"


def test_search(spark, pages):
    index = search.build_index(pages)
    assert search.index_size(index).first()[0] == 2
    assert search.mutual_outlinks(index, ["B", "C c"]).first()[0] == 1 and search.mutual_outlinks(index, ["B"]).first()[0] == 2
    assert search.mutual_outlinks(index, []).first()[0] == 0
    assert search.mutual_outlinks(index, ["c"], compat=True).first()[0] == 2 and search.mutual_outlinks(index, ["C c"], compat=True).first()[0] == 0
    assert search.phrase_df(index, "and c").first()[0] == 1 and search.phrase_df(index, "").first()[0] == 0
    asked = spark.createDataFrame([("see b",), ("!",), ("b",)], "phrase string")
    assert {r["phrase"]: r["n"] for r in search.phrases_df(index, asked).collect()} == {"see b": 1, "!": 0, "b": 2}
    assert search.phrases_df(index, asked.where("phrase = '!'")).first()["n"] == 0
    empty = search.build_index(pages.where("false"))
    assert search.index_size(empty).first()[0] == 0 and search.phrase_df(empty, "b").first()[0] == 0


def test_sinks(pages, flat, tmp_path, spark):
    records = links.page_records(pages)
    first = {json.loads(r[0])["id"]: json.loads(r[0]) for r in sinks.pages_json(records).collect()}
    assert first["1"]["anchors"] == [{"Label": {"surface": "the b", "page": "B"}}, {"Direct": "B"}, {"Label": {"surface": "the b", "page": "C"}}]
    assert first["1"]["categories"] == ["K"] and first["1"]["title"] == 'He said "hi"'
    assert sorted(r[0] for r in sinks.categories_tsv(records).collect()) == ['1\tHe said "hi"\t"K"', '2\tTwo\t"K","L"']
    assert '1\tHe said "hi"\tB\tB' in {r[0] for r in sinks.anchors_tsv(records).collect()}
    assert json.loads(sinks.anchors_jsonl(records).where("value like '%Two%'").first()[0])["anchors"] == ["B", "C c"]
    assert sinks.categories_jsonl(records, compat=True).where("value like '%Two%'").first()[0] == '{"id":2,"title":"Two","categories":["K","L"]},'
    assert [r[0] for r in sinks.redirects_tsv(links.redirects(pages)).collect()] == ["R\tTwo"]
    assert sinks.templates_text(links.templates(pages)).first()[0] == "<page>\n   <title>Template:T</title>\n   <ns>10</ns>\n   <text>[[B]]\n   </text>\n</page>"
    assert {r[0] for r in sinks.counts_tsv(flat).collect()} == {"the b\tB\t2", "b\tB\t2"}
    keys = [r["key"] for r in sinks.key_counts(flat).collect()]
    assert keys == sorted(keys)
    sinks.write_counts(flat, str(tmp_path / "counts"))
    assert as_map(spark.read.parquet(str(tmp_path / "counts"))) == as_map(flat)
    plan = lookup.entities_for(spark.read.parquet(str(tmp_path / "counts")), "b")._jdf.queryExecution().toString()
    assert "EqualTo(surface,b)" in plan
    sinks.write_lines(flat, str(tmp_path / "lines"), sinks.counts_tsv)
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    shown = []
    sinks.print_lines(sinks.redirects_tsv(links.redirects(pages)), shown.append)
    assert shown == ["R\tTwo"]


def test_sources_of_surfaces(pages, flat):
    found = {(r["surface"], r["entity"], r["source"]) for r in counts.surface_sources(flat, pages, links.redirects(pages)).collect()}
    assert {("r", "Two", "redirect"), ("two", "Two", "title"), ("b", "B", "anchor")} <= found


def test_linking(spark, pages, flat):
    index = search.build_index(pages)
    chance = {r["surface"]: r["link_probability"] for r in linking.link_probability(flat, index).collect()}
    assert chance["the b"] == 1.0 and chance["b"] == 1.0
    related = linking.relatedness(index, spark.createDataFrame([("B", "C_c"), ("B", "nowhere")], "a string, b string"))
    got = {r["b"]: r["relatedness"] for r in related.collect()}
    assert got["C_c"] == pytest.approx(max(0.0, 1 - (math.log(2) - math.log(1)) / (math.log(2) - math.log(1)))) and got["nowhere"] == 0.0
    text = spark.createDataFrame([(7, "The B and c c"), (8, None), (9, "")], "text_id int, text string")
    linked = {(r["text_id"], r["pos"], r["surface"]): r["entity"] for r in linking.link(text, flat, index).collect()}
    assert linked[(7, 0, "the b")] == "B" and linked[(7, 3, "c c")] == "C c" and {k[0] for k in linked} == {7}


def linked_by_hand(texts, rows):
    """{(text, pos, surface): (entity, score)} by all pairs of mentions and senses."""
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    uses, documents = collections.Counter(), []
    for _, title, redirect, _, text in rows:
        own = [(c.split("|")[-1].strip().lower(), c.split("|")[0].strip()) for c in re.findall(r"\[\[(.*?)\]\]", text)]
        uses.update(own)
        documents.append((" " + " ".join(plain(text)) + " ", {e.replace(" ", "_") for _, e in own}))
    by = collections.defaultdict(dict)
    for (surface, entity), n in uses.items():
        by[surface][entity] = n
    chance = {f: min(1.0, sum(e.values()) / d) if (d := sum(f" {' '.join(plain(f))} " in t for t, _ in documents)) else 0.0 for f, e in by.items()}
    share = {f: {e: n / sum(es.values()) for e, n in es.items() if n / sum(es.values()) >= 0.02} for f, es in by.items()}

    def near(a, b):
        a, b = a.replace(" ", "_"), b.replace(" ", "_")
        da, db, both = sum(a in o for _, o in documents), sum(b in o for _, o in documents), sum(a in o and b in o for _, o in documents)
        if not both:
            return 0.0
        if min(da, db) == len(documents):
            return 1.0
        return max(0.0, 1 - (math.log(max(da, db)) - math.log(both)) / (math.log(len(documents)) - math.log(min(da, db))))

    out = {}
    for i, text in texts:
        w = plain(text or "")
        found = [(p, " ".join(w[p : p + k])) for k in range(1, 9) for p in range(len(w) - k + 1) if " ".join(w[p : p + k]) in by]
        for m in found:
            others = [o for o in found if o != m]
            best = []
            for e, c in share[m[1]].items():
                votes = [sum(near(e, x) * y for x, y in share[o[1]].items()) / len(share[o[1]]) for o in others]
                best.append((-round(sum(votes) / len(votes), 9) if votes else 0.0, -c, e))
            if best:
                vote, _, e = min(best)
                out[i, *m] = (e, pytest.approx((chance[m[1]] - vote) / 2, abs=1e-8))
    return out


def test_linking_against_all_pairs(spark):
    rng = random.Random(6)
    names = ["Tea", "Tea House", "Green Tea", "House", "Green", "Old Green Tea House Of The North"]
    forms = ["tea", "the tea", "house", "green", "old green tea house of the north"]
    rows = [(i, f"P{i}", False, None, " and ".join(rng.choice([f"[[{rng.choice(names)}|{rng.choice(forms)}]]", rng.choice(forms), f"[[{rng.choice(names)}]]"]) for _ in range(rng.randrange(1, 7)))) for i in range(25)]
    texts = [(1, "The tea in the old green tea house of the north, and tea."), (2, "tea"), (3, None), (4, "green house green house"), (5, "nothing")]
    pages = spark.createDataFrame(rows, PAGE)
    got = linking.link(spark.createDataFrame(texts, "text_id int, text string"), counts.anchor_counts_flat(pages), search.build_index(pages))
    assert {(r["text_id"], r["pos"], r["surface"]): (r["entity"], r["score"]) for r in got.collect()} == linked_by_hand(texts, rows)


def test_pairs_of_titles_do_not_meet_all_documents(spark):
    names = [f"T{i}" for i in range(12)]
    index = spark.createDataFrame([(i, names) for i in range(300)] + [(None, names[:2]), (300, []), (300, names[:1])], "id bigint, outlinks array<string>")
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    found = linking.relatedness(index, pairs)
    far = lambda da, db: max(0.0, 1 - (math.log(max(da, db)) - math.log(300)) / (math.log(303) - math.log(min(da, db))))
    degree = lambda t: 300 + (t in names[:2]) + (t == names[0])
    got = {(r["a"], r["b"]): r["relatedness"] for r in found.collect()}
    assert len(got) == 144 and got["T0", "T1"] == pytest.approx(far(302, 301)) and got["T3", "T4"] == pytest.approx(far(degree("T3"), degree("T4")))
    assert "array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()  # counted before it is joined with pairs


def test_stream_counts_add_up(spark, tmp_path, flat):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(ROWS, PAGE)
    for k in range(2):
        frame.coalesce(1).write.mode("append").parquet(source)
        count_stream(page_stream(spark, source), target, str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(target).groupBy("surface", "entity").agg(F.sum("n").alias("n"))
    assert as_map(got) == {k: 2 * v for k, v in as_map(flat).items()}


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_counted_once(spark):
    pages = spark.createDataFrame(ROWS, PAGE)
    flat, links_of = counts.anchor_counts_flat(pages), "(?!#)(?![A-Za-z]+:)"
    assert links_of in plan_of(flat)
    assert links_of not in plan_of(linking.link_probability(flat, search.build_index(pages)))


def test_links_are_counted_once_for_mentions(spark):
    flat = counts.anchor_counts_flat(spark.createDataFrame(ROWS, PAGE))
    own = lookup.mention_commonness(spark.createDataFrame([("b", "B")], "surface string, entity string"), flat)
    assert "(?!#)(?![A-Za-z]+:)" not in plan_of(own) and own.count() == 1


def test_few_phrases_need_no_ngrams(spark, monkeypatch):
    index = spark.createDataFrame([(" the b and the b ",), (" b ",), (None,)], "content string")
    wanted = spark.createDataFrame([("The b",), ("b",), ("b",), ("he",), ("...",), (None,)], "phrase string")
    found = search.phrases_df(index, wanted)
    got = {r["phrase"]: r["n"] for r in found.collect()}
    assert got == {"The b": 1, "b": 2, "he": 0, "...": 0, None: 0} and "sequence(" not in plan_of(found)
    monkeypatch.setattr(search, "FEW", 0)
    many = search.phrases_df(index, wanted)
    assert {r["phrase"]: r["n"] for r in many.collect()} | {None: 0} == got and "sequence(" in plan_of(many)


def test_white_space_and_apostrophes(spark):
    blanks = [chr(c) for c in range(0x3100) if re.fullmatch(r"\s", chr(c)) and not 0x1C <= c <= 0x1F]
    values = ["", "a", " a\n", "\u200ba", "\u3000a b\u1680\u0085", *(b + "x" + b for b in blanks), "".join(blanks)]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for row in frame.select("v", wikitext.utrim(F.col("v")).alias("t"), F.regexp_replace("v", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "").alias("w")).collect():
        assert row["t"] == row["w"] == row["v"].strip("".join(blanks))
    labels = spark.createDataFrame([("a| ''b'c'' ",), ("a|''",), ("a|",)], "c string").select(wikitext.anchor_surface(F.col("c"))).collect()
    assert [r[0] for r in labels] == ["b'c", None, None]
