import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.compare import duck_rows, spark_rows
from tests.llm.data import DOCS, corpus, with_extra
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_ngram_join import brute as pairs
from tests.llm.test_ngram_join import roots
from tests.llm.test_packing_sharding import tokens
from tests.llm.test_toxicity import LABELS, made
from tomeforge.llm import pii, toxicity
from tomeforge.llm import queries as Q

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WHERE = "/root/testdata/sf0.001"
#: Where the smallest tables have too few labelled documents to learn from.
LARGER = {"op1_toxicity": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small folder of tables, with rows of every kind."""
    folder = tmp_path_factory.mktemp("sf")
    rows, labels, _ = made(120, 11)
    rows += [(1000 + i, *rest) for i, *rest in corpus(30)]
    rows += [(2000, "mail me at a@b.com about all of that and more", "en", "s", 45), (None, "no id at all", None, None, None), (2001, "x " + BENCH.upper(), "en", "s", 9), (2002, "y y y " + "long text " * 3000, "en", "s", 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, labels


BENCH = "which of the following statements about the seven hills of the old town is true"


def test_stages_against_brute_force(spark, tables):
    folder, rows, labels = tables
    got = docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.offending_sentences(docs, model).collect()}
    assert toxic and toxic <= {i for i, _, y in labels if y}
    wanted = [r for r in rows if r[0] not in toxic]
    states = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, folder).cache()
        states.append((name, got))
    key = lambda r: (str(r[0]), str(r[1]))
    ids = lambda rs: sorted((r[0] for r in rs), key=str)
    assert ids(states[0][1].collect()) == ids(wanted)
    group = roots(pairs(wanted, 0.5))
    wanted = [r for r in wanted if r[0] is None or group.get(r[0], r[0]) == r[0]]
    assert ids(states[1][1].collect()) == ids(wanted)
    leaked = {x[0] for x in leaks([(r[0], r[1]) for r in wanted], [(1, BENCH)], 13, 8)}
    assert leaked == {2001}
    wanted = [r for r in wanted if r[0] not in leaked]
    assert ids(states[2][1].collect()) == ids(wanted)
    clean = []
    for i, text, lang, source, n in wanted:
        spans = pii.propose(text or "")
        for kind, a, b, _ in reversed(spans):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        clean.append((i, text, lang, source, len(text) if spans else n))
    assert sorted((tuple(r) for r in states[3][1].collect()), key=key) == sorted(clean, key=key)
    assert all(s.columns == docs.columns for _, s in states[:4])
    placed = {r["doc_id"]: r["n"] for r in states[4][1].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert placed == {r[0]: tokens(r[1]) + 1 for r in clean}
    assert spark_rows(corpus_pipeline.run(spark, folder)) == spark_rows(states[4][1])


def test_columns_with_clashing_names_go_through_all_stages(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = with_extra(docs, "id", "doc", "kind", "gone", "node", "root", "class_id", "n_links", "t", "y", "item", "score", "bucket", "row", "piece", "_id", "tokens")
    for (_, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True]):
        plain, wide = stage(spark, docs, folder), stage(spark, more, folder)
        if last:
            assert spark_rows(plain) == spark_rows(wide)
        else:
            assert wide.columns == more.columns and spark_rows(plain) == spark_rows(wide.select(docs.columns))


def test_stages_of_nothing(spark, tables):
    folder = tables[0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(WHERE), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries(spark, name):
    got = spark_rows(Q.queries()[name](spark, LARGER.get(name, WHERE)))
    if name in Q.oracle_sql():
        assert got == duck_rows(Q.oracle_sql()[name], WHERE)
    else:
        assert got[1]


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
