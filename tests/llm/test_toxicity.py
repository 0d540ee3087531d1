import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import DOCS, frame, with_extra
from tomeforge.llm import toxicity as T

LABELS = "doc_id bigint, quality int, toxic int"


def made(n, seed):
    """Documents of sentences; a toxic one has a bad word or several of a stem in some."""
    rng, rows, labels, bad = random.Random(seed), [], [], {}
    for i in range(n):
        parts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 12))) + "." for _ in range(rng.randrange(2, 9))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] = parts[k].replace(" ", f" {rng.choice(['vilest', 'rotten'])} ", 1)
            bad[i] = k
        rows.append((i, " ".join(parts), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels, bad


def test_sentence_spans_cover_the_text():
    text = "One. Two!? Three\nfour 1.5 five"
    assert [text[a:b] for a, b in T.sentence_spans(text)] == ["One.", " Two!?", " Three\n", "four 1.5 five"]
    assert T.sentence_spans("") == []


def test_logits_and_noisy_or_by_hand():
    names = {w: int(T.features(pa.array([w], pa.large_string()))[1][0]) for w in ("bad", "awful")}
    order = sorted(names, key=names.get)
    model = T.Model(np.array([names[w] for w in order], np.uint64), np.array([{"bad": 3.0, "awful": 1.0}[w] for w in order]), -2.0)
    doc, _, where, index, distinct = T._sentences(pa.array(["Bad bad awful. fine.", ""], pa.large_string()))
    z = model.logits(where, index, distinct, len(doc))
    assert z.tolist() == [2.0, -2.0]  # a repeated word counts once
    p = 1 / (1 + np.exp(-z))
    assert T.noisy_or(z, doc, 2) == pytest.approx([1 - np.prod(1 - p), 0.0])


def test_held_out_accuracy_and_places(spark):
    rows, labels, _ = made(400, 3)
    model = T.train(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    fresh, truth, bad = made(200, 4)
    found = T.offending_sentences(frame(spark, fresh), model).collect()
    caught = {r["doc_id"] for r in found}
    toxic = {i for i, _, y in truth if y}
    assert len(caught & toxic) >= 0.95 * len(toxic) and len(caught - toxic) <= 2
    right = [r for r in found if r["doc_id"] in bad and r["sentence"] == bad[r["doc_id"]]]
    assert len(right) >= 0.95 * len(toxic)
    texts = {r[0]: r[1] for r in fresh}
    assert all("vilest" in (t := texts[r["doc_id"]][r["start_char"] : r["end_char"]]) or "rotten" in t for r in right)
    kept = {r["doc_id"] for r in T.drop_toxic(frame(spark, fresh), model).collect()}
    assert kept == {r[0] for r in fresh} - caught


def test_a_stem_in_several_sentences_counts_for_more_than_in_one():
    rng, texts, toxic = random.Random(5), [], []
    for i in range(600):
        parts = [" ".join(f"w{rng.randrange(300)}" for _ in range(6)) for _ in range(8)]
        many = rng.randrange(3, 6) if i % 2 else rng.choice([0, 0, 1])
        for k in rng.sample(range(8), many):
            parts[k] += f" grumbl{rng.randrange(1000)}"
        texts.append(". ".join(parts))
        toxic.append(i % 2)
    model = T.fit(texts, np.array(toxic))
    score = lambda n: next(T._scored(pa.RecordBatch.from_arrays([pa.array([". ".join(["calm grumblish words"] * n + ["calm words"] * (8 - n))])], names=["t"]), "t", model))[0][0]
    assert score(0) < 0.1 and score(1) < 0.25 and score(6) > 0.5


def test_edges(spark):
    rows, labels, _ = made(80, 6)
    rows = [*rows, (None, "vilest rotten vilest.", None, None, None), (900, None, None, None, None), (901, "", "en", "s", 0), (902, "vilest. " * 20000, "en", "s", 0), rows[0]]
    labels = [*labels, (None, 1, 1), (5, None, None), (4321, 0, 1)]
    docs = with_extra(frame(spark, rows), "id", "_id", "t", "y", "score", "sentence")
    model = T.train(docs, spark.createDataFrame(labels, LABELS))
    found = T.offending_sentences(docs, model).collect()
    by = [r["doc_id"] for r in found]
    assert None in by and 902 in by and by.count(0) == 2 * len({r["sentence"] for r in found if r["doc_id"] == 0}) and not {900, 901} & set(by)
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {900, 901} <= {r["doc_id"] for r in kept.collect()}
    assert T.offending_sentences(docs.where("false"), model).count() == 0
    nothing = T.train(docs, spark.createDataFrame([], LABELS))
    assert T.offending_sentences(docs, nothing).count() == 0
    assert T.drop_toxic(docs, T.fit(["a b"] * 3, np.array([1, 1, 1]))).count() == len(rows)
    assert spark.createDataFrame([], DOCS).count() == T.train(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)).features.size


def test_length_alone_makes_nothing_toxic(spark):
    rows, labels, _ = made(400, 3)
    model = T.train(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    rng = random.Random(8)
    clean = " ".join(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 12))) + "." for _ in range(20000))
    z = np.full(20000, model.bias)
    assert T.noisy_or(z, np.zeros(20000, int), 1)[0] > 0.5  # what sentences without evidence add up to
    docs = frame(spark, [(1, clean, "en", "s", 0), (2, clean + " a vilest rotten word.", "en", "s", 0)])
    assert {r["doc_id"] for r in T.offending_sentences(docs, model).collect()} == {2}
    assert [r["doc_id"] for r in T.drop_toxic(docs, model).collect()] == [1]


def test_long_labelled_texts_train(spark):
    rows, labels, _ = made(400, 3)
    rng = random.Random(2)
    filler = " ".join(f"w{rng.randrange(300)}" for _ in range(70000))
    rows = [(i, f"{filler[: 1 << 18]} x{i}. {t}", *rest) for i, t, *rest in rows[:120]]
    model = T.train(frame(spark, rows), spark.createDataFrame(labels[:120], LABELS))
    assert {int(h) for h in T.features(pa.array(["vilest", "rotten"], pa.large_string()))[1][:2]} <= {int(h) for h in model.features}


def test_training_on_executors_is_the_same_fit(spark):
    rows, labels, _ = made(300, 3)
    there = T.train(frame(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS))
    here = T.fit([r[1] for r in rows], np.array([y[2] for y in labels]))
    assert (there.features == here.features).all() and there.weights == pytest.approx(here.weights, rel=1e-6) and there.mean == pytest.approx(here.mean)


def by_hand(texts, y, rounds, rate, penalty):
    """Features of each sentence as sets, and a plain loop that follows the gradient of every document."""
    forms = lambda w: {w, *((k, w[:k]) for k in T.BEGINNINGS if len(w) > k)}
    bags = [[{f for w in re.findall(r"[^\W_]+", t[a:b].lower()) for f in [(w, x) for x in forms(w)]} for a, b in T.sentence_spans(t)] for t in texts]
    seen = lambda bag: {x for _, x in bag}
    n = {v: sum(y) if v else len(y) - sum(y) for v in (0, 1)}
    held = {v: collections.Counter(x for d, bag in enumerate(bags) if y[d] == v for x in set().union(*map(seen, bag))) for v in (0, 1)}
    kept = []
    for x, bad in held[1].items():
        both = (bad + held[0][x]) / (n[0] + n[1])
        z = (bad / n[1] - held[0][x] / n[0]) / math.sqrt(max(both * (1 - both), 1e-12) * (1 / n[1] + 1 / n[0]))
        if bad >= 6 and z >= 5.0:
            kept.append(x)
    weight, bias, m, v = dict.fromkeys(kept, 0.0), -6.0, collections.Counter(), collections.Counter()
    for t in range(1, rounds + 1):
        gradient = collections.Counter({x: penalty * weight[x] for x in kept})
        for d, bag in enumerate(bags):
            zs = [bias + sum(weight.get(x, 0.0) for _, x in own) for own in bag]  # a word's form counts once for each word
            total = sum(math.log1p(math.exp(z)) for z in zs)
            slope = 0.5 / n[1] * -1 / math.expm1(max(total, 1e-9)) if y[d] else 0.5 / n[0]
            for z, own in zip(zs, bag):
                p = slope / (1 + math.exp(-z))
                gradient["bias"] += p
                for _, x in own:
                    if x in weight:
                        gradient[x] += p
        for x in [*kept, "bias"]:
            m[x] = 0.9 * m[x] + 0.1 * gradient[x]
            v[x] = 0.999 * v[x] + 0.001 * gradient[x] ** 2
            step = rate * (m[x] / (1 - 0.9**t)) / (math.sqrt(v[x] / (1 - 0.999**t)) + 1e-9)
            if x == "bias":
                bias -= step
            else:
                weight[x] -= step
    return weight, bias


def test_training_against_a_plain_loop():
    rows, labels, _ = made(160, 9)
    texts, y = [r[1] for r in rows], [x[2] for x in labels]
    model = T.fit(texts, np.array(y), rounds=40)
    weight, bias = by_hand(texts, y, 40, 0.1, 2e-5)
    assert len(model.weights) == len(weight) > 0 and model.bias == pytest.approx(bias, rel=1e-6)
    assert sorted(model.weights.tolist()) == pytest.approx(sorted(weight.values()), rel=1e-6)


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="sentence"):
        T.offending_sentences(frame(spark).withColumnRenamed("doc_id", "sentence"), T._nothing(), id_col="sentence")
