import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import corpus, frame, with_extra, words
from tomeforge.llm import ngram_join as N


def grams(text, n=3):
    own = [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)])


def brute(rows, threshold, n=3):
    """{(a, b): jaccard}, a set's smallest id standing for it."""
    sets = {}
    for i, text, *_ in rows:
        if i is not None and (g := grams(text, n)):
            sets.setdefault(g, set()).add(i)
    out = {}
    for ids in sets.values():
        out |= {(min(ids), i): 1.0 for i in ids if i != min(ids)}
    for (x, p), (y, q) in itertools.combinations(sets.items(), 2):
        a, b = sorted((min(p), min(q)))
        if a != b and (j := len(x & y) / len(x | y)) >= threshold - 1e-12:
            out[a, b] = max(j, out.get((a, b), 0))
    return out


def pairs_of(frame_):
    return {(r["doc_id_a"], r["doc_id_b"]): pytest.approx(r["jaccard"]) for r in frame_.collect()}


def test_pairs_against_all_pairs(spark):
    rng = random.Random(8)
    rows = corpus(80)
    base = words(rng, 60).split()
    for k in range(40):  # a large group of near copies, some at the threshold
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(own), "en", "s", 0))
    rows += [(None, rows[0][1], None, None, None), rows[5], (5, "another text under the id of five " + rows[7][1], "en", "s", 0), (2000, words(rng, 40_000), "en", "s", 0), (2001, None, None, None, None)]
    docs = with_extra(frame(spark, rows), "id", "bucket", "kind", "gram", "_gone", "node").repartition(4)
    for threshold, n in ((0.5, 3), (0.8, 2), (1.0, 3)):
        assert pairs_of(N.similar_pairs(docs, threshold, n)) == brute(rows, threshold, n)


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in list(parent)}


def classes(rows, threshold=0.5, n=3):
    """Rows (id, class_id, n_links, n_copies) by comparing all sets with each other."""
    sets, out = {}, set()
    for i, text, *_ in rows:
        if i is not None and (g := grams(text, n)):
            sets.setdefault(g, set()).add(i)
        elif i is not None:
            out.add((i, i, 0, 0))
    names = list(sets)
    linked = [(x, y) for x, y in itertools.combinations(range(len(names)), 2) if len(names[x] & names[y]) / len(names[x] | names[y]) >= threshold - 1e-12]
    group = roots(linked)
    for k, g in enumerate(names):
        together = [j for j in range(len(names)) if group.get(j, j) == group.get(k, k)]
        least = min(min(sets[names[j]]) for j in together)
        out |= {(i, least, sum(k in pair for pair in linked), len(sets[g]) - 1) for i in sets[g]}
    return out


def test_classes_against_all_pairs(spark):
    rng = random.Random(12)
    rows = corpus(60)
    base = words(rng, 50).split()
    for k in range(30):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(own), "en", "s", 0))
    # one id with two texts, one of which is near 1000's; rows that are repeated; no words at all
    rows += [(None, rows[0][1], None, None, None), rows[5], (5, rows[-3][1] + " and", "en", "s", 0), (3000, "...", "en", "s", 0), (3000, "...", "en", "s", 0)]
    docs = with_extra(frame(spark, rows), "id", "doc", "class_id", "n_links", "root").repartition(3)
    found = N.similar_classes(docs)
    assert sorted(map(tuple, found.collect())) == sorted(classes(rows)) and found.columns == ["doc_id", "class_id", "n_links", "n_copies"]


@pytest.mark.parametrize("least, share", [(2, 0.0), (8, 0.05)])
def test_common_ngrams_change_nothing(spark, monkeypatch, least, share):
    monkeypatch.setattr(N, "COMMON_LEAST", least)
    monkeypatch.setattr(N, "COMMON_SHARE", share)
    rng = random.Random(31)
    line = words(rng, 25)
    rows = [(i, f"{t} {line}" if i % 3 else t, *rest) for i, t, *rest in corpus(50)]
    rows += [(500 + k, f"{line} {rng.randrange(5)}", "en", "s", 0) for k in range(12)] + [(600 + k, line, "en", "s", 0) for k in range(5)]
    docs = frame(spark, rows).repartition(3)
    slots = N._common_slots(docs.selectExpr("doc_id as id", "text"), 3)
    assert 20 < slots.sum() < 5000
    assert pairs_of(N.similar_pairs(docs)) == brute(rows, 0.5)
    assert sorted(map(tuple, N.similar_classes(docs).collect())) == sorted(classes(rows))


def test_one_id_with_several_texts(spark):
    rng = random.Random(4)
    one, two = words(rng, 60), words(rng, 60)
    rows = [(1, one, "en", "s", 0), (1, two, "en", "s", 0), (2, one + " a", "en", "s", 0), (2, two + " b", "en", "s", 0), (3, two + " c d", "en", "s", 0)]
    docs = frame(spark, rows)
    assert pairs_of(N.similar_pairs(docs)) == brute(rows, 0.5)
    assert sorted(map(tuple, N.similar_classes(docs).collect())) == sorted(classes(rows))
    assert [r["doc_id"] for r in N.drop_near_copies(docs).collect()] == [1, 1]


def test_pairs_of_a_large_class_are_passed_on_in_batches():
    n = 2500
    rng = np.random.default_rng(6)
    doc = rng.permutation(n)
    column = {"gram": np.full(n, 7), "df": np.full(n, n), "doc": doc, "size": rng.integers(50, 60, n), "place": np.zeros(n, np.int64)}
    column |= {e: np.full(n, -1) for e in N._EARLIER}
    table = pa.table({**column, "classes": pa.array([np.full(N.CLASSES, 7, "<u4").tobytes()] * n, pa.binary())})
    tracemalloc.start()
    pairs = sizes = 0
    for batch in N._candidates(0.5)(iter(table.to_batches())):
        pairs += int((batch.column("a").to_numpy() * n + batch.column("b").to_numpy()).sum())
        sizes = max(sizes, batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, b = np.triu_indices(n, 1)
    assert pairs == int((a * n + b).sum()) and sizes <= 700_000 and peak < 120 << 20


@pytest.mark.parametrize("each", [5, 60])
def test_large_classes_are_verified_in_cells(spark, monkeypatch, each):
    rng = random.Random(13)
    rows = corpus(20)
    for group in range(3):
        base = words(rng, 50).split()
        for k in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            rows.append((1000 * (group + 1) + k, " ".join(own), "en", "s", 0))
    docs = frame(spark, rows).repartition(3)
    held = []
    verify = N._verify
    monkeypatch.setattr(N, "CELL_PAIRS", each)
    monkeypatch.setattr(N, "_verify", lambda *given: held.append(given) or verify(*given))
    assert sorted(map(tuple, N.similar_classes(docs).collect())) == sorted(classes(rows))
    assert pairs_of(N.similar_pairs(docs)) == brute(rows, 0.5)
    assert held == [(0.5, True), (0.5, False)]


def test_roots():
    i, j = np.array([5, 4, 9, 7, 2]), np.array([4, 3, 8, 9, 6])
    assert N._roots(10, i, j).tolist() == [0, 1, 2, 3, 3, 3, 2, 7, 7, 7]


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [tuple(rng.sample(range(100, 160), 2)) for _ in range(35)] + [(500, 400), (500, 400), (7, 7)]
    found = N.components(spark.createDataFrame(pairs, "doc_id_a long, doc_id_b long"))
    wanted = roots([p for p in pairs if p[0] != p[1]])
    assert {r["node"]: r["root"] for r in found.collect()} == wanted and found.count() == len(wanted)


def test_one_of_each_group_stays(spark):
    rows = [*corpus(40), (None, corpus(40)[0][1], None, None, None), (None, None, None, None, None)]
    docs = with_extra(frame(spark, rows), "_gone", "node", "root")
    kept = N.drop_near_copies(docs)
    group = roots(brute(rows, 0.5))
    wanted = sorted((r[0] for r in rows if r[0] is None or group.get(r[0], r[0]) == r[0]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == wanted and kept.columns == docs.columns


def test_empty_and_wrong_parameters(spark):
    empty = frame(spark).where("false")
    assert N.similar_pairs(empty).count() == 0 and N.drop_near_copies(empty).count() == 0
    assert N.similar_pairs(frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])).count() == 0
    assert N.similar_classes(empty).count() == 0
    assert sorted(map(tuple, N.similar_classes(frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])).collect())) == [(1, 1, 0, 0), (2, 2, 0, 0)]
    with pytest.raises(ValueError):
        N.similar_pairs(empty, 0.0)
    with pytest.raises(ValueError, match="integer"):
        N.similar_classes(frame(spark).selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_overlaps_by_product():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3000, 400).astype(np.uint64)) for _ in range(700)]
    i, j = (x[:30_000] for x in np.triu_indices(700, 1))
    i, j = np.concatenate([i, [650, 5]]), np.concatenate([j, [699, 699]])
    assert N.overlaps(sets, i, j)[[0, 777, -1, -2]].tolist() == [len(np.intersect1d(sets[i[k]], sets[j[k]])) for k in (0, 777, -1, -2)]


def test_a_cluster_has_to_name_its_folder():
    from types import SimpleNamespace

    from tomeforge.llm.common import shared_folder

    put = []
    session = lambda master, named: SimpleNamespace(conf={"spark.checkpoint.dir": named} if named else {}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=put.append))
    shared_folder(session("yarn", "hdfs://x/shared"))
    assert put == ["hdfs://x/shared"]
    with pytest.raises(RuntimeError):
        shared_folder(session("yarn", None))
