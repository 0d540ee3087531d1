import random
import re

import pytest

from tests.llm.data import frame, with_extra
from tomeforge.llm import decontaminate as D

ITEMS = "item_id bigint, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, window, least):
    out = set()
    for d, text in docs:
        spans = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
        own = words(text)
        for i, item in items:
            hit = set()
            for pattern in D.windows(item, window, least):
                k = len(pattern)
                for at in range(len(own) - k + 1):
                    if tuple(own[at : at + k]) == pattern:
                        hit.add((at, at + k))
            merged = []
            for a, b in sorted(hit):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out |= {(d, i, spans[a][0], spans[b - 1][1], b - a) for a, b in merged}
    return out


def made():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("alpha beta Gamma ñu".split()) + str(rng.randrange(40)) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 13, 9, 4, 20])] + [(5, None), (6, ""), (7, say(20))]
    items.append((8, items[0][1]))  # equal items
    docs = [(i, say(60)) for i in range(10)]
    docs += [(20, say(5) + " " + items[0][1].upper().replace(" ", ",  ") + "! " + say(5)), (21, items[2][1]), (22, items[3][1]), (23, " ".join(items[4][1].split()[2:16])), (24, " ".join(items[4][1].split()[2:14])), (25, items[1][1] + " - " + items[1][1])]
    return docs + [(30, None), (31, ""), (20, docs[-6][1]), (32, say(30_000) + " " + items[7][1])], items


def test_passages_against_brute_force(spark):
    docs, items = made()
    table = with_extra(frame(spark, [(i, t, "en", "s", 0) for i, t in docs]), "id", "item", "n_words")
    bench = with_extra(spark.createDataFrame(items, ITEMS), "t0", "i")
    found = [tuple(r) for r in D.contaminated(table, bench).collect()]
    assert set(found) == brute(docs, items, 13, 8) and len(found) == len(set(found)) + 2  # the repeated row's two
    assert {r[0] for r in found} >= {20, 21, 23, 25, 32} and not {r[0] for r in found} & {22, 24, 30, 31}
    kept = D.drop_contaminated(table, bench)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {r[0] for r in found}


def test_two_text_columns_and_edges(spark):
    docs = frame(spark, [(1, "q one two three four five six seven eight", "en", "s", 0), (None, "a b c d e f g h", None, None, None)])
    bench = spark.createDataFrame([(1, "one two three four five six seven eight", "a b c d e f g h"), (None, None, None)], "item_id bigint, question string, answer string")
    found = {(r["doc_id"], r["item_id"] if "item_id" in r else r["item"]) for r in D.contaminated(docs, bench, item_text_cols=("question", "answer")).collect()}
    assert found == {(1, 1), (None, 1)}
    assert D.contaminated(docs, bench.where("false"), item_text_cols=("question",)).count() == 0
    assert D.contaminated(docs.where("false"), bench, item_text_cols=("question",)).count() == 0
    assert D.drop_contaminated(docs, bench.where("false"), item_text_cols=("question",)).count() == 2
    with pytest.raises(ValueError):
        D.contaminated(docs, bench, item_text_cols=("question",), max_pattern_chars=10)


def test_short_items_are_named_and_may_be_let_in(spark):
    docs = frame(spark, [(1, "so what is the capital of France here", "en", "s", 0)])
    bench = spark.createDataFrame([(1, "what is the capital of France"), (2, None), (3, "one two three four five six seven eight")], ITEMS)
    assert {(r["item_id"], r["n_words"]) for r in D.unsearched(bench).collect()} == {(1, 6), (2, 0)}
    assert D.contaminated(docs, bench).count() == 0 and [r["item_id"] for r in D.contaminated(docs, bench, min_words=5).collect()] == [1]
    with pytest.raises(ValueError, match="item_id"):
        D.contaminated(docs.withColumnRenamed("doc_id", "item_id"), bench, id_col="item_id")
