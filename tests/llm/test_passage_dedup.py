import random
import re

import xxhash

from tests.llm.data import frame, with_extra
from tomeforge.llm import passage_dedup as P


def sig(text):
    """Spark's xxhash64 of a string, as a signed number."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, least, rank=lambda i: i):
    """{(id, text): (cut text, removed)} by comparing all windows of words."""
    places, cut = {}, {}
    for i, text in set(rows):
        found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text or "")]
        order = (rank(i) is None, -1 if rank(i) is None else rank(i), i is None, -1 if i is None else i, sig(text))
        cut[i, text] = []
        for k in range(len(found) - least + 1):
            own = tuple(w for _, _, w in found[k : k + least])
            places.setdefault(own, []).append((*order, found[k][0], found[k + least - 1][1], (i, text)))
    for own in places.values():
        for *_, start, end, row in sorted(own, key=lambda p: p[:6])[1:]:
            cut[row].append((start, end))
    out = {}
    for (i, text), spans in cut.items():
        joined, kept, last = [], [], 0
        for s, e in sorted(spans):
            if joined and s <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e])
        for s, e in joined:
            kept.append(text[last:s])
            last = e
        out[i, text] = ("".join([*kept, text[last:]]) if joined else text, joined)
    return out


def made():
    rng = random.Random(3)
    say = lambda n: rng.choice([" ", ", ", "\n", " – "]).join(rng.choice([str.upper, str.lower])(f"wé{rng.randrange(200)}") for _ in range(n))
    shared = [say(rng.randrange(8, 90)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice([say(rng.randrange(1, 40)), rng.choice(shared)]) for _ in range(rng.randrange(1, 8)))) for i in range(50)]
    period = " ".join(f"p{k}" for k in range(7))
    long = (" ".join(f"u{k}" for k in range(20_000)) + " ") * 2  # a very long text that repeats itself
    return rows + [(None, rows[0][1]), (None, rows[1][1] + " x"), (70, None), (71, ""), (72, " ".join([period] * 12)), (73, "x" * 400 + " " + shared[0] + " " + "." * 300 + " " + shared[1]), (3, rows[3][1]), (3, rows[4][1]), (74, long)]


def check(docs, rows, least, **more):
    wanted = brute(rows, least)
    found = [(r["doc_id"], r["text"], [list(x) for x in r["removed"]]) for r in P.cut_passages(docs, least, **more).collect()]
    assert sorted(found, key=str) == sorted(((i, *wanted[i, t]) for i, t in rows), key=str)


def test_against_brute_force(spark):
    rows = made()
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    for least, parts in ((5, 1), (20, 5), (50, 2)):
        check(docs.repartition(parts), rows, least)


def test_levels_and_small_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 1000)
    rows = made()[:-1]
    extra = with_extra(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), "id", "sig", "removed", "cut_id", "Cut_Spans", "rank", "key")
    check(extra.repartition(3), rows, 10, fan_in=4)
    assert P.cut_passages(extra, 10, fan_in=2).columns == [c for c in extra.columns if c != "removed"] + ["removed"]


def test_a_passage_inside_longer_lines_goes(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = say(149)
    texts = [f"{say(300)} {shared} {say(400)}", f"{say(77)} {shared} {say(20)}", say(500)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["text"] for r in P.cut_passages(docs).collect()}
    assert got == {0: texts[0], 1: texts[1].replace(shared, ""), 2: texts[2]}
    assert P.cut_passages(docs.where("false")).count() == 0


def test_a_passage_in_every_document_sends_a_row_a_chunk(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = frame(spark, [(i, f"{text} {i}", "en", "s", 0) for i in range(500)]).repartition(2)
    rows = docs.selectExpr("doc_id as id", "doc_id as rank", "xxhash64(text) as sig", "text").mapInArrow(P._explode(50), "key long, chunk long, id long, rank long, sig long, start long, end long, digest binary, starts binary, ends binary")
    sent = rows.selectExpr("sum(length(digest)) div 6").first()[0]
    assert sent < 500 + 2 * 12  # a window of its own for each document, and those that all share once a chunk
    assert [r["doc_id"] for r in P.cut_passages(docs).where("size(removed) = 0").collect()] == [0]


def test_rank_decides_what_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = frame(spark, [(1, text, "en", "b", 9), (2, text, "en", "a", 3), (3, text, "en", None, None)])
    assert [r["doc_id"] for r in P.cut_passages(docs, rank_col="n_chars").where("text <> ''").collect()] == [2]
