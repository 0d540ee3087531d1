import math
import random

import numpy as np
import pytest

from tests.compare import spark_rows, text
from tests.llm.data import frame, with_extra
from tomeforge.llm import packing as P
from tomeforge.llm import sharding as S
from tomeforge.llm import token_store as S5
from tomeforge.llm.token_store import Encoder


def slow_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(capacity)
            k = len(room) - 1
        room[k] -= s
        out.append(k)
    return out


def test_tree_against_a_scan():
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 300):
        sizes = [rng.randrange(1, 51) for _ in range(n)]
        assert P.first_fit(sizes, 50) == slow_first_fit(sizes, 50)


ENCODER = Encoder()
PLAIN = ENCODER.plain.encode_ordinary


def tokens(t):
    return len(PLAIN(t or ""))


def test_packing_against_brute_force(spark):
    docs = with_extra(frame(spark), "id", "n", "piece", "group_id", "row")
    rows = P.pack(docs, capacity=32, group_docs=20).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"], r["tokens"]))
    for doc_id, t, *_ in docs.select("doc_id", "text").collect():
        own = sorted(pieces[doc_id])
        ids = np.frombuffer(b"".join(p[3] for p in own), "<u2").tolist()
        assert ids == [*PLAIN(t or ""), ENCODER.end] and all(len(p[3]) == 2 * p[2] for p in own)
        assert [p[0] for p in own] == list(range(len(own))) and [p[1] for p in own] == [32 * k for k in range(len(own))]
    for group in {r["group_id"] for r in rows}:
        own = sorted((r for r in rows if r["group_id"] == group), key=lambda r: (-r["n_tokens"], r["doc_id"], r["piece"]))
        assert [r["bin_id"] - (group << 32) for r in own] == slow_first_fit([r["n_tokens"] for r in own], 32)
    assert len({(r["bin_id"], r["slot"]) for r in rows}) == len(rows) and len({r["group_id"] for r in rows}) > 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, P.pack(docs.repartition(3), capacity=32, group_docs=20).collect()))


def test_packing_edges(spark):
    big = 2**53
    rows = [(None, "a b", None, None, None), (1, None, None, None, -5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 30_000, "en", "s", 60_000), (big + 1, "a", "en", "s", 0), (big + 3, "b", "en", "s", 0)]
    found = P.pack(frame(spark, rows), capacity=100).collect()
    assert {r["doc_id"] for r in found} == {None, 1, 2, 3, big + 1, big + 3}  # a null beside them changes no id
    assert sum(r["doc_id"] == 2 for r in found) == 2 and sum(r["n_tokens"] for r in found if r["doc_id"] == 3) == tokens(rows[4][1]) + 1
    assert {r["n_tokens"] for r in found if r["doc_id"] == 1} == {1} and [r["n_tokens"] for r in found if r["doc_id"] is None] == [3]
    assert P.pack(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        P.pack(frame(spark, rows), capacity=0)
    with pytest.raises(ValueError, match="Piece"):
        P.pack(frame(spark, rows).withColumnRenamed("doc_id", "Piece"), id_col="Piece")


def test_equal_rows_are_dealt_apart(spark):
    rows = [(None, "the same", None, None, None)] * 600
    found = P.pack(frame(spark, rows), group_docs=50).groupBy("group_id").count().collect()
    assert sum(r["count"] for r in found) == 600 and len(found) == 12 and max(r["count"] for r in found) < 120


def test_packed_tokens_are_those_of_the_store(spark):
    docs = frame(spark)
    stored = {i: n for r in S5.store(docs, b"").collect() for i, n in zip(r["doc_ids"], r["n_tokens"])}
    packed = {r["doc_id"]: r["n"] for r in P.pack(docs).groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert packed == {i: max(n, 0) + 1 for i, n in stored.items()}


def test_sharding_against_sql(spark):
    import duckdb

    rows = [(i, "t", "en", "s", 1) for i in range(3000)] + [(None, None, None, None, None), (7, "t", "en", "s", 1)]
    docs = with_extra(frame(spark, rows), "region", "k")
    con = duckdb.connect()
    con.execute("create table documents as select range as doc_id from range(3000) union all select null union all select 7")
    found = con.execute(S.sql())
    wanted = sorted(tuple(map(text, r)) for r in found.fetchall())
    assert spark_rows(S.assign_shards(docs).select("doc_id", "rack", "region", "shard"))[1] == sorted((w[0], w[2], w[1], w[3]) for w in wanted)


def test_shares_follow_weights_and_moves_stay_inside(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {r["doc_id"]: r for r in S.assign_shards(keys).collect()}
    total = sum(w for racks in S.PRODUCTION.values() for shards in racks.values() for w in shards.values())
    for region, racks in S.PRODUCTION.items():
        for rack, shards in racks.items():
            for shard, w in shards.items():
                n, p = sum(r["shard"] == shard for r in before.values()), w / total
                assert abs(n - 20_000 * p) < 5 * math.sqrt(20_000 * p)
    import copy

    changed = copy.deepcopy(S.PRODUCTION)
    changed["west"]["w2"]["w2a"], changed["west"]["w2"]["w2b"] = 3.0, 1.0  # the rack's weight stays
    after = {r["doc_id"]: r for r in S.assign_shards(keys, changed).collect()}
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(before[k]["rack"] == after[k]["rack"] == "w2" for k in moved)
    grown = copy.deepcopy(S.PRODUCTION)
    grown["east"]["e1"]["e1a"] = 2.0
    now = {r["doc_id"]: r for r in S.assign_shards(keys, grown).collect()}
    moved = [(before[k], now[k]) for k in before if before[k] != now[k]]
    # at each level keys only move towards the node that grew
    assert moved
    for old, new in moved:
        assert new["region"] == "east"
        if old["region"] == "east":
            assert new["rack"] == "e1" and (old["rack"] != "e1" or new["shard"] == "e1a")


def test_sharding_edges(spark):
    keys = spark.createDataFrame([(None,), (1,)], "doc_id bigint")
    assert S.assign_shards(keys, {}).select("region", "rack", "shard").distinct().first() == (None, None, None)
    assert {r["shard"] for r in S.assign_shards(keys, {"a": {"b": {"c": 0.0, "d": 1.0}}}).collect()} == {"d"}
    assert S.assign_shards(keys.where("false")).count() == 0
    with pytest.raises(ValueError):
        S.assign_shards(keys, {"a": {"b": {"c": -1.0}}})
    with pytest.raises(ValueError, match="region"):
        S.assign_shards(keys.withColumnRenamed("doc_id", "region"), key_col="region")
    clash = keys.withColumnRenamed("doc_id", "_key")
    assert S.assign_shards(clash, key_col="_key").columns == ["_key", "region", "rack", "shard"]
