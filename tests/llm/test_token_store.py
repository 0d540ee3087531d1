import pytest
import tiktoken

from tests.llm.data import frame, with_extra
from tomeforge.llm import token_store as S


@pytest.fixture(scope="module")
def docs(spark):
    base = [(i, f"doc {i}: the same boilerplate about cookies and privacy, again {i * 7}.\nÜber {i} ñandú 漢字", "en", "s", 0) for i in range(400)]
    more = [(None, "null id", None, None, None), (500, None, None, None, None), (501, "", "en", "s", 0), (502, "long " * 50_000, "en", "s", 0), (3, base[3][1], "en", "s", 0), (503, "<|endoftext|> \r\n\t x", "en", "s", 0)]
    return with_extra(frame(spark, base + more), "ids", "data", "part").cache()


def test_ids_are_those_of_the_vocabulary():
    encoder = S.Encoder()
    plain = tiktoken.Encoding("x", pat_str=S.PATTERN, mergeable_ranks=encoder.plain._mergeable_ranks, special_tokens={})
    for text in ("Hello, world's  end\n\n x", "ñandú 漢字 123", " ", "a" * 500):
        import numpy as np

        assert np.frombuffer(encoder(text), "<u2").tolist() == plain.encode_ordinary(text)
        assert encoder.decode(encoder(text)) == text


def test_any_white_space_gives_the_plain_ids():
    import random

    import numpy as np

    rng, encoder = random.Random(1), S.Encoder()
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "b1", "it's", ".", "\n", "\t", " ", " ", "\u00a0", "  ", "\r", "é", "漢"]) for _ in range(rng.randrange(0, 9)))
        assert np.frombuffer(encoder(text), "<u2").tolist() == encoder.plain.encode_ordinary(text), repr(text)


def test_every_frame_opens_on_its_own(docs):
    """By the definition: a slice of a shard, its dictionary and the plain decoder."""
    import numpy as np
    import zstandard

    dictionary = S.train_dictionary(docs)
    encoder, got = S.Encoder(), []
    for row in S.store(docs, dictionary, shard_bytes=4096).collect():
        assert row["offsets"][-1] == len(row["data"]) and len(row["offsets"]) == len(row["doc_ids"]) + 1
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(row["dictionary"])))
        for i, n, a, b in zip(row["doc_ids"], row["n_tokens"], row["offsets"], row["offsets"][1:]):
            ids = np.frombuffer(opened.decompress(bytes(row["data"][a:b])), "<u2").tolist() if b > a else []
            assert len(ids) == max(n, 0)
            got.append((i, None if n < 0 else encoder.plain.decode(ids)))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(got, key=key) == sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key)


def test_round_trip_and_single_reads(docs):
    dictionary = S.train_dictionary(docs)
    assert dictionary
    shards = S.store(docs, dictionary, shard_bytes=4096).cache()
    assert shards.count() > 1 and {r["dict_hash"] for r in shards.collect()} == {S.dictionary_hash(dictionary)}
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in S.read(shards).collect()), key=key) == sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    few = S.read(shards, [3, 500, 501, 99999]).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in few if r["doc_id"] != 3) == [(500, -1), (501, 0)] and sum(r["doc_id"] == 3 for r in few) == 2
    assert sum(len(r["data"]) for r in shards.collect()) < sum(len(r["data"]) for r in S.store(docs, b"").collect())


def test_edges(spark, docs):
    assert S.train_dictionary(docs.where("false")) == b"" and S.train_dictionary(docs.where("doc_id = 1")) == b""
    assert S.store(docs.where("false"), b"").count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        S.read(S.store(docs.where("doc_id = 1"), b"").withColumnRenamed("doc_ids", "n_tokenss"), id_col="n_tokens")
    shards = S.store(docs.where("doc_id = 1"), b"")
    broken = shards.selectExpr("shard", "'x' as dict_hash", "dictionary", "doc_ids", "offsets", "n_tokens", "data")
    with pytest.raises(Exception, match="hash"):
        S.read(broken).collect()


def test_the_dictionary_depends_on_the_rows_alone(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    few = frame(spark, [(i, " ".join(rng.choice("cookies privacy again the boilerplate about settings accept".split()) + str(rng.randrange(9)) for _ in range(80)), "en", "s", 0) for i in range(400)])
    drawn = few.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) < 1 << 28).limit(1)
    many = drawn.crossJoin(spark.range(7000).select()).coalesce(1)
    one, two = (S.train_dictionary(d, sample_docs=3000, dict_bytes=4096) for d in (many.unionByName(few), few.unionByName(many)))
    assert one and one == two
