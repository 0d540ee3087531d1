"""Token ids in a compact binary store with one shared zstandard dictionary.

Texts become arrays of 16-bit ids of a byte-level BPE vocabulary. A dictionary is trained on the
serialized arrays of a bounded sample and every document is compressed on its own against it,
so one short document can be read without its neighbours. A shard is one row: frames back to
back, the offset index, and the dictionary with its hash, which every frame also names.

Encoding goes by the vocabulary's own pre-tokenizer. Its pieces recur, so a worker keeps the ids of
what it has seen and calls the merge algorithm for the rest only. Most texts can be cut at their
spaces, which gives the same pieces and is faster. The driver reads the vocabulary and sends it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import refuse_names

#: Public byte-level BPE ranks, one "base64 rank" pair a line, below 65,536 ids.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_HELD = 400_000
#: Where white space makes pieces that reach over a space.
_MIXED = re.compile(r"\s \s|\s\s\Z")


def vocabulary_lines(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as lines:
        return lines.read()


class Encoder:
    """Text to little-endian 16-bit ids; pieces seen before are looked up."""

    def __init__(self, vocabulary: bytes | None = None) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (vocabulary or vocabulary_lines()).splitlines())}
        if max(ranks.values()) >= 0xFFFF:
            raise ValueError("ids and the end mark must fit 16 bits")
        #: The first id that is free: it ends a document where one is packed behind another.
        self.end = max(ranks.values()) + 1
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        encode = self.plain.encode_ordinary

        class Pieces(dict):
            def __init__(self, ahead: str) -> None:
                self.ahead = ahead

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= _HELD:
                    self.clear()
                ids = np.array(encode(self.ahead + piece), "<u2").tobytes()
                if len(piece) < 64:
                    self[piece] = ids
                return ids

        self.pieces, self.spaced = Pieces(""), Pieces(" ")

    def __call__(self, text: str) -> bytes:
        if _MIXED.search(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        # no piece reaches over a space that isn't between other white space: each takes it along in front
        first, *rest = text.split(" ")
        return self.pieces[first] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, raw: bytes) -> str:
        return self.plain.decode(np.frombuffer(raw, "<u2").tolist(), errors="strict")


def train_dictionary(docs: DataFrame, sample_docs: int = 2000, dict_bytes: int = 65536, vocabulary: str = VOCABULARY, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = 4096) -> bytes:
    """A zstandard dictionary from the ids of about `sample_docs` documents, drawn by a seeded hash of the row.

    The dictionary is fitted on a bounded sample: the drawn documents, however long, are cut into
    parts of `sample_bytes` of ids, equal parts count once, and of more than twice `sample_docs` those
    with the smallest hashes are taken, so the dictionary depends on the rows alone. Null and empty
    texts aren't drawn; an empty table, or too little to train on, gives an empty dictionary.
    """
    total = docs.count()
    if not total:
        return b""
    share = min(1.0, sample_docs / total)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), F.lit(1 << 30))
    source = docs.where(F.length(F.col(text_col)) > 0).where(draw < math.ceil(share * (1 << 30))).select(F.col(text_col).alias("text"))

    lines = vocabulary_lines(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines)
        for batch in batches:
            for text in batch.column("text"):
                ids = encoder(text.as_py())
                parts = [ids[a : a + sample_bytes] for a in range(0, len(ids), sample_bytes)]
                draws = np.array([xxhash.xxh64_intdigest(p, seed) >> 1 for p in parts], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(draws), pa.array(parts, pa.binary())], names=["draw", "part"])

    drawn = source.mapInArrow(run, "draw long, part binary").distinct().orderBy("draw", "part").limit(2 * sample_docs)
    parts = sorted(r["part"] for r in drawn.collect())
    try:
        return zstandard.train_dictionary(dict_bytes, [bytes(p) for p in parts]).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def store(docs: DataFrame, dictionary: bytes, vocabulary: str = VOCABULARY, level: int = 3, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards (shard, dict_hash, dictionary, <id>s, offsets, n_tokens, data): `offsets` has one entry more than documents.

    Document k of a shard is data[offsets[k]:offsets[k+1]], a zstandard frame of 16-bit ids. A shard
    is closed once it holds `shard_bytes`; a longer document is a shard of its own. Shards are cut
    within input partitions, so nothing is shuffled; `shard` is a hash of what a shard holds.

    * A null text is stored as -1 tokens in an empty slice, an empty one as 0 tokens; ids may be null.
    * Repeated rows are stored as often as they occur; an empty table gives no shards; other columns
      are not read.
    """
    refuse_names(f"{id_col}s", "shard", "dict_hash", "dictionary", "offsets", "n_tokens", "data")
    kind = dict(docs.dtypes)[id_col]
    shipped = docs.sparkSession.sparkContext.broadcast(dictionary)
    name, lines = dictionary_hash(dictionary), vocabulary_lines(vocabulary)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines)
        shared = zstandard.ZstdCompressionDict(shipped.value) if shipped.value else None
        if shared is not None:
            shared.precompute_compress(level=level)  # once for all frames
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        ids, frames, many, held, id_type = [], [], [], 0, None

        def close() -> pa.RecordBatch:
            data = b"".join(frames)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            shard = hashlib.sha256(repr(ids).encode() + data).hexdigest()[:16]
            columns = [[shard], [name], [shipped.value], [ids], [offsets], [many], [data]]
            types = [pa.string(), pa.string(), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "dict_hash", "dictionary", "ids", "offsets", "n_tokens", "data"])

        for batch in batches:
            id_type = batch.column("id").type
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                raw = encoder(text.as_py()) if text.is_valid else None
                frame = squeeze(raw) if raw else b""
                if frames and held + len(frame) > shard_bytes:
                    yield close()
                    ids, frames, many, held = [], [], [], 0
                ids.append(i), frames.append(frame), many.append(-1 if raw is None else len(raw) // 2)
                held += len(frame)
        if frames:
            yield close()

    out = source.mapInArrow(run, f"shard string, dict_hash string, dictionary binary, ids array<{kind}>, offsets array<long>, n_tokens array<int>, data binary")
    return out.withColumnRenamed("ids", f"{id_col}s")


def read(shards: DataFrame, wanted: list | None = None, vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, text) of the documents in the shards, or of the wanted ids alone.

    Shards that hold no wanted id are skipped by the index; of the others only the wanted
    frames are opened. A dictionary that doesn't match its hash raises ``ValueError``.

    A null text comes back as null with -1 tokens, an empty one as empty with 0. Ids that were stored
    several times come back as often, in the order of their shard; null ids are read unless ids are
    asked for, and wanted ids that aren't stored give nothing. No shards give an empty result.
    """
    refuse_names(id_col, "n_tokens", "ids", "text")
    ids_col = f"{id_col}s"
    kind = dict(shards.dtypes)[ids_col][6:-1]
    if wanted is not None:
        shards = shards.where(F.arrays_overlap(F.col(ids_col), F.lit(wanted).cast(f"array<{kind}>")))
    keep = None if wanted is None else set(wanted)
    source = shards.select("dict_hash", "dictionary", F.col(ids_col).alias("ids"), "offsets", "n_tokens", "data")

    lines = vocabulary_lines(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines)
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                if dictionary_hash(row["dictionary"]) != row["dict_hash"]:
                    raise ValueError("the shard's dictionary doesn't have the hash that is stored with it")
                shared = zstandard.ZstdCompressionDict(row["dictionary"]) if row["dictionary"] else None
                opened = zstandard.ZstdDecompressor(dict_data=shared).decompress
                at = [k for k, i in enumerate(row["ids"]) if keep is None or i in keep]
                raw = []
                for k in at:
                    many, frame = row["n_tokens"][k], row["data"][row["offsets"][k] : row["offsets"][k + 1]]
                    raw.append(None if many < 0 else opened(frame) if frame else b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["ids"][k] for k in at], id_type), pa.array([row["n_tokens"][k] for k in at], pa.int32()),
                        pa.array([None if r is None else np.frombuffer(r, "<u2").astype(np.int32) for r in raw], pa.list_(pa.int32())),
                        pa.array([None if r is None else encoder.decode(r) for r in raw], pa.string()),
                    ],
                    names=["id", "n_tokens", "ids", "text"],
                )

    return source.mapInArrow(run, f"id {kind}, n_tokens int, ids array<int>, text string").withColumnRenamed("id", id_col)
