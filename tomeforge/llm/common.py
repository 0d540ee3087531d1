"""Helpers that several corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.sources.shared import new_path, shared_folder

#: What a normalised word may hold; the rest of a word is dropped.
WORD_CHARS = r"\p{L}\p{M}\p{N}"


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """The rows as Parquet in a new folder of the shared checkpoint folder, read again."""
    frame.write.parquet(path := new_path(frame.sparkSession, "written"))
    return frame.sparkSession.read.parquet(path)


def free_name(name: str, frame: DataFrame) -> str:
    """The name, with underscores behind it until no column of the frame has it in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse_names(column: str, *names: str) -> None:
    """``ValueError`` where a column that is returned has the name of one that the operator adds."""
    if column.lower() in {n.lower() for n in names}:
        raise ValueError(f"{column!r} is the name of a column of the result; rename it first")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes over the whole column: one scan, used to size partitions by the data."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def buckets_for(nbytes: int, each: int, least: int = 8) -> int:
    return max(least, math.ceil(nbytes / each))


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of large strings; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(batch: pa.RecordBatch, text_col: str, nbytes: int = 4 << 20, rows: int = 32768) -> Iterator[pa.RecordBatch]:
    """Slices of about nbytes of text; a text longer than that is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > nbytes or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings; an empty string gets 0, which no other string has."""
    out = np.fromiter(
        (xxhash.xxh64_intdigest(v, seed) | 1 if v else 0 for v in values.to_pylist()), dtype=np.uint64, count=len(values)
    )
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(offsets by text, distinct raw words, index of each word), split at white space."""
    split = pc.utf8_split_whitespace(texts)
    coded = split.values.dictionary_encode()
    return split.offsets.to_numpy(), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every normalised word: lower case, only letters, marks and digits."""
    offsets, dictionary, index = words(pc.utf8_lower(texts))
    plain = pc.replace_substring_regex(dictionary, f"[^{WORD_CHARS}]+", "")
    code = hash_strings(plain)[index] if len(dictionary) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(offsets))
    kept = code != 0
    return doc[kept], code[kept]


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
