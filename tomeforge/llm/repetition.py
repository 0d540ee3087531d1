"""Repetition inside a document, from its suffix array.

The suffix array of a text's UTF-8 bytes is built by prefix doubling: suffixes are ranked by
their first eight bytes, and groups that tie are ranked again by the rank of the suffix that
starts where the compared part ends, doubling the compared length each time. The longest common
prefix of a suffix and its neighbour is counted out only where the bytes before them differ;
elsewhere it is one less than that of the suffix a byte earlier. A suffix lies in one LCP interval on either side;
the longer of the two prefixes is the longest repeated substring that starts there. Those not
contained in the one that starts a byte earlier are the maximal repeats; the union of their spans
over all occurrences, as a fraction of the text, and the longest one are what a document is
judged by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, zeros behind the end."""
    b = np.zeros(len(text) + 8, np.uint64)
    b[: len(text)] = text
    b[: len(text)] += np.uint64(1)  # 255 isn't in UTF-8; a NUL in the text sorts behind the end
    two = (b[:-1] << np.uint64(8)) | b[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[: len(text)]


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the suffixes of UTF-8 in their order, whether each has eight bytes in common with the one before)."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    small = np.int32 if n < 1 << 30 else np.int64
    if n < 2:
        return np.arange(n, dtype=small), np.zeros(n, bool)
    key = _eight(raw)
    order = np.argsort(key).astype(small)
    key = key[order]
    tie = np.empty(n, bool)  # tie[i]: suffix i of the order equals its predecessor so far
    tie[0] = False
    np.equal(key[1:], key[:-1], out=tie[1:])
    del key
    eight = tie.copy()
    rank = np.empty(n, small)
    rank[order] = np.maximum.accumulate(np.where(tie, small(0), np.arange(n, dtype=small))) + small(1)  # 0 stands behind the end
    length = 8
    while True:
        open_ = tie.copy()
        open_[:-1] |= tie[1:]
        at = np.flatnonzero(open_).astype(small)
        if not len(at):
            return order, eight
        suffix = order[at]
        follow = suffix + small(length)
        pair = rank[suffix] * np.int64(n + 1)
        pair += np.where(follow < n, rank[np.minimum(follow, n - 1)], small(0))
        del follow
        by = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by], pair[by]
        del by
        order[at] = suffix
        same = np.empty(len(at), bool)
        same[0] = False
        np.equal(pair[1:], pair[:-1], out=same[1:])
        del pair
        tie[at] = same
        rank[suffix] = np.maximum.accumulate(np.where(same, small(0), at)) + small(1)
        length *= 2


def _common(raw: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix from p[i] and from q[i] on."""
    n = len(raw)
    out = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    step = 8
    while len(live) > 64:
        a, b = p[live] + out[live], q[live] + out[live]
        room = n - np.maximum(a, b)
        place = np.arange(step)
        differ = (raw[np.minimum(a[:, None] + place, n - 1)] != raw[np.minimum(b[:, None] + place, n - 1)]) | (place >= room[:, None])
        many = np.where(differ.any(axis=1), differ.argmax(axis=1), step)
        out[live] += many
        live = live[many == step]
        step = min(2 * step, max(8, (1 << 20) // max(1, len(live))))
    for i in live.tolist():
        a, b, size = int(p[i] + out[i]), int(q[i] + out[i]), 64
        while (room := min(size, n - max(a, b))) > 0:
            differ = np.flatnonzero(raw[a : a + room] != raw[b : b + room])
            many = int(differ[0]) if len(differ) else room
            out[i] += many
            if many < room:
                break
            a, b, size = a + room, b + room, min(2 * size, 1 << 20)
    return out


def common_prefixes(text: bytes, order: np.ndarray, eight: np.ndarray) -> np.ndarray:
    """By start of a suffix: its common prefix with the suffix before it in the order, exact where it is 8 or more."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    counted = before <= 0
    counted[:1] = True
    at = np.flatnonzero(~counted)
    counted[at] = raw[at - 1] != raw[before[at] - 1]
    at = np.flatnonzero(counted)
    known = np.zeros(len(at), np.int64)
    tied = np.zeros(n, bool)
    tied[order] = eight
    some = np.flatnonzero(tied[at])
    for low in range(0, len(some), 1 << 16):
        part = some[low : low + (1 << 16)]
        known[part] = _common(raw, at[part].astype(np.int64), before[at[part]].astype(np.int64))
    out = np.repeat((known + at).astype(order.dtype), np.diff(np.append(at, n)))
    out -= np.arange(n, dtype=order.dtype)
    return np.maximum(out, 0, out)


def repeats(text: bytes, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal repeated substrings' occurrences, by start; min_length is 8 at least."""
    order, eight = suffix_array(text)
    longest = common_prefixes(text, order, eight)
    following = longest[order[1:]]  # with the suffix behind it in the order
    longest[order[:-1]] = np.maximum(longest[order[:-1]], following)
    longest[longest < min_length] = 0
    fresh = longest > 0
    fresh[1:] &= longest[1:] >= longest[:-1]  # more than what the repeat one byte earlier covers from here
    start = np.flatnonzero(fresh)
    return start, longest[start].astype(np.int64)


def covered(start: np.ndarray, length: np.ndarray) -> int:
    """Positions in the union of the spans; starts ascend."""
    if not len(start):
        return 0
    end = np.maximum.accumulate(start + length)
    before = np.concatenate([[0], end[:-1]])
    return int(np.maximum(0, end - np.maximum(start, before)).sum())


def measure(docs: DataFrame, min_length: int = 50, text_col: str = "text") -> DataFrame:
    """All columns, with covered_fraction and longest_repeat (bytes) of each row's text.

    Null and empty texts, and texts without a repeat of `min_length` bytes, get 0 for both. Columns
    that already have these names are replaced. One pass over the rows, without a shuffle. A text's
    arrays take some 50 times its size while it is worked on, whatever it holds: 1.1 GB for 20 MB.
    """
    if min_length < 8:
        raise ValueError("min_length must be 8 at least")
    docs = docs.drop("covered_fraction", "longest_repeat")
    names, at = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names may hold anything

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fraction, most = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(at)):
                raw = text.as_buffer() if text.is_valid else None
                if raw is None or len(raw) <= min_length:
                    continue
                start, length = repeats(raw, min_length)
                if len(start):
                    fraction[i], most[i] = covered(start, length) / len(raw), length.max()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fraction), pa.array(most)], names=[*batch.schema.names, "covered_fraction", "longest_repeat"])

    schema = StructType([*docs.schema.fields, StructField("covered_fraction", DoubleType()), StructField("longest_repeat", LongType())])
    return docs.mapInArrow(run, schema).toDF(*names, "covered_fraction", "longest_repeat")


def keep_unrepetitive(docs: DataFrame, min_length: int = 50, max_fraction: float = 0.5, max_longest: int = 2000, text_col: str = "text") -> DataFrame:
    """The rows whose repeats of `min_length` bytes or more cover at most `max_fraction` of the
    text, none of them longer than `max_longest` bytes; with the two measures.

    Null and empty texts have no repeats and are kept. Repeated rows are judged alike. An empty
    table gives an empty result; other columns pass through unread.
    """
    return measure(docs, min_length, text_col).where((F.col("covered_fraction") <= max_fraction) & (F.col("longest_repeat") <= max_longest))
