"""Substring dedup: runs of words that occur again anywhere in the corpus, at any offset, are cut out.

Units are windows of `min_words` consecutive normalised words, whatever lines or paragraphs they
lie in: lines and paragraphs themselves can't find a passage that stands inside longer or differing
ones. Every window is hashed, digests meet over the whole corpus, the occurrence that ranks first
stays and all others go, joined to spans of the original text where they overlap.

To meet, windows are keyed by the least hash of the short word runs inside them: equal windows have
equal keys, and neighbours mostly share one, so some twenty windows cross the shuffle as one row. A
window that has an earlier place in its own chunk of text is known to go and isn't shuffled, so a
passage that a third of all documents share sends one row a chunk; where chunks are many, rows of
one key meet in salted parts first, each of which sends on what is earliest in it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import as_text, blocks, buckets_for, free_name, mix64, text_bytes

_CHAR, _WORD, _SHORT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Bytes of a window's hash that cross the shuffle, besides the 64 bits of its key.
HASH_BYTES = 6
#: Bytes of text in which windows meet before anything is shuffled.
CHUNK_BYTES = 8 << 20


@functools.cache
def _letters() -> np.ndarray:
    """By code point: its lower case where it is a letter, mark or digit, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] in "LMN":
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _inverse(odd: np.uint64) -> int:
    return pow(int(odd), -1, 1 << 64)


def _runs(values: np.ndarray, base: np.uint64, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[first:end] for each pair, the same wherever the run lies."""
    n = len(values)
    up, down = np.full(n, base), np.full(n + 1, np.uint64(_inverse(base)))
    up[:1], down[0] = 1, 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * np.cumprod(up), out=total[1:])
    return mix64((total[end] - total[first]) * np.cumprod(down)[first])


def words_at(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first character, end, hash) of every run of letters, marks and digits, in lower case."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    chars = _letters()[np.frombuffer("\n".join([*texts.to_pylist(), ""]).encode("utf-32-le"), np.uint32)]
    edge = np.flatnonzero(np.diff((chars > 0).view(np.int8), prepend=0, append=0))
    first, end = edge[::2], edge[1::2]
    doc = np.searchsorted(begin, first, side="right") - 1
    return doc, first - begin[doc], end - begin[doc], _runs(chars.astype(np.uint64), _CHAR, first, end)


def _least(values: np.ndarray, many: int) -> np.ndarray:
    """Minimum of each `many` neighbours."""
    have = 1
    while have < many:
        step = min(have, many - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def windows(code: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, hash) of each window of `min_words` words; the key depends on the window's words alone."""
    short = max(1, min_words // 4)
    at = np.arange(len(code) - short + 1)
    key = _least(_runs(code, _SHORT, at, at + short), min_words - short + 1)
    at = np.arange(len(code) - min_words + 1)
    return key, _runs(code, _WORD, at, at + min_words)


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows values[bounds[i]:bounds[i + 1]] as bytes; values has one line for each window."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array) -> np.ndarray:
    """All bytes of the rows, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _joined(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


_COLUMNS = ["key", "chunk", "id", "rank", "sig", "start", "end", "digest", "starts", "ends"]
_PLACE = [("rank", "ascending"), ("id", "ascending"), ("sig", "ascending")]


def _pack(owner: pa.Table, row: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, digest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows in the order of their places as rows, one for each run of equal documents (rows of `owner`) and keys."""
    if not len(row):
        return
    new = np.append(True, (np.diff(row) != 0) | (key[1:] != key[:-1]))
    head = np.flatnonzero(new)
    steps = [np.where(new, 0, np.diff(x, prepend=0)) for x in (start, end)]
    # the rows whose steps don't fit a byte go apart, with wider ones
    of = np.cumsum(new) - 1
    large = np.zeros(len(head), bool)
    large[of[(steps[0] > 255) | (steps[1] > 255)]] = True
    for wide, kind in ((False, np.uint8), (True, np.uint32)):
        rows = np.flatnonzero(large == wide)
        if not len(rows):
            continue
        at = np.flatnonzero(large[of] == wide)
        bounds = np.append(0, np.cumsum(np.bincount(of[at], minlength=len(head))[rows]))
        own = owner.take(pa.array(row[head[rows]])).combine_chunks()
        columns = [pa.array(key[head[rows]].view(np.int64)), *(own.column(c).combine_chunks() for c in ("chunk", "id", "rank", "sig")), pa.array(start[head[rows]]), pa.array(end[head[rows]])]
        yield pa.RecordBatch.from_arrays([*columns, _packed(digest[at], bounds), *(_packed(s[at].astype(kind), bounds) for s in steps)], names=_COLUMNS)


def _pieces(owner: pa.Table, row: np.ndarray, start: np.ndarray, end: np.ndarray, later: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row without windows for each run of windows of one row of `owner` that go."""
    begins = later & np.append(True, ~later[:-1] | (row[1:] != row[:-1]))[: len(later)]
    ends = later & np.append(~later[1:] | (row[1:] != row[:-1]), True)[: len(later)]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    if len(a):
        own = owner.take(pa.array(row[a])).combine_chunks()
        chunk, ids, rank, sig = (own.column(c).combine_chunks() for c in ("chunk", "id", "rank", "sig"))
        yield pa.RecordBatch.from_arrays([sig, chunk, ids, rank, sig, pa.array(start[a]), pa.array(end[b]), *(pa.nulls(len(a), pa.binary()) for _ in range(3))], names=_COLUMNS)


def _first_of(code: np.ndarray) -> np.ndarray:
    """Index of the first equal value."""
    order = np.argsort(code, kind="stable")
    leads = np.append(True, code[order[1:]] != code[order[:-1]])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(leads)][np.cumsum(leads) - 1]
    return first


def _explode(min_words: int):
    """Rows of a chunk's windows that have no earlier place in the chunk, and pieces of the others."""

    def chunk_rows(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([block])
        table = table.take(pc.sort_indices(table, _PLACE, null_placement="at_end")).combine_chunks()
        plain = table.column("sig").combine_chunks().to_numpy()
        named = table.column("id").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        table = table.filter(pa.array(np.append(True, (plain[1:] != plain[:-1]) | (named[1:] != named[:-1]))))  # repeated rows
        base, found = 0, []
        for small in blocks(table.combine_chunks().to_batches()[0], "text", 2 << 20):
            doc, first, end, code = words_at(as_text(small.column("text")))
            if len(code) >= min_words:
                key, digest = windows(code, min_words)
                own = np.flatnonzero(doc[: len(key)] == doc[min_words - 1 :])
                found.append((doc[own] + base, first[own], end[own + min_words - 1], key[own], digest[own]))
            base += small.num_rows
        if not found:
            return
        row, start, end, key, digest = (np.concatenate(x) for x in zip(*found))
        owner = table.drop_columns(["text"]).append_column("chunk", pa.array(np.full(len(table), plain[0] >> 1 if len(plain) else 0)))
        keep = np.uint64((1 << 8 * HASH_BYTES) - 1)
        later = _first_of(mix64((digest & keep) ^ mix64(key))) != np.arange(len(row))
        yield from _pieces(owner, row, start, end, later)
        new = np.flatnonzero(~later)
        short = digest[new].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
        yield from _pack(owner, row[new], start[new], end[new], key[new], short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", CHUNK_BYTES):
                yield from chunk_rows(block)

    return run


def _meet(forward: bool):
    """Rows of some keys: pieces of the windows that have an earlier place, and with `forward` the rows of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = []
        for batch in batches:
            whole = batch.filter(pc.is_valid(batch.column("digest")))
            if whole.num_rows < batch.num_rows:
                yield batch.filter(pc.is_null(batch.column("digest")))
            if whole.num_rows:
                full.append(whole)
        if not full:
            return
        table = pa.Table.from_batches(full)
        table = table.take(pc.sort_indices(table, [*_PLACE, ("start", "ascending")], null_placement="at_end")).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        size = pc.binary_length(column("digest")).to_numpy().astype(np.int64) // HASH_BYTES
        row = np.repeat(np.arange(len(size)), size)
        head = np.cumsum(size) - size
        digest = np.zeros((len(row), 8), np.uint8)
        digest[:, :HASH_BYTES] = _flat(column("digest")).reshape(-1, HASH_BYTES)
        key = column("key").to_numpy().view(np.uint64)[row]
        code = mix64(digest.view(np.uint64).reshape(-1) ^ mix64(key))
        wide = pc.binary_length(column("starts")).to_numpy() > size
        places = []
        for origin, steps in (("start", "starts"), ("end", "ends")):
            step = np.zeros(len(row), np.int64)
            for large, kind in ((False, np.uint8), (True, np.uint32)):
                rows = np.flatnonzero(wide == large)
                step[_joined(head[rows], size[rows])] = _flat(column(steps).take(pa.array(rows))).view(kind)
            total = np.cumsum(step)
            places.append(total - total[head][row] + column(origin).to_numpy()[row])
        start, end = places
        # rows stand in the order of their places, and so do the windows of equal hashes
        first = _first_of(code)
        ids, sig = column("id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False), column("sig").to_numpy()
        same = (ids[row] == ids[row[first]]) & (sig[row] == sig[row[first]]) & (start == start[first])
        yield from _pieces(table, row, start, end, ~same)
        if forward:
            new = np.flatnonzero(first == np.arange(len(row)))
            yield from _pack(table, row[new], start[new], end[new], key[new], digest[new][:, :HASH_BYTES])

    return run


def repeated_passages(
    docs: DataFrame,
    min_words: int = 50,
    rank_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    fan_in: int = 4096,
) -> DataFrame:
    """(id, sig, spans): the passages to remove of each document that has any, as sorted [start, end] pairs.

    A passage is a stretch that is covered by windows of `min_words` words each of which occurs at an
    earlier place: of a smaller `rank_col` (the id where it is None), then id, then `sig` (the hash of
    the text), then start. Words are compared in lower case without what stands between them. Offsets
    count characters of the original text, from the first word's start to the last one's end. Every
    window's first occurrence in the corpus stays. Windows of one text that overlap count as any others.

    * Texts of fewer words are left alone, as are null ones. Rows with a null rank or id rank last.
      Repeated rows (same id and text) count as one document; rows of one id with different texts are
      different documents. An empty table gives an empty result. Other columns are not read.
    * One row for some twenty windows is shuffled, about 8 bytes a window. Rows of one key come from
      at most `fan_in` chunks of text where they meet, or parts of a level before.
    """
    kinds = dict(docs.dtypes)
    source = docs.select(F.col(id_col).alias("id"), F.col(rank_col or id_col).alias("rank"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    schema = f"key long, chunk long, id {kinds[id_col]}, rank {kinds[rank_col or id_col]}, sig long, start long, end long, digest binary, starts binary, ends binary"
    rows = source.where(F.col("text").isNotNull()).mapInArrow(_explode(min_words), schema)
    nbytes = text_bytes(source)
    parts, chunks = buckets_for(nbytes, 12 << 20), buckets_for(nbytes, CHUNK_BYTES, 1)
    while chunks > fan_in:
        chunks = -(-chunks // fan_in)
        rows = rows.withColumn("chunk", F.pmod("chunk", F.lit(chunks))).repartition(parts, "key", "chunk").mapInArrow(_meet(forward=True), schema)
    pieces = rows.repartition(parts, "key").mapInArrow(_meet(forward=False), schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own in batch.column("spans").to_pylist():
                whole: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in own):
                    if whole and start <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], end)
                    else:
                        whole.append([start, end])
                spans.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sig"), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["id", "sig", "spans"])

    grouped = pieces.groupBy("id", "sig").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(joined, f"id {kinds[id_col]}, sig long, spans array<array<long>>")


def cut_passages(
    docs: DataFrame,
    min_words: int = 50,
    rank_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    fan_in: int = 4096,
) -> DataFrame:
    """All rows and columns, with the passages of :func:`repeated_passages` cut out of the text, and `removed`.

    `removed` has their [start, end] in characters of the original text, end exclusive. A document
    without such passages is unchanged and has an empty list; null texts stay null. A column that is
    called `removed` already is replaced. Repeated rows are cut alike; an empty table stays empty.
    """
    docs = docs.drop("removed")
    mark, sig, spans = (free_name(c, docs) for c in ("cut_id", "cut_sig", "cut_spans"))
    found = repeated_passages(docs, min_words, rank_col, id_col, text_col, fan_in).select(F.col("id").alias(mark), F.col("sig").alias(sig), F.col("spans").alias(spans))
    both = docs.join(found.hint("shuffle_hash"), (F.xxhash64(text_col) == F.col(sig)) & F.col(id_col).eqNullSafe(F.col(mark)), "left").drop(mark, sig)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.column(spans), batch.column(text_col)
            changed = {}
            for i in np.flatnonzero(pc.is_valid(own).to_numpy(zero_copy_only=False)).tolist():
                text, last, parts = texts[i].as_py(), 0, []
                for start, end in own[i].as_py():
                    parts.append(text[last:start])
                    last = end
                changed[i] = "".join([*parts, text[last:]])
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], texts.type))
            columns = [texts if c == text_col else pc.fill_null(own, pa.scalar([], own.type)) if c == spans else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return both.mapInArrow(run, both.schema).withColumnRenamed(spans, "removed")


SQL = r"""
WITH parts AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS o,
                      string_split_regex(text, '[\p{L}\p{M}\p{N}]+') AS gap FROM documents WHERE text IS NOT NULL),
flat AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(list_transform(range(1, len(w) + 1), lambda i: length(gap[i]))) AS g, unnest(list_transform(o, lambda x: length(x))) AS n FROM parts),
place AS (SELECT doc_id, k, (sum(g + n) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e, n FROM flat),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS k, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i+49], ' ')))) AS h FROM parts WHERE len(w) >= 50),
later AS (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1),
span AS (SELECT l.doc_id, a.e - a.n AS s, b.e AS e FROM later l JOIN place a ON a.doc_id = l.doc_id AND a.k = l.k JOIN place b ON b.doc_id = l.doc_id AND b.k = l.k + 49),
step AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM span),
island AS (SELECT doc_id, s, e, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM step),
cut AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM island GROUP BY doc_id, i),
around AS (SELECT doc_id, s, e, lag(e, 1, 0::BIGINT) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM cut),
gone AS (SELECT a.doc_id, list([a.s, a.e] ORDER BY a.s) AS removed, string_agg(substring(d.text, a.p + 1, a.s - a.p), '' ORDER BY a.s) || substring(any_value(d.text), max(a.e) + 1) AS text
         FROM around a JOIN documents d ON d.doc_id = a.doc_id GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(g.text, d.text) AS text, coalesce(g.removed, []::BIGINT[][]) AS removed FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id"""
