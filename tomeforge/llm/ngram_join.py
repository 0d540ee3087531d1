"""All pairs of documents whose word n-gram sets have at least a given Jaccard similarity.

The method is an exact prefix-filtering set-similarity join:

1. Each text becomes the set of its hashed word n-grams. Documents with equal sets share one
   64-bit signature, which stands for them from here on; who has it is kept aside.
2. Sets are shuffled by n-gram, packed by block. An n-gram's document frequency gives the global
   order, rarest first. N-grams of one set alone come first in their document's order and can't
   match anything, so only their number is kept; the others go back to their document. What more
   than a 1,024th of all documents have is known from a pass before; any order keeps the method
   exact, so those n-grams come last by their hash and stay with their document: nothing common
   is gathered in one place.
3. A document of n grams probes with its first n - ceil(t n) + 1; often these are all unique, and
   it is done. The rest are joined on prefix n-grams, with length and positional filters, and a
   suffix filter that bounds the overlap by the smaller count in each of eight hash classes. A pair
   is passed over where both bring along an earlier n-gram in common, as it meets there already.
4. Pairs are made distinct, keeping the first n-gram they met at. Sets are sent to that n-gram,
   once for all their pairs there, and each pair is verified there once, by full overlap. An
   n-gram with very many pairs is cut into cells, so no task holds all pairs of a large class, and
   where only classes are asked for a cell tells each set's number of links and the smallest set
   that they connect it with instead of its pairs.

Packed rows hold plain little-endian arrays; every partition is sized from the bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import as_text, blocks, buckets_for, cut, free_name, mix64, normal_words, text_bytes

HASH_BITS = 48
CLASSES = 8
#: Text bytes per n-gram bucket: about a million n-grams, 50 MB in a Python worker.
BUCKET_BYTES = 6 << 20
#: Preceding n-grams of its document that a probing one brings along.
WITNESSES = 2
#: Pairs that are verified together.
CELL_PAIRS = 200_000
#: Stands for the frequency of common n-grams: behind all others in the order.
LAST = 1 << 40


def least_overlap(a, b, threshold: float):
    """Smallest overlap with which sets of sizes a and b reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def prefix_length(size, threshold: float):
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _gram_keys(texts: pa.Array, n: int) -> np.ndarray:
    """Text number << 48 | 48-bit n-gram. A text of fewer than n words has one gram, all of it."""
    doc, code = normal_words(texts)
    counts = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    keys = []
    for k in range(1, n + 1):
        if k == n:
            at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        else:
            at = starts[counts == k]
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + code[at + j])
        keys.append((doc[at].astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS)))
    return np.concatenate(keys)


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 48-bit n-gram), distinct and sorted by both."""
    key = np.sort(_gram_keys(texts, n))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, only as many as the largest needs; the first byte says how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _sorted_planes(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=values[:1] * 0))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


_PACKED = "bucket long, kind int, owners binary, sizes binary, ids binary, index binary, grams binary"
_COLUMNS = ["bucket", "kind", "owners", "sizes", "ids", "index", "grams"]
_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 5]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_COLUMNS)


#: N-grams are common where this share of the documents, and so many at least, have one of their slot.
COMMON_SHARE, COMMON_LEAST, SLOT_BITS = 1 / 1024, 256, 22


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(HASH_BITS - SLOT_BITS)).astype(np.int64)


def _common_slots(source: DataFrame, n: int) -> np.ndarray:
    """Whether each of 2^22 slots of n-gram hashes is common over all documents.

    A task sends the slots that reach half the share in its own documents; a slot that has the share
    over all does so in some. At most 2,048 slots for each n-gram of an average document are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs = np.zeros(1 << SLOT_BITS, np.int32), 0
        for batch in batches:
            docs += batch.num_rows
            for block in blocks(batch, "text", 2 << 20):
                np.add.at(table, _slot(_gram_keys(as_text(block.column("text")), n) & np.uint64((1 << HASH_BITS) - 1)), np.int32(1))
        slots = np.flatnonzero(table >= max(1.0, docs * COMMON_SHARE / 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(table[slots], docs).astype(np.int64))], names=["slot", "n"])

    found = source.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(f"slot < 0 or n >= {COMMON_LEAST}").collect()
    docs = sum(r["n"] for r in found if r["slot"] < 0)
    common = np.zeros(1 << SLOT_BITS, bool)
    common[[r["slot"] for r in found if r["slot"] >= 0 and r["n"] >= docs * COMMON_SHARE]] = True
    return common


def _by_signature(signature: np.ndarray, owner: np.ndarray, gram: np.ndarray, df: np.ndarray, kind: int, buckets: int) -> Iterator[tuple]:
    """A row for each bucket of signatures of (owner's signature, n-gram, its frequency)."""
    home = (signature[owner] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    owner, gram, df, home = owner[order], gram[order], df[order], home[order]
    for at, many in zip(*_runs(home)):
        part = slice(at, at + many)
        names, index = np.unique(signature[owner[part]], return_inverse=True)
        yield int(home[at]), kind, _sorted_planes(names), _planes(df[part]), b"", _planes(index.astype(np.uint64)), _sorted_planes(gram[part])


def _scan(n: int, buckets: int, common: Broadcast):
    """Texts to packed rows: kind 0 holds (signature, id, size) of documents, kind 1 n-grams of signatures, kind 2 ids without words, kind 3 common n-grams for the bucket of their signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 6 << 20):
                doc, gram = gram_sets(as_text(block.column("text")), n)
                every = block.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                if len(bare := every[np.bincount(doc, minlength=len(every)) == 0]):
                    yield _batch([(int(bare[0] % buckets), 2, b"", b"", bare.tobytes(), b"", b"")])
                if not len(doc):
                    continue
                first, size = _runs(doc)
                signature = np.add.reduceat(mix64(gram + np.uint64(1)), first)
                signature = mix64(signature + size.astype(np.uint64))
                ids = every[doc[first]]
                rows = []
                home = (signature % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                for at, many in zip(*_runs(home[order])):
                    own = order[at : at + many]
                    rows.append((int(home[own[0]]), 0, signature[own].tobytes(), size[own].tobytes(), ids[own].tobytes(), b"", b""))
                # copies inside the block count once
                _, only = np.unique(signature, return_index=True)
                keep = np.zeros(len(first), bool)
                keep[only] = True
                owner = np.repeat(np.arange(len(first)), size)
                keep = keep[owner]
                owner, gram = owner[keep], gram[keep]
                order = np.argsort(gram)
                owner, gram = owner[order], gram[order]
                many = common.value[_slot(gram)]
                rows.extend(_by_signature(signature, owner[many], gram[many], np.full(many.sum(), LAST, np.uint64), 3, buckets))
                owner, gram = owner[~many], gram[~many]
                home = ((gram >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                for at, many in zip(*_runs(home)):
                    here = owner[at : at + many]
                    table, index = np.unique(here, return_inverse=True)
                    by = np.argsort(signature[table])
                    place = np.empty(len(by), np.int64)
                    place[by] = np.arange(len(by))
                    index = place[index]
                    rows.append((int(home[at]), 1, _sorted_planes(signature[table[by]]), b"", b"", _planes(index.astype(np.uint64)), _sorted_planes(gram[at : at + many])))
                yield _batch(rows)

    return run


def _frequencies(buckets: int):
    """One bucket of n-grams: those of two or more signatures go back, with their document frequency, by signature."""

    def run(table: pa.Table) -> pa.Table:
        passed, owners, grams = [], [], []
        for row in table.to_pylist():
            if row["kind"] != 1:
                passed.append(tuple(row[c] for c in _COLUMNS))
                continue
            names = np.cumsum(_unplanes(row["owners"]))
            owners.append(names[_unplanes(row["index"]).astype(np.int64)])
            grams.append(np.cumsum(_unplanes(row["grams"])))
        if grams:
            gram, owner = np.concatenate(grams), np.concatenate(owners)
            order = np.argsort(gram, kind="stable")  # runs are sorted already: a merge
            gram, owner = gram[order], owner[order]
            first, many = _runs(gram)
            shared = np.repeat(many > 1, many)
            gram, owner = gram[shared], owner[shared]
            order = np.lexsort((owner, gram))
            gram, owner = gram[order], owner[order]
            if len(gram):
                fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
                gram, owner = gram[fresh], owner[fresh]  # copies in several blocks
            first, many = _runs(gram)
            df = np.repeat(many, many)
            gram, owner, df = gram[df > 1], owner[df > 1], df[df > 1]
            passed.extend(_by_signature(owner, np.arange(len(owner)), gram, df.astype(np.uint64), 1, buckets))
        return pa.Table.from_batches([_batch(passed)])

    return run


_SETS = "kind int, doc long, id long, size long, probes int, ranks binary, grams binary, classes binary"


def _sets(threshold: float):
    """One bucket of signatures: which ids have which (kind 0), sets that may have partners (kind 1), ids without one (kind 2).

    `doc` is the signature. `grams` are the n-grams that others
    share, in global order and by byte planes; the first `probes` fall into the prefix, and `ranks` has their frequencies.
    """

    def run(table: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        member, shared, bare = [(none.view(np.uint64), none, none)], [], [none]
        for row in table.to_pylist():
            if row["kind"] == 2:
                bare.append(np.frombuffer(row["ids"], np.int64))
            elif row["kind"] == 0:
                names = np.frombuffer(row["owners"], np.uint64)
                member.append((names, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)))
            else:
                names = np.cumsum(_unplanes(row["owners"]))
                shared.append((names[_unplanes(row["index"]).astype(np.int64)], _unplanes(row["sizes"]), np.cumsum(_unplanes(row["grams"]))))
        owner, ids, size = (np.concatenate(x) for x in zip(*member))
        order = np.lexsort((ids, owner))
        owner, ids, size = owner[order], ids[order], size[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])  # a repeated row is no further copy
        owner, ids, size = owner[fresh], ids[fresh], size[fresh]
        first = _runs(owner)[0]
        out = []
        if shared:
            who, df, gram = (np.concatenate(x) for x in zip(*shared))
            order = np.lexsort((gram, df, who))
            who, df, gram = who[order], df[order], gram[order]
            fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (who[1:] != who[:-1])])  # common ones of copies in several blocks
            who, df, gram = who[fresh], df[fresh], gram[fresh]
            at = np.searchsorted(owner[first], who[_runs(who)[0]])
            for k, (s, m) in zip(at, zip(*_runs(who))):
                n = int(size[first[k]])
                probes = int(prefix_length(np.int64(n), threshold)) - (n - m)
                if probes > 0:
                    g = gram[s : s + m]
                    classes = np.bincount((g % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES).astype("<u4")
                    out.append((int(owner[first[k]].view(np.int64)), n, min(probes, m), _planes(df[s : s + min(probes, m)]), _planes(g), classes.tobytes()))
        bare = np.unique(np.concatenate(bare))
        ids, owner = np.concatenate([ids, bare]), np.concatenate([owner.view(np.int64), np.zeros(len(bare), np.int64)])
        kind = np.repeat(np.array([0, 2], np.int32), [len(ids) - len(bare), len(bare)])
        zero = np.zeros(len(ids), np.int64)
        held = pa.Table.from_arrays([pa.array(kind), pa.array(owner), pa.array(ids), pa.array(zero), pa.array(zero.astype(np.int32)), *(pa.nulls(len(ids), pa.binary()) for _ in range(3))], names=_SET_COLUMNS)
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        doc, *rest = (pa.array(c, t) for c, t in zip(columns, types))
        probing = pa.Table.from_arrays([pa.array(np.ones(len(out), np.int32)), doc, pa.array(np.zeros(len(out), np.int64)), *rest], names=_SET_COLUMNS)
        return pa.concat_tables([held, probing])

    return run


_SET_COLUMNS = ["kind", "doc", "id", "size", "probes", "ranks", "grams", "classes"]


_EARLIER = [f"earlier{k}" for k in range(1, WITNESSES + 1)]
_PROBES = "gram long, df long, doc long, size long, place long, classes binary, " + ", ".join(f"{e} long" for e in _EARLIER)


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each probing n-gram; `place` is its position in the whole set's order."""
    for batch in batches:
        for row in batch.to_pylist():
            gram, df = _unplanes(row["grams"]), _unplanes(row["ranks"])
            p, unique = row["probes"], row["size"] - len(gram)
            earlier = [np.concatenate([np.full(min(k, p), -1), gram[: max(0, p - k)].astype(np.int64)]) for k in range(1, WITNESSES + 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram[:p].astype(np.int64)), pa.array(df[:p].astype(np.int64)), pa.array(np.full(p, row["doc"])),
                    pa.array(np.full(p, row["size"])), pa.array(np.arange(unique, unique + p)), pa.array([row["classes"]] * p, pa.binary()),
                    *map(pa.array, earlier),
                ],
                names=["gram", "df", "doc", "size", "place", "classes", *_EARLIER],
            )


def _merge_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for small in _probe_rows(batches):
        held.append(small)
        rows += small.num_rows
        if rows > 100_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_PAIR = "a long, b long, df long, gram long"


def _candidates(threshold: float, most: int = 200_000):
    """Pairs that meet in one bucket of probing n-grams and pass the filters, with the first n-gram they meet at.

    They are passed on in batches of about `most`, however many there are, so memory follows the
    bucket's n-grams. A pair is told once a batch; further ones are taken out where pairs are made distinct.
    """

    def first_met(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
        rows = rows[order]
        return rows[np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])] if len(rows) else rows

    def batch(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, c].copy()) for c in range(4)], names=["a", "b", "df", "gram"])

    def places(many: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows with the same n-gram whose sizes may fit, some `most` at a time; the first has the smaller set."""
        for length in np.unique(many[many > 1]):
            lists = first[many == length]
            if length <= 512:
                up = np.triu_indices(length, 1)
                step = max(1, most // len(up[0]))
                for s in range(0, len(lists), step):
                    base = lists[s : s + step, None]
                    yield (base + up[0]).ravel(), (base + up[1]).ravel()
            else:
                for start in lists:
                    # sizes ascend: partners of i end where sizes pass size[i] / t
                    sizes = size[start : start + length]
                    ends = np.searchsorted(sizes, sizes / threshold + 1e-9, side="right")
                    before = np.append(0, np.cumsum(ends - np.arange(length) - 1))
                    for low in range(0, int(before[-1]), most):
                        pair = np.arange(low, min(low + most, int(before[-1])))
                        i = np.searchsorted(before, pair, side="right") - 1
                        yield start + i, start + i + 1 + pair - before[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        gram, df, doc, size, place = (table.column(c).to_numpy() for c in ("gram", "df", "doc", "size", "place"))
        classes = np.frombuffer(b"".join(table.column("classes").to_pylist()), "<u4").reshape(-1, CLASSES).astype(np.int64)
        earlier = [table.column(e).to_numpy() for e in _EARLIER]
        order = np.lexsort((size, gram, df))
        earlier = [e[order] for e in earlier]
        gram, df, doc, size, place, classes = gram[order], df[order], doc[order], size[order], place[order], classes[order]
        first, many = _runs(gram)
        parts: list[np.ndarray] = []
        for i, j in places(many, first, size):
            keep = (size[i] >= threshold * size[j] - 1e-9) & (doc[i] != doc[j])
            i, j = i[keep], j[keep]
            met = np.zeros(len(i), bool)
            for x in earlier:
                for y in earlier:
                    met |= (x[i] == y[j]) & (x[i] >= 0)
            i, j = i[~met], j[~met]
            need = least_overlap(size[i], size[j], threshold)
            # the pair's first common n-gram passes: all they share lies at or behind it
            keep = 1 + np.minimum(size[i] - place[i] - 1, size[j] - place[j] - 1) >= need
            i, j, need = i[keep], j[keep], need[keep]
            bound = np.zeros(len(i), np.int64)
            for c in range(CLASSES):
                bound += np.minimum(classes[i, c], classes[j, c])
            i, j = i[bound >= need], j[bound >= need]
            if len(i):
                parts.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), df[i], gram[i]], axis=1))
                if sum(map(len, parts)) > 2 * most:
                    parts = [first_met(parts)]
                    if len(parts[0]) > most:
                        yield batch(parts.pop())
        if parts:
            yield batch(first_met(parts))

    return run


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, block: int = 512) -> np.ndarray:
    """Common elements of sets[i] and sets[j]: by a merge for few pairs, by a product of 0/1 matrices for many."""
    out = np.zeros(len(i), np.int64)
    if len(i) * 16 < len(sets) ** 2 or len(sets) < 12:
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            out[k] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.searchsorted(owner, np.arange(0, len(sets) + 2 * block, block))
    cell = (i // block) * (len(sets) // block + 1) + j // block
    order = np.argsort(cell, kind="stable")
    for first, many in zip(*_runs(cell[order])):
        k = order[first : first + many]
        bi, bj = int(i[k[0]] // block), int(j[k[0]] // block)
        total = np.zeros((block, block), np.float32)
        for low in range(0, len(names), 8192):
            tall = []
            for b in (bi, bj):
                own, at = owner[begin[b] : begin[b + 1]], column[begin[b] : begin[b + 1]]
                here = (at >= low) & (at < low + 8192)
                m = np.zeros((block, min(8192, len(names) - low)), np.float32)
                m[own[here] - b * block, at[here] - low] = 1
                tall.append(m)
            total += tall[0] @ tall[1].T
        out[k] = total[i[k] - bi * block, j[k] - bj * block].astype(np.int64)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n numbers the smallest one that the pairs connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        now = root.copy()
        for end in (i, j):
            np.minimum.at(now, end, low)
            np.minimum.at(now, root[end], low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


_VERIFIED = "a long, b long, jaccard double"
_COUNTED = "doc long, root long, links long"


def _verify(threshold: float, counted: bool):
    """The similar ones of the pairs of one bucket. `counted`: not one by one, but each set's number of them, and the smallest set that they connect it with."""

    def run(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        cell, a, b = (pairs.column(c).to_numpy() for c in ("cell", "a", "b"))
        at = docs.column("at").to_numpy()
        doc, size = docs.column("doc").to_numpy(), docs.column("size").to_numpy()
        raw = docs.column("grams").to_pylist()
        order = np.lexsort((doc, at))
        at, doc, size = at[order], doc[order], size[order]
        by = np.argsort(cell, kind="stable")
        cell, a, b = cell[by], a[by], b[by]
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if counted else np.float64))]
        first, many = _runs(at)
        start = dict(zip(at[first].tolist(), zip(first.tolist(), many.tolist())))
        for s, m in zip(*_runs(cell)):
            f, k = start[int(cell[s])]
            here = doc[f : f + k]
            sets = [np.sort(_unplanes(raw[order[x]])) for x in range(f, f + k)]
            i, j = np.searchsorted(here, a[s : s + m]), np.searchsorted(here, b[s : s + m])
            common = overlaps(sets, i, j)
            jaccard = common / (size[f + i] + size[f + j] - common)
            good = jaccard >= threshold - 1e-12
            if counted:
                links = np.bincount(np.concatenate([i[good], j[good]]), minlength=k)
                some = np.flatnonzero(links)
                out.append((here[some], here[_roots(k, i[good], j[good])[some]], links[some]))
            else:
                out.append((here[i][good], here[j][good], jaccard[good]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["doc", "root", "links"] if counted else ["a", "b", "jaccard"])

    return run


def _similar_sets(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str, counted: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, doc) of every document with words, `doc` being its set's signature, what `_verify` tells of similar sets, and the other ids."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer column")
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = buckets_for(text_bytes(source, "text"), BUCKET_BYTES)
    common = docs.sparkSession.sparkContext.broadcast(_common_slots(source, n))  # 4 MB whatever the corpus holds
    packed = source.mapInArrow(_scan(n, buckets, common), _PACKED)
    frequent = packed.groupBy("bucket").applyInArrow(_frequencies(buckets), _PACKED)
    found = cut(frequent.groupBy("bucket").applyInArrow(_sets(threshold), _SETS))
    sets = found.where("kind = 1").select("doc", "size", "probes", "ranks", "grams", "classes")
    probes = sets.mapInArrow(_merge_probes, _PROBES)
    met = (
        probes.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(_candidates(threshold), _PAIR)
        .groupBy("a", "b")
        .agg(F.min(F.struct("df", "gram")).alias("met"))
        .select("a", "b", F.col("met.gram").alias("gram"))
    )
    met = cut(met)
    # N-grams with very many pairs are cut into cells by both ends. One row for each CELL_PAIRS pairs at most is broadcast.
    counts = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    every, most = (x or 0 for x in counts.agg(F.sum("n"), F.max("n")).first())
    large = counts.where(F.col("n") > CELL_PAIRS).select("gram", F.ceil(F.sqrt(F.col("n") / CELL_PAIRS)).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), "parts")
    if most > CELL_PAIRS:
        cell = F.when(F.col("parts").isNull(), F.col("gram")).otherwise(F.xxhash64("gram", part("a"), part("b")))
        met = met.join(F.broadcast(large), "gram", "left").withColumn("cell", cell)
    else:
        met = met.withColumnRenamed("gram", "cell")
    met = met.select("a", "b", "cell")
    wanted = met.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("doc")).distinct()
    sent = wanted.join(sets.select("doc", "size", "grams"), "doc")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(max(2 * buckets, -(-every // CELL_PAIRS))))
    verified = (
        met.withColumn("bucket", place("cell"))
        .groupBy("bucket")
        .cogroup(sent.withColumn("bucket", place("at")).groupBy("bucket"))
        .applyInArrow(_verify(threshold, counted), _COUNTED if counted else _VERIFIED)
    )
    return found.where("kind = 0").select("id", "doc"), verified, found.where("kind = 2").select("id").distinct()


def similar_pairs(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id>_a, <id>_b, jaccard) with a < b: every pair of distinct n-gram sets at or above the threshold.

    Words are split at white space, lowered, and stripped of all but letters, marks and digits. A
    text of 1 to n-1 words has one gram, all of its words. Documents with equal sets are
    represented by their smallest id: each other one is paired with it, at 1.0, and pairs with
    other sets are reported for it alone, so thousands of copies give as many rows, not millions.

    * Null and empty texts, texts without words, and rows with a null id have no pairs.
    * Rows that repeat an id count once for each distinct set; an id is never paired with itself, and
      of several pairs of sets with the same two ids the most similar one is given.
    * An empty table gives an empty result. Columns other than the id and the text are not read.
    * Ids must be integers (else ``ValueError``). N-grams are 48-bit hashes and signatures 64-bit: in
      a corpus of 10^10 distinct documents a handful are expected to share a signature by chance.
    """
    members, links, _ = _similar_sets(docs, threshold, n, id_col, text_col, counted=False)
    first = members.groupBy("doc").agg(F.min("id").alias("first"))
    copies = members.join(first, "doc").where("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("jaccard"))
    named = links.join(first.select(F.col("doc").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("doc").alias("b"), F.col("first").alias("y")), "b")
    pairs = copies.unionByName(named.select("x", "y", "jaccard").where("x <> y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    return pairs.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")).select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"), "jaccard")


def similar_classes(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_copies): every document's class of near copies, one row a document.

    A class is a connected component of the similar n-gram sets of :func:`similar_pairs`, named by its
    smallest id. `n_links` is the number of other sets, each a text that differs, to which the
    document's own is similar; `n_copies` is the number of other documents with an equal set.

    * A document without words (null and empty texts too) is its own class, without links or copies.
    * Rows with a null id have no row. Rows that repeat an id have one for each distinct set.
    * An empty table gives an empty result; ids must be integers. Ties need no rule: all links count.
    """
    members, links, wordless = _similar_sets(docs, threshold, n, id_col, text_col, counted=True)
    links = cut(links)
    ends = links.groupBy("doc").agg(F.sum("links").alias("n_links"))
    sets = (
        members.groupBy("doc").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many"))
        .join(ends, "doc", "left")
        .join(components(links, "doc", "root").withColumnRenamed("node", "doc"), "doc", "left")
    )
    sets = sets.select("doc", "first", "many", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "doc").alias("root"))
    sets = cut(sets)
    names = sets.groupBy("root").agg(F.min("first").alias("class_id"))
    known = members.join(sets.join(names, "root").select("doc", "class_id", "n_links", (F.col("many") - 1).alias("n_copies")), "doc")
    zero = F.lit(0).cast("long")
    rows = known.select("id", "class_id", "n_links", "n_copies").unionByName(wordless.select("id", F.col("id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies")))
    return rows.select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def components(pairs: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b") -> DataFrame:
    """(node, root): connected components of the pairs, by alternating large-star and small-star steps.

    `root` is the smallest id of the component; each node that has a pair occurs once. Pairs with a null
    end or two equal ones count for nothing, repeated ones once; no pairs give an empty result. Every step
    is two aggregates and joins on edges, written to the shared checkpoint folder; the number of
    steps is logarithmic in the longest path.
    """
    edges = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def star(pointing: DataFrame, small: bool) -> DataFrame:
        """pointing: (node, other). Everything around a node points to the smallest there."""
        low = pointing.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("low"))
        joined = pointing.join(low, "node")
        if small:
            moved = joined.select(F.col("other").alias("u"), F.col("low").alias("v")).unionByName(low.select(F.col("node").alias("u"), F.col("low").alias("v")))
        else:
            moved = joined.where("other > node").select(F.col("other").alias("u"), F.col("low").alias("v"))
        return moved.where("u <> v").distinct()

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while (now := mark(edges)) != before:
        before = now
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
        large = star(both, small=False)
        edges = cut(star(large.select(F.col("u").alias("node"), F.col("v").alias("other")), small=True))
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those in whose class of :func:`similar_classes` a smaller id exists; all columns stay.

    Rows with a null id, and texts without words, stay. Rows that repeat an id go or stay together:
    they go where one of their sets has a class with a smaller id. An empty table stays empty.
    """
    name = free_name("gone", docs)
    classes = similar_classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), threshold, n, "id", "text")
    gone = classes.where("id <> class_id").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\s+'),
             lambda x: regexp_replace(x, '[^\p{L}\p{M}\p{N}]+', '', 'g')), lambda x: x <> '') AS w
           FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
             ELSE [array_to_string(w, ' ')] END)) AS g FROM w WHERE len(w) > 0),
k AS (SELECT g, min(doc_id) AS d, len(g) AS n, count(*) - 1 AS copies FROM s GROUP BY g),
e AS (SELECT d, n, unnest(g) AS g FROM k),
o AS (SELECT x.d AS a, y.d AS b, x.n AS na, y.n AS nb, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.d <> y.d GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE c / (na + nb - c) >= 0.5 - 1e-12),
r(d, x) AS (SELECT d, d FROM k UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.x),
c AS (SELECT d, min(x) AS class_id FROM r GROUP BY d),
m AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT s.doc_id, c.class_id, coalesce(m.links, 0) AS n_links, k.copies AS n_copies FROM s JOIN k ON s.g = k.g JOIN c ON c.d = k.d LEFT JOIN m ON m.a = k.d
UNION ALL SELECT doc_id, doc_id, 0, 0 FROM w WHERE len(w) = 0"""
