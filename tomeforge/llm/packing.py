"""Sequence packing: first-fit decreasing inside randomised groups of documents.

A document is the ids of its text, by the vocabulary of the token store, plus one end mark. One
longer than the capacity is cut into pieces of the capacity and a rest; all of its tokens are packed. Pieces
are dealt to groups by a seeded hash of their row, its number among equal rows and their own, and each group packs on its own: pieces from the longest
to the shortest, each into the first bin with room. A tournament tree over the room
left in each bin finds that bin in logarithmic time: a node holds the larger room of its two
children, and the search goes left whenever the left child has room.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import blocks, mix64, refuse_names
from tomeforge.llm.token_store import VOCABULARY, Encoder, vocabulary_lines


class RoomTree:
    """Room left in each of `bins` bins, as a tournament of the larger room."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1)).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put `size` into the first bin with room for it; the bin's number."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
        return leaf


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size, in the order given; all sizes are between 1 and the capacity."""
    tree = RoomTree(max(1, len(sizes)), capacity)
    return [tree.place(s) for s in sizes]


_PLACES = ("piece", "start", "n_tokens", "group_id", "bin_id", "slot", "tokens")


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    group_docs: int = 4096,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(id, piece, start, n_tokens, group_id, bin_id, slot, tokens): where each piece of each document goes.

    `tokens` are the piece's ids of the vocabulary, 16 bits each, lowest byte first; a sequence is
    what stands in a bin, by `slot`. `start` is the piece's first token within its document, and the
    last piece's last one is the end mark, the first id that the vocabulary leaves free. `bin_id` is
    unique over all groups.

    * A null or empty text is the end mark alone, so it still has a place. A null id is kept as null,
      and no other id changes for it.
    * Repeated rows are packed as often as they occur, and dealt apart. Ties in length go by id (null
      ids first), then piece, then a hash of the row. An empty table gives an empty result. Other
      columns are not read; an id column with the name of another one of the result is refused.
    * Ids and tokens are shuffled once. A group has pieces of `group_docs` documents on average.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    refuse_names(id_col, *_PLACES)
    kind, lines = dict(docs.dtypes)[id_col], vocabulary_lines(vocabulary)
    groups = max(1, math.ceil(docs.count() / group_docs))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("row"))
    columns = ["id", "row", "piece", "group_id", "n_tokens", "tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines)
        end = encoder.end.to_bytes(2, "little")
        seen: dict[int, int] = {}
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20, 4096):
                at, piece, tokens, again = [], [], [], []
                for i, (text, row) in enumerate(zip(block.column("text"), block.column("row").to_pylist())):
                    ids = encoder(text.as_py() or "") + end
                    seen[row] = many = seen.get(row, -1) + 1
                    for k in range(0, len(ids), 2 * capacity):
                        at.append(i), piece.append(k // (2 * capacity)), tokens.append(ids[k : k + 2 * capacity]), again.append(many)
                own, piece = block.take(pa.array(at, pa.int64())), np.array(piece, np.int64)
                row = own.column("row").to_numpy().view(np.uint64)
                draw = mix64(mix64(row ^ mix64(piece.astype(np.uint64) + np.uint64(1))) + np.array(again, np.uint64))
                size = np.array([len(t) // 2 for t in tokens], np.int32)
                group = (draw % np.uint64(groups)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("row"), pa.array(piece), pa.array(group), pa.array(size), pa.array(tokens, pa.binary())], names=columns)

    def fill(table: pa.Table) -> pa.Table:
        order = [("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending"), ("row", "ascending")]
        table = table.take(pc.sort_indices(table, order, null_placement="at_start"))
        bins = np.array(first_fit(table.column("n_tokens").to_pylist(), capacity), np.int64)
        by = np.argsort(bins, kind="stable")
        head = np.append(True, bins[by[1:]] != bins[by[:-1]])
        slot = np.empty(len(bins), np.int32)
        slot[by] = np.arange(len(by)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        group = table.column("group_id").to_numpy()
        new = [pa.array(table.column("piece").to_numpy() * capacity), table.column("n_tokens"), table.column("group_id"), pa.array((group << 32) + bins), pa.array(slot), table.column("tokens")]
        return pa.Table.from_arrays([table.column("id"), table.column("piece"), *new], names=["id", *_PLACES])

    pieces = source.mapInArrow(cut, f"id {kind}, row long, piece long, group_id long, n_tokens int, tokens binary")
    schema = f"id {kind}, piece long, start long, n_tokens int, group_id long, bin_id long, slot int, tokens binary"
    return pieces.groupBy("group_id").applyInArrow(fill, schema).withColumnRenamed("id", id_col)
