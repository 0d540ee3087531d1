"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to lower-case words and cut into windows of
`window` words; all windows of all items form one automaton. A document is normalised in bulk and
scanned once. Hits name word positions, which are the same in the original text, so only documents
with hits are tokenised again for character offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tomeforge.llm.common import WORD_CHARS, as_text, blocks, refuse_names

WORD = regex.compile(f"[{WORD_CHARS}]+")


def plain_words(text: str | None) -> list[str]:
    return WORD.findall(pc.utf8_lower(pa.scalar(text or "")).as_py())


def windows(text: str | None, window: int, min_words: int) -> set[tuple[str, ...]]:
    """Word windows that give away an item: of the whole text, and of its lines that are shorter than a window."""
    out = set()
    for n, part in enumerate([text or "", *(text or "").split("\n")]):
        found = plain_words(part)
        if len(found) >= window and n == 0:
            out.update(tuple(found[i : i + window]) for i in range(len(found) - window + 1))
        elif min_words <= len(found) < window:
            out.add(tuple(found))
    return out


def _automaton(patterns: dict[str, list]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        machine.add_word(pattern, (pattern.count(" ") - 1, len(pattern), items))
    machine.make_automaton()
    return machine


def _merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges [first, behind) that overlap or touch become one."""
    out: list[list[int]] = []
    for first, behind in sorted(hits):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], behind)
        else:
            out.append([first, behind])
    return [(a, b) for a, b in out]


def find(text: pa.StringScalar, normal: str, machine: ahocorasick.Automaton) -> list[tuple[object, int, int, int]]:
    """(item, start, end, words) of the passages; `normal` is the normalised text with a blank at either end."""
    hits: dict[object, list[tuple[int, int]]] = {}
    seen = words = 0
    for last, (many, size, items) in machine.iter(normal):
        begin = last - size + 1
        if begin < seen:  # a longer pattern that began earlier ends later
            words, seen = 0, 0
        words += normal.count(" ", seen, begin)
        seen = begin
        for item in items:
            hits.setdefault(item, []).append((words, words + many))
    if not hits:
        return []
    spans = [m.span() for m in WORD.finditer(text.as_py())]
    return [(item, spans[a][0], spans[b - 1][1], b - a) for item, found in hits.items() for a, b in _merge(found)]


def _patterns(benchmark: DataFrame, window: int, min_words: int, item_col: str, text_cols: tuple[str, ...], max_pattern_chars: int) -> dict[str, list]:
    patterns: dict[str, set] = {}
    total = 0
    for row in benchmark.select(F.col(item_col).alias("i"), *(F.col(c).alias(f"t{k}") for k, c in enumerate(text_cols))).toLocalIterator():
        for k in range(len(text_cols)):
            for words in windows(row[f"t{k}"], window, min_words):
                pattern = f" {' '.join(words)} "
                if pattern not in patterns and (total := total + len(pattern)) > max_pattern_chars:
                    raise ValueError(f"the benchmark's windows take more than max_pattern_chars, {max_pattern_chars}; screen it in parts")
                patterns.setdefault(pattern, set()).add(row["i"])
    return {p: sorted(items, key=lambda i: (i is None, i)) for p, items in patterns.items()}


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, min_words: int, text_col: str, item_col: str, item_text_cols: tuple[str, ...], max_pattern_chars: int):
    """A function from an Arrow batch to the list of passages of each row."""
    patterns = _patterns(benchmark, window, min_words, item_col, item_text_cols, max_pattern_chars)
    shipped = docs.sparkSession.sparkContext.broadcast(patterns)
    held: list = []

    def scan(batch: pa.RecordBatch) -> Iterator[list]:
        if not held:
            held.append(_automaton(shipped.value))
        machine = held[0]
        if not len(machine):
            yield from ([] for _ in range(batch.num_rows))
            return
        for block in blocks(batch, text_col):
            texts = as_text(block.column(text_col))
            normal = pc.replace_substring_regex(pc.utf8_lower(texts), f"[^{WORD_CHARS}]+", " ")
            for text, plain in zip(texts, normal.to_pylist()):
                yield find(text, f" {plain.strip(' ')} ", machine)

    return scan


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    min_words: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_cols: tuple[str, ...] = ("text",),
    max_pattern_chars: int = 1 << 24,
) -> DataFrame:
    """(id, item, start_char, end_char, n_words): every passage of a benchmark item in a document.

    A passage is a maximal run of overlapping or touching windows of one item; offsets count
    characters of the original text. Items, and lines of items, of `min_words` to `window` - 1 words
    are one window of their own length; shorter ones can't be told from ordinary phrases and are
    left out: :func:`unsearched` names the items to which that happens, and a smaller `min_words`
    lets them in. The automaton is sent to every executor, so its size is checked while the
    benchmark is read: one whose windows have more than `max_pattern_chars` characters (each is one
    node at most) raises ``ValueError`` and has to be screened in parts.

    * Null and empty texts and items match nothing. A null id or item id is reported as null.
    * Repeated rows are reported as often as they occur. Items with equal windows are all reported.
    * Empty tables give an empty result. Other columns are not read.
    """
    refuse_names(id_col, item_col, "start_char", "end_char", "n_words")
    refuse_names(item_col, "start_char", "end_char", "n_words")
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    scan = _scan(docs, benchmark, window, min_words, "text", item_col, item_text_cols, max_pattern_chars)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *hit) for i, hits in enumerate(scan(batch)) for hit in hits]
            at, item, start, end, many = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(many, pa.int64())],
                names=["id", "item", "start_char", "end_char", "n_words"],
            )

    out = source.mapInArrow(run, f"id {kind}, item {item_kind}, start_char long, end_char long, n_words long")
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def unsearched(benchmark: DataFrame, window: int = 13, min_words: int = 8, item_col: str = "item_id", item_text_cols: tuple[str, ...] = ("text",)) -> DataFrame:
    """(item, n_words) of the items without any window, as all their texts and lines are too short.

    Null and empty items have 0 words; null and repeated items are reported as often as they occur.
    """
    texts = [F.coalesce(F.col(c), F.lit("")) for c in item_text_cols]
    words = lambda text: F.regexp_count(text, F.lit(f"[{WORD_CHARS}]+"))
    longest = F.greatest(F.lit(0), *(words(t) for t in texts))
    # a text is whole or in lines: none of its lines is longer than itself
    return benchmark.select(F.col(item_col), longest.alias("n_words")).where(F.col("n_words") < min(min_words, window))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_words: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_cols: tuple[str, ...] = ("text",), max_pattern_chars: int = 1 << 24) -> DataFrame:
    """The documents without a passage of the benchmark; all columns stay, nothing is shuffled.

    Windows are those of :func:`contaminated`. Null and empty texts, and rows with a null id, hold no
    passage and stay; repeated rows go or stay together; empty tables are no special case.
    """
    scan = _scan(docs, benchmark, window, min_words, text_col, item_col, item_text_cols, max_pattern_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.fromiter((not hits for hits in scan(batch)), bool, batch.num_rows)))

    return docs.mapInArrow(run, docs.schema)
