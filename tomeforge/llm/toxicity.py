"""Toxicity by multiple-instance learning.

Labels belong to documents; the offending sentences are unknown. Each sentence gets a probability
from a logistic model of its distinct words, a word being told by itself and by its beginnings, and
a document's probability is the noisy-or of its sentences: 1 - prod(1 - p). Training maximises the
likelihood of the document labels through that formula, which leaves blame with the few sentences
that explain a label: a word that clean documents hold now and then can count against a document
that repeats it in several sentences, and not against one that has it once. The trained model then
scores documents and points at sentences. As every sentence adds a little, what clean sentences add
up to is taken off beyond the usual length; length alone makes nothing toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import WORD_CHARS, as_text, blocks, cut, hash_strings, refuse_names, words

_END = re.compile(r"[.!?…。！？]+(?=\s|$)|\n")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences: up to a final mark that white space follows, or a line's end."""
    out, start = [], 0
    for match in _END.finditer(text):
        if match.end() > start:
            out.append((start, match.end()))
        start = match.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


#: Beginnings of a word, in characters, that are features besides the word itself.
BEGINNINGS = (4, 5, 6, 7)
#: Standard deviations that count besides the mean in what clean sentences add up to in long documents.
MARGIN = 2.0


def _sentences(texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray, pa.Array]:
    """(text of each sentence, its span, sentence of each word, the word's index, normalised words)."""
    doc, spans, parts = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        own = sentence_spans(text)
        doc += [i] * len(own)
        spans += own
        parts += [text[a:b] for a, b in own]
    offsets, raw, index = words(pc.utf8_lower(pa.array(parts, pa.large_string())))
    coded = pc.replace_substring_regex(raw, f"[^{WORD_CHARS}]+", "").dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)[index] if len(raw) else np.zeros(0, np.int64)
    where = np.repeat(np.arange(len(parts)), np.diff(offsets))
    kept = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[index] if len(raw) else np.zeros(0, bool)
    return np.array(doc, np.int64), spans, where[kept], index[kept].astype(np.int64), coded.dictionary


def features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash of a feature) of each distinct word: itself, and each beginning shorter than it."""
    size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    owners, hashes = [np.arange(len(distinct))], [hash_strings(distinct)]
    for k in BEGINNINGS:
        longer = np.flatnonzero(size > k)
        starts = pc.utf8_slice_codeunits(distinct.take(pa.array(longer)), 0, k).dictionary_encode()
        owners.append(longer)
        hashes.append(hash_strings(starts.dictionary, seed=k)[starts.indices.to_numpy(zero_copy_only=False)] if len(longer) else np.zeros(0, np.uint64))
    return np.concatenate(owners), np.concatenate(hashes)


@dataclass(frozen=True)
class Model:
    """Sorted hashes of features with their weights, and the bias of every sentence.

    `mean` is what a sentence of a clean document adds to -log(1 - p) of the document, and `spread`
    the variance of that, by sentence, between clean documents; `usual` is how many they have on average.
    """

    features: np.ndarray
    weights: np.ndarray
    bias: float
    mean: float = 0.0
    spread: float = 0.0
    usual: float = 0.0

    def logits(self, where: np.ndarray, index: np.ndarray, distinct: pa.Array, sentences: int) -> np.ndarray:
        """A sentence's words count once each, as in training."""
        z = np.full(sentences, self.bias)
        if len(distinct) and len(self.features):
            owner, code = features(distinct)
            at = np.minimum(np.searchsorted(self.features, code), len(self.features) - 1)
            score = np.bincount(owner, weights=np.where(self.features[at] == code, self.weights[at], 0.0), minlength=len(distinct))
            heavy = np.flatnonzero(score[index])
            pair = np.unique(where[heavy] * len(distinct) + index[heavy])
            z += np.bincount(pair // len(distinct), weights=score[pair % len(distinct)], minlength=sentences)
        return z


def noisy_or(z: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) by document; no sentences give 0."""
    return -np.expm1(-np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=docs))


def scores(model: Model, z: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The noisy-or without what a length above the usual adds, or the likeliest sentence where that is more.

    Training has balanced what sentences add up to at usual lengths, so nothing is taken off there.
    """
    many = np.maximum(np.bincount(doc, minlength=docs), model.usual)
    length = (many - model.usual) * model.mean + MARGIN * (np.sqrt(many * model.spread) - np.sqrt(model.usual * model.spread))
    beyond = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=docs) - length
    out = -np.expm1(-np.maximum(beyond, 0.0))
    np.maximum.at(out, doc, 1.0 / (1.0 + np.exp(-z)))
    return out


def _expand(distinct: pa.Array, of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of, hash of a feature) for every feature of every word given."""
    owner, code = features(distinct)
    order = np.argsort(owner, kind="stable")
    code = code[order]
    first = np.searchsorted(owner[order], np.arange(len(distinct) + 1))
    many = first[word + 1] - first[word]
    at = np.repeat(first[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(of, many), code[at]


def _tally(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of a feature, toxic texts that have it, clean ones)."""
    doc, _, where, index, distinct = _sentences(texts)
    seen = np.unique(doc[where] * max(1, len(distinct)) + index)
    of, code = _expand(distinct, seen // max(1, len(distinct)), seen % max(1, len(distinct)))
    names, column = np.unique(code, return_inverse=True)
    held = np.unique(of * max(1, len(names)) + column)
    of, column = held // max(1, len(names)), held % max(1, len(names))
    return names, np.bincount(column[toxic[of]], minlength=len(names)), np.bincount(column[~toxic[of]], minlength=len(names))


def _evidence(texts: pa.Array, kept: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: its number of sentences, and (sentence, kept feature) of what they hold."""
    doc, _, where, index, distinct = _sentences(texts)
    pair = np.unique(where * max(1, len(distinct)) + index)
    of, code = _expand(distinct, pair // max(1, len(distinct)), pair % max(1, len(distinct)))
    at = np.minimum(np.searchsorted(kept, code), len(kept) - 1)
    known = kept[at] == code
    of, at = of[known], at[known]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    bounds = np.searchsorted(of, first)
    return [(int(first[i + 1] - first[i]), of[bounds[i] : bounds[i + 1]] - first[i], at[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]


def _screen(names: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, least_docs: int, least_z: float) -> np.ndarray:
    """Sorted hashes of the features that enter."""
    p, q, both = bad / n_bad, good / n_good, (bad + good) / (n_bad + n_good)
    z = (p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_bad + 1 / n_good))
    return np.sort(names[(bad >= least_docs) & (z >= least_z)])


def _maximise(y: np.ndarray, held: list[tuple[int, np.ndarray, np.ndarray]], kept: np.ndarray, penalty: float, rounds: int, rate: float) -> Model:
    """The model of the texts' evidence; sentences without any are alike and only counted."""
    size = np.array([n for n, _, _ in held], np.int64)
    doc, wheres, sentences = [], [], 0
    for i, (_, own, _) in enumerate(held):
        found, at = np.unique(own, return_inverse=True)
        doc.append(np.full(len(found), i))
        wheres.append(at + sentences)
        sentences += len(found)
    doc, where, column_of = np.concatenate(doc), np.concatenate(wheres), np.concatenate([c for _, _, c in held])
    plain = size - np.bincount(doc, minlength=len(y))
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    theta = np.zeros(len(kept) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def totals() -> tuple[np.ndarray, np.ndarray]:
        z = theta[-1] + np.bincount(where, weights=theta[column_of], minlength=len(doc))
        return z, np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=len(y)) + plain * np.logaddexp(0.0, theta[-1])

    for t in range(1, rounds + 1):
        z, total = totals()
        slope = share * np.where(y, -1.0 / np.expm1(np.clip(total, 1e-9, 500.0)), 1.0)
        by_sentence = slope[doc] / (1.0 + np.exp(-z))
        by_plain = (slope * plain).sum() / (1.0 + np.exp(-theta[-1]))
        gradient = np.append(np.bincount(column_of, weights=by_sentence[where], minlength=len(kept)), by_sentence.sum() + by_plain)
        gradient[:-1] += penalty * theta[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    clean, many = totals()[1][~y], size[~y]
    mean = clean.sum() / max(1, many.sum())
    spread = ((clean - many * mean) ** 2).sum() / max(1, many.sum())
    return Model(kept, theta[:-1].copy(), float(theta[-1]), float(mean), float(spread), float(many.mean()))


def _nothing() -> Model:
    return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)


def fit(texts: list[str], toxic: np.ndarray, least_docs: int = 6, least_z: float = 5.0, penalty: float = 2e-5, rounds: int = 300, rate: float = 0.1) -> Model:
    """Maximise the penalised likelihood of document labels by full-batch Adam; deterministic.

    Features enter that occur in `least_docs` toxic texts or more, and there more often than in
    clean ones by `least_z` standard errors: others would only learn single documents by heart.
    Equal texts count once, as toxic if one of them is.
    With one class or no texts at all the model calls nothing toxic.
    """
    once: dict[str, bool] = {}
    for text, bad in zip(texts, toxic):
        once[text] = once.get(text, False) or bool(bad)
    y = np.array(list(once.values()), bool)
    if not y.any() or y.all():
        return _nothing()
    parts = [(pa.array(list(once)[low : low + 256], pa.large_string()), y[low : low + 256]) for low in range(0, len(y), 256)]
    tallies = [_tally(*part) for part in parts]
    names, at = np.unique(np.concatenate([t[0] for t in tallies]), return_inverse=True)
    bad, good = (np.bincount(at, np.concatenate([t[k] for t in tallies]), len(names)) for k in (1, 2))
    kept = _screen(names, bad, good, y.sum(), (~y).sum(), least_docs, least_z)
    if not len(kept):
        return _nothing()
    return _maximise(y, [e for part, _ in parts for e in _evidence(part, kept)], kept, penalty, rounds, rate)


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 4000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least_docs: int = 6, least_z: float = 5.0, penalty: float = 2e-5, rounds: int = 300, rate: float = 0.1) -> Model:
    """:func:`fit` on at most `max_train_docs` labelled documents, half of each class where there are enough.

    Their texts, however long, stay on the executors: features are tallied there, and what goes to
    the driver is which sentences hold the features that enter, and how many sentences there are.

    The sample is drawn by a seeded hash of the id, so it doesn't depend on partitioning. Null ids
    and labels are left out; an id labelled both ways counts as toxic; ids without a document
    count for nothing, and of several rows with one id each is used.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    draw = F.xxhash64(F.col("_id"), F.lit(seed))
    half = max(1, max_train_docs // 2)
    chosen = known.where("y = 1").orderBy(draw, "_id").limit(half).unionByName(known.where("y = 0").orderBy(draw, "_id").limit(half))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    # at most max_train_docs ids: small whatever the corpus holds
    once = cut(source.join(F.broadcast(chosen), "_id").groupBy("t").agg(F.max("y").alias("y")))
    many = {r["y"] > 0: r["count"] for r in once.groupBy("y").count().collect()}
    if len(many) < 2:
        return _nothing()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for batch in batches:
            for block in blocks(batch, "t", 1 << 20, 256):
                yield as_text(block.column("t")), block.column("y").to_numpy(zero_copy_only=False) > 0

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, y in parts(batches):
            names, bad, good = _tally(texts, y)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(good)], names=["name", "bad", "good"])

    counted = once.mapInArrow(tally, "name long, bad long, good long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= least_docs).collect()
    names, bad, good = (np.array([r[k] for r in counted], np.int64) for k in range(3))
    kept = _screen(names.view(np.uint64), bad, good, many[True], many[False], least_docs, least_z)
    if not len(kept):
        return _nothing()

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, y in parts(batches):
            digest = [xxhash.xxh3_128_digest(t) for t in texts.to_pylist()]
            size, own, of = zip(*_evidence(texts, kept))
            packed = lambda rows: pa.array([r.astype("<i4").tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(y), pa.array(size, pa.int64()), packed(own), packed(of)], names=["digest", "y", "n", "own", "of"])

    rows = sorted(once.mapInArrow(hold, "digest binary, y boolean, n long, own binary, of binary").collect())
    held = [(r["n"], np.frombuffer(r["own"], "<i4").astype(np.int64), np.frombuffer(r["of"], "<i4").astype(np.int64)) for r in rows]
    return _maximise(np.array([r["y"] for r in rows], bool), held, kept, penalty, rounds, rate)


def _scored(batch: pa.RecordBatch, text_col: str, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """For each block of rows: (document scores, text of each sentence, span, sentence probability)."""
    for block in blocks(batch, text_col):
        doc, spans, where, index, distinct = _sentences(as_text(block.column(text_col)))
        z = model.logits(where, index, distinct, len(doc))
        yield scores(model, z, doc, block.num_rows), doc, spans, 1.0 / (1.0 + np.exp(-z))


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5, sentence_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_score, sentence, start_char, end_char, sentence_score) for documents at or above the threshold.

    Rows are the sentences at or above `sentence_threshold`, or where there is none the
    likeliest one (the first of equals). `sentence` counts from 0, offsets count characters.

    * Null and empty texts score 0 and have no rows; a null id is reported as null. Repeated
      rows are reported as often as they occur; an empty table gives an empty result.
    * Other columns are not read; nothing is shuffled. The model has at most as many features as its
      bounded training sample.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, rows = 0, []
            for score, doc, spans, p in _scored(batch, "text", shipped.value):
                first = np.searchsorted(doc, np.arange(len(score) + 1))
                for i in np.flatnonzero(score >= threshold).tolist():
                    own = p[first[i] : first[i + 1]]
                    at = np.flatnonzero(own >= sentence_threshold)
                    for k in at.tolist() if len(at) else [int(own.argmax())]:
                        rows.append((base + i, float(score[i]), k, *spans[first[i] + k], float(own[k])))
                base += len(score)
            at, score, k, start, end, own = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in ((score, pa.float64()), (k, pa.int64()), (start, pa.int64()), (end, pa.int64()), (own, pa.float64())))],
                names=["id", "doc_score", "sentence", "start_char", "end_char", "sentence_score"],
            )

    refuse_names(id_col, "doc_score", "sentence", "start_char", "end_char", "sentence_score")
    out = source.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, doc_score double, sentence long, start_char long, end_char long, sentence_score double")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold; all columns stay, nothing is shuffled.

    A score that equals the threshold goes. Null and empty texts score 0 and stay, and a null id doesn't
    matter. Repeated rows go or stay together; an empty table stays empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s[0] for s in _scored(batch, text_col, shipped.value)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold)) if scores else batch

    return docs.mapInArrow(run, docs.schema)
