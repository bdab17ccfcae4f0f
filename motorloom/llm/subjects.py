"""Subject areas of documents.

Method: complement naive Bayes over hashed word stems, trained on labelled texts,
refined by expectation-maximisation over all unlabelled documents. The unit is the
sentence: a document has a subject if at least a quarter of its sentences are about it.
During EM a sentence's subject is drawn from its own words and from its document's mix of
subjects, so wordings that no labelled text has are learned from the company they keep.

One class more, ``NONE``, takes sentences without subject; its labelled texts are
held-out test items. A sentence counts for a subject only if its own words favour
it over every other class by the calibrated margin, so sentences at home in every
document (small talk) count for none. The margin is one for all subjects; posteriors
calibrated subject by subject on held-out rows were tried and gave worse rows (README).

Labelled rows are a bounded sample (``most_labelled`` by hash of the text); the documents
are read whole and all: once to turn words into feature numbers, then once per EM step and
once to decide. What reaches the driver is a table of ``FEATURES`` x classes, whatever the
corpus; the tables of the tasks are added as a stream, in ``CHUNKS`` ranges of features.

Defined results: null and empty texts and texts without a word have no subject;
repeated documents get the same subjects each; without documents the result is
empty; without labelled rows no subject is given; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorloom.plans.runtime import stash

NONE = ""
FEATURES = 1 << 15
STEM = 6
SHARE = 0.25
SMOOTH = 0.1
CHUNKS = 8
_SLICE = 400_000

_TAGS = re.compile(r"<[^<>]{1,200}>|&[a-z#0-9]{2,8};|[*_`#]{1,3}(?=\S)|\[/?\w+[^\]]*\]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"»)]+|[\n\r]+|\s[|•]\s")
_WORD = re.compile(r"[^\W\d_]{2,}")


class _Features(dict):
    def __missing__(self, stem: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[stem] = xxhash.xxh32_intdigest(stem) % FEATURES
        return value


_FEATURES = _Features()


def sentences(text: str | None) -> list[str]:
    if not text:
        return []
    parts = _SENTENCE.split(_TAGS.sub(" ", text))
    return [p for p in parts if p and any(c.isalnum() for c in p)]


def featurise(text: str | None) -> list[list[int]]:
    """Feature numbers of each sentence; neighbouring stems also count as a pair."""
    out = []
    for s in sentences(text):
        stems = [w[:STEM] for w in _WORD.findall(s.lower().replace("ё", "е"))]
        out.append([_FEATURES[w] for w in stems] + [_FEATURES[a + " " + b] for a, b in zip(stems, stems[1:])])
    return out


def _numbers(docs: DataFrame) -> DataFrame:
    """doc_id, feature numbers of all sentences in a row, and how many each sentence has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [featurise(t) for t in batch.column("text").to_pylist()]
            flat = [np.array([f for s in r for f in s], np.int16).tobytes() for r in rows]
            size = [np.array([len(s) for s in r], np.int32).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(flat, pa.binary()), pa.array(size, pa.binary())],
                names=["doc_id", "features", "sizes"],
            )

    return docs.mapInArrow(work, "doc_id bigint, features binary, sizes binary")


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """Complement naive Bayes: per feature and class, minus the log share of the feature outside the class.

    Classes weigh the same however much text each has.
    """
    scaled = counts / np.maximum(counts.sum(0, keepdims=True), 1.0) * counts.sum() / counts.shape[1]
    outside = scaled.sum(1, keepdims=True) - scaled + SMOOTH
    return -np.log(outside / outside.sum(0, keepdims=True)).astype(np.float32)


def sentence_scores(features: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed weights of each sentence; zeros for a sentence without words."""
    out = np.zeros((len(sizes), weights.shape[1]), np.float64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _SLICE, "right")) - 1)
        part = weights[features[ends[start] : ends[stop]]]
        filled = np.flatnonzero(sizes[start:stop] > 0)
        if len(filled):
            out[start + filled] = np.add.reduceat(part, ends[start + filled] - ends[start], axis=0)
        start = stop
    return out


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, sentence sizes and the number of sentences per document of one batch."""
    size = [np.frombuffer(x, np.int32) for x in batch.column("sizes").to_pylist()]
    flat = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.int16).astype(np.int64)
    return flat, np.concatenate(size) if size else np.empty(0, np.int32), np.array([len(s) for s in size], np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def posteriors(scores: np.ndarray, sizes: np.ndarray, owner: np.ndarray, docs: int, sharpness: float) -> np.ndarray:
    """Class shares of each sentence, given the mean evidence of its words and its document's mix."""
    mean = scores / np.maximum(sizes, 1)[:, None] * sharpness
    first = _softmax(mean)
    mix = np.zeros((docs, scores.shape[1]))
    np.add.at(mix, owner, first)
    mix = mix / np.maximum(mix.sum(1, keepdims=True), 1e-9) + 0.02
    return _softmax(mean + np.log(mix[owner]) * 1.5)


def expected_counts(numbers: DataFrame, weights: np.ndarray, sharpness: float = 2.0) -> np.ndarray:
    """One E-step over all documents: expected feature counts by class."""
    held = numbers.sparkSession.sparkContext.broadcast(weights)
    classes = weights.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = held.value, np.zeros((classes, FEATURES))
        for batch in batches:
            flat, sizes, per = _unpack(batch)
            if not len(sizes):
                continue
            owner = np.repeat(np.arange(len(per)), per)
            share = posteriors(sentence_scores(flat, sizes, w), sizes, owner, len(per), sharpness)
            of = np.repeat(np.arange(len(sizes)), sizes)
            for c in range(classes):
                total[c] += np.bincount(flat, weights=share[of, c], minlength=FEATURES)
        at = [(c, k) for c in range(classes) for k in range(CHUNKS)]
        tables = total.reshape(classes, CHUNKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in at], pa.int32()), pa.array([k for _, k in at], pa.int32()), pa.array([tables[i].tobytes() for i in at], pa.binary())],
            names=["c", "k", "part"],
        )

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros(FEATURES // CHUNKS)
        for batch in parts:  # streamed: one table at a time
            for part in batch.column("part"):
                summed += np.frombuffer(part.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([summed.tobytes()], pa.binary())], names=["c", "k", "part"]
        )

    out = np.zeros((classes, CHUNKS, FEATURES // CHUNKS))
    schema = "c int, k int, part binary"
    for r in numbers.select("features", "sizes").mapInArrow(work, schema).groupBy("c", "k").applyInArrow(add, schema).collect():
        out[r.c, r.k] = np.frombuffer(r.part, np.float64)
    return out.reshape(classes, FEATURES).T


def labelled_counts(examples: list[tuple[str, str]], classes: list[str]) -> np.ndarray:
    out = np.zeros((FEATURES, len(classes)))
    for text, subject in examples:
        if subject in classes:
            for s in featurise(text):
                np.add.at(out[:, classes.index(subject)], s, 1.0)
    return out


def calibrate(examples: list[tuple[str, str]], classes: list[str], weights: np.ndarray, keep: float = 0.99) -> float:
    """The mean margin per word that nearly all labelled sentences of a subject reach, within fixed bounds."""
    margins = []
    for text, subject in examples:
        if subject not in classes or subject == NONE:
            continue
        k = classes.index(subject)
        rows = [s for s in featurise(text) if s]
        if rows:
            scores = sentence_scores(np.array([f for s in rows for f in s]), np.array([len(s) for s in rows]), weights)
            margins += list((scores[:, k] - np.delete(scores, k, 1).max(1)) / np.array([len(s) for s in rows]))
    return float(np.clip(np.quantile(margins, 1 - keep) * 0.9, 0.15, 0.5)) if margins else 0.5


def assign(
    documents: DataFrame,
    examples: DataFrame,
    subjects: list[str],
    steps: int = 6,
    label_weight: float = 20.0,
    most_labelled: int = 5_000,
) -> DataFrame:
    """(doc_id, subject, share) for every document and subject that at least SHARE of its sentences are about.

    ``documents``: doc_id, text. ``examples``: text, subject (NONE for no subject); of
    each subject's labelled rows at most ``most_labelled`` are used.
    """
    classes = [*subjects, NONE]
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = stash(_numbers(docs), "subject-numbers")
    known = [
        (r.text, r.subject)
        for c in classes
        for r in examples.filter((F.col("subject") == c) & F.col("text").isNotNull())
        .select("text", "subject").orderBy(F.xxhash64("text"), "text").limit(most_labelled).collect()
    ]
    base = labelled_counts(known, classes)
    base = base / np.maximum(base.sum(0, keepdims=True), 1.0) * base.sum() / len(classes)
    weights = complement_weights(base)
    for _ in range(steps if known else 0):
        weights = complement_weights(base * label_weight + expected_counts(numbers, weights))
    return decide(numbers, classes, weights, calibrate(known, classes, weights))


def decide(numbers: DataFrame, classes: list[str], weights: np.ndarray, margin: float) -> DataFrame:
    held = numbers.sparkSession.sparkContext.broadcast((classes, weights, margin))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, least = held.value
        for batch in batches:
            flat, sizes, per = _unpack(batch)
            if not len(sizes):
                continue
            owner = np.repeat(np.arange(len(per)), per)
            scores = sentence_scores(flat, sizes, w)
            order = np.sort(scores, 1)
            best = scores.argmax(1)
            sure = (order[:, -1] - order[:, -2]) / np.maximum(sizes, 1) >= least
            sure &= best < len(names) - 1
            hits = np.zeros((len(per), len(names)))
            np.add.at(hits, (owner[sure], best[sure]), 1.0)
            share = hits / np.maximum(per, 1)[:, None]
            d, c = np.nonzero(share >= SHARE - 1e-9)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[d], pa.int64()), pa.array([names[k] for k in c], pa.string()), pa.array(np.round(share[d, c], 6))],
                names=["doc_id", "subject", "share"],
            )

    return numbers.mapInArrow(work, "doc_id bigint, subject string, share double")
