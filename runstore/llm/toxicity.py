"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels.  A sentence's probability is logistic in its distinct
words, a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``, and the likelihood of the documents' labels
is what is maximised, with a leak for labels that no sentence explains.  The trained sentence scores then locate the sentences that offend.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Words are hashed to so many weights.
SPACE = 1 << 18
_TRIM = ".,;:!?\"'()[]{}#*$%&|<>-_"
#: Words whose weights a worker remembers before it forgets all.
REMEMBERED = 500_000


class _Words(dict):
    """Remembers the bucket of every word."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        w = word.strip(_TRIM)
        self[word] = k = zlib.crc32(w.encode("utf-8", "surrogatepass")) % SPACE if w else -1
        return k


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end (code points, exclusive) of each sentence of the text that isn't blank."""
    import regex

    return [m.span() for m in regex.finditer(r"[^.!?\n]+[.!?]*", text) if not m[0].isspace()]


def bag(text: str, bucket: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of all sentences one after another, distinct in each, and the number of them in each."""
    import regex

    words, sizes = [], []
    for line in regex.findall(r"[^.!?\n]+", text.lower()):
        own = set(map(bucket.__getitem__, line.split()))
        own.discard(-1)
        if own:
            words += own
            sizes.append(len(own))
    return np.array(words, np.int32), np.array(sizes, np.int32)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float  # logit of a toxic label without an offending sentence

    def sentence_logits(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[words], np.cumsum(sizes) - sizes) + self.bias if len(sizes) else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        bucket = shared.worker_cache().setdefault("words", _Words())
        out = np.full(len(texts), _softplus(np.float64(self.leak)))  # -log(1 - p) of a logit z is softplus(z)
        for i, t in enumerate(texts):
            words, sizes = bag(t or "", bucket)
            out[i] += _softplus(self.sentence_logits(words, sizes)).sum()
        return -np.expm1(-out)


def telling(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, base: float) -> np.ndarray:
    """Buckets whose documents are toxic more often than chance explains.

    By Chernoff's bound a bucket of n documents reaches its share k/n by chance with a probability under
    exp(-n KL(k/n, base)); those are kept for which one such bucket or less is expected among all.
    """
    n, k = np.zeros(SPACE), np.zeros(SPACE)
    for (words, _), t in zip(bags, toxic):
        own = np.unique(words)
        n[own] += 1
        k[own] += t
    share = k / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    return np.flatnonzero((n >= 3) & (share > base) & (n * kl > np.log(max((n >= 3).sum(), 2))))


def solve(bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 300, ridge: float = 3e-5, rate: float = 0.1) -> Model:
    """Maximise the likelihood of a leaky noisy-or by Adam over all bags at once.

    The leak is the probability of a toxic label without an offending sentence, so wrong labels don't become weights.
    Only telling words have weights.
    """
    base = float(label.mean()) if len(label) else 0.0
    if not 0 < base < 1:
        return Model(np.zeros(SPACE, np.float32), -30.0, 30.0 if base else -30.0)
    y = label.astype(np.float64)
    vocab = telling(bags, y, base)
    local = np.full(SPACE, -1, np.int32)
    local[vocab] = np.arange(len(vocab))
    per_doc = np.array([len(s) for _, s in bags])
    doc = np.repeat(np.arange(len(bags)), per_doc)
    w_at, s_at, first = [], [], 0
    for words, sizes in bags:  # bag by bag, as all words together may be many
        here = local[words]
        w_at.append(here[here >= 0])
        s_at.append(np.repeat(np.arange(first, first + len(sizes)), sizes)[here >= 0])
        first += len(sizes)
    w_at, s_at, n_s, n_w = np.concatenate(w_at), np.concatenate(s_at), first, len(vocab)
    theta = np.zeros(n_w + 2)  # words, bias of a sentence, leak
    theta[n_w:] = -6.0, np.log(base / (1 - base))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(s_at, theta[w_at], n_s) + theta[n_w]
        a = np.bincount(doc, _softplus(z), len(y)) + _softplus(theta[n_w + 1])  # -log(1 - P)
        # d loss / d a of -y log(1 - exp(-a)) + (1 - y) a
        da = ((1 - y) - y * np.exp(-a) / np.maximum(-np.expm1(-a), 1e-9)) / len(y)
        dz = da[doc] / (1 + np.exp(-z))
        g = np.concatenate([np.bincount(w_at, dz[s_at], n_w) + ridge * theta[:n_w], [dz.sum(), da.sum() / (1 + np.exp(-theta[n_w + 1]))]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(SPACE, np.float32)
    weights[vocab] = theta[:n_w]
    return Model(weights, float(theta[n_w]), float(theta[n_w + 1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = 12_000, **options) -> Model:
    """Learn from at most ``sample`` labelled documents that aren't held out, those with the smallest hashes of doc_id.

    Of each whole text the word buckets of its sentences reach the driver, no text. Without labels every score is 0.
    """
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("_toxic")).where("_toxic IN (0, 1)").where(~shared.held_out())
    h = F.xxhash64("doc_id")
    top = shared.sample_limit(marks, h, sample)
    if top is not None:
        marks = marks.where(h <= top)
    marks = marks.groupBy("doc_id").agg(F.max("_toxic").alias("_toxic")).orderBy(h, "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: the one bounded side here.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), "doc_id")
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = shared.worker_cache().setdefault("words", _Words())
        for b in batches:
            bags = [bag(t or "", bucket) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([w.tobytes() for w, _ in bags], pa.binary()), pa.array([s.tobytes() for _, s in bags], pa.binary())], ["doc_id", "toxic", "words", "sizes"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "doc_id long, toxic int, words binary, sizes binary").orderBy("doc_id").limit(sample).collect())
    return solve([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)) for r in got], np.array([r[1] for r in got], np.int64), **options)


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted; a row per row of ``docs``, repeated ones too.

    Null texts count as empty; a text without words gets the leak. An empty table gives no rows.
    """
    sent = shared.shipped(docs.sparkSession, fit(docs, labels, doc_id, text, **options))
    shared.small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(sent().score(texts.tolist()))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("score", score("text"))
    return rows.select("doc_id", shared.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def located(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The sentences whose own probability is at least ``least``: doc_id, start, stop (code points), score, sentence."""
    sent = shared.shipped(docs.sparkSession, model)
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = shared.worker_cache().setdefault("words", _Words())
        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for start, stop in sentences(t or ""):
                    words, sizes = bag(t[start:stop], bucket)
                    if len(sizes):
                        p = float(1 / (1 + np.exp(-sent().sentence_logits(words, sizes).max())))
                        if p >= least:
                            out.append((doc, start, stop, p, t[start:stop]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "start", "stop", "score", "sentence"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, start long, stop long, score double, sentence string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
