"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams of one to four letters that both have (a blended spectrum
of presences, over hashed n-grams), divided by the geometric mean of their own numbers.  Nystrom landmarks stand for
the training texts, and kernel ridge regression of each language against the rest is solved in their span.  Since the
kernel is an inner product of presence vectors, ``kernel(x, landmarks) @ beta`` equals ``presence(x) @ weights`` with
``weights = landmarks.T @ beta``, so a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Hashed n-grams; the presence vector's length.
SPACE = 1 << 15
LONGEST_GRAM = 4
#: A text is read in stretches of so many characters, which overlap so that no n-gram is lost.
STRETCH = 1 << 18
UNKNOWN = "und"


def presence(text: str, out: np.ndarray) -> None:
    """Set ``out`` (uint8, SPACE long) to 1 at the hashes of the n-grams of the whole lower-case text."""
    text = text.lower()
    for s in range(0, len(text), STRETCH):
        code = np.frombuffer(text[max(0, s - LONGEST_GRAM + 1) : s + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = code * np.uint32(0x9E3779B1)
        out[h >> np.uint32(17)] = 1
        for _ in range(LONGEST_GRAM - 1):
            h = h[:-1] * np.uint32(0x85EBCA6B) + code[len(code) - len(h) + 1 :] * np.uint32(0x9E3779B1)
            out[(h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(17)] = 1


def has_letter(text: str | None) -> bool:
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SPACE x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each whole text and a score from 0 to 1; UNKNOWN and 0 for a text without a letter."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.languages:
            return lang, score
        for s in range(0, len(rows), 128):
            part = rows[s : s + 128]
            x = np.zeros((len(part), SPACE), np.uint8)
            for r, i in enumerate(part):
                presence(texts[i], x[r])
            margin = (x.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(x.sum(1, dtype=np.int64), 1))[:, None]
            best = margin.argmax(1)  # the first of equal ones: languages are sorted
            for r, i in enumerate(part):
                lang[i] = self.languages[best[r]]
            score[part] = np.clip((margin[np.arange(len(part)), best] + 1) / 2, 0, 1)
        return lang, score


def solve(bits: np.ndarray, lang: list[str], landmarks: int = 400, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression in the span of evenly taken landmarks; a row of ``bits`` has SPACE / 8 bytes.

    Only the landmarks' vectors and a block of the others are ever unpacked.
    """
    names = sorted(set(lang))
    if not names:
        return Model([], np.zeros((SPACE, 0), np.float32))

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        return x

    y = np.where(np.array(lang)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Languages take turns, so that rare ones have landmarks too.
    turn = np.zeros(len(lang))
    for k in names:
        own = np.flatnonzero(np.array(lang) == k)
        turn[own] = np.arange(len(own))
    mark = np.argsort(turn, kind="stable")[:landmarks]
    marks = unit(bits[mark])
    knm = np.concatenate([unit(bits[s : s + 64]) @ marks.T for s in range(0, len(bits), 64)]).astype(np.float64)
    kmm = knm[mark]
    share = np.array([(np.array(lang) == k).mean() for k in names])
    weight = 1 / (len(names) * share[[names.index(k) for k in lang]])  # rare languages count as much as common ones
    a = (knm * weight[:, None]).T @ knm + ridge * len(bits) * kmm + 1e-8 * np.eye(len(mark))
    beta = np.linalg.solve(a, (knm * weight[:, None]).T @ y)
    # Large coefficients of both signs cancel, so the sums are made in double precision, a stretch of the space at a time.
    weights = np.concatenate([marks[:, s : s + 1024].T.astype(np.float64) @ beta for s in range(0, SPACE, 1024)])
    return Model(names, weights.astype(np.float32))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 2_000, landmarks: int = 400) -> Model:
    """Learn from at most ``sample`` rows that have a language, a letter and a doc_id not held out.

    They are those with the smallest hashes of doc_id; of each whole text a presence vector of SPACE bits reaches the
    driver. No such row: a model without languages, which calls every text UNKNOWN.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(~shared.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64("doc_id", "lang")
    top = shared.sample_limit(rows.select("doc_id", "lang"), h, sample)
    if top is not None:
        rows = rows.where(h <= top)
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, k in zip(*(c.to_pylist() for c in b.columns)):
                if has_letter(t):
                    x = np.zeros(SPACE, np.uint8)
                    presence(t, x)
                    out.append((doc, k, np.packbits(x).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "bits"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "doc_id long, lang string, bits binary").orderBy("doc_id").limit(sample).collect())
    bits = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, SPACE // 8)
    return solve(bits, [r[1] for r in got], landmarks)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_language`` (lang_pred, score, letter: whether the text has one).

    Null and empty texts are UNKNOWN; every row stays; a table that has a column of that name is refused.
    """
    shared.refuse(docs, "_language")
    sent = shared.shipped(docs.sparkSession, model)
    shared.small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, letter boolean")
    def run(texts):
        import pandas as pd

        lang, score = sent().predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score, "letter": [has_letter(t) for t in texts]})

    # Or a filter on the result would be moved below it, with a prediction of its own.
    return docs.withColumn("_language", run.asNondeterministic()(F.col(text)))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a row per row, repeated ones too.

    Null texts and texts without a letter are UNKNOWN with score 0. Languages, sources and ids are no inputs of a
    prediction; ties go to the first language by name. An empty table gives no rows.
    """
    model = fit(docs, doc_id, text, lang, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return predicted(rows, model).select("doc_id", shared.held_out().alias("held_out"), "_language.lang_pred", "_language.score")


def accepted(docs: DataFrame, languages: tuple[str, ...] | None = None, lang: str = "lang", **options) -> DataFrame:
    """The rows whose text has a letter and, if ``languages`` are given, is predicted one of them.

    Where ``lang`` is null it becomes the prediction; all else stays as it is, repeated rows and columns of any name too.
    Low scores reject nothing: about half of the texts that no language claims are good ones. Where no row can be learnt
    from, no language is predicted, null languages stay and the letter alone decides. Null and empty texts go. An empty
    table gives no rows.
    """
    model = fit(docs, lang=lang, **options)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    rows = predicted(packed, model, "_text").where("_language.letter")
    if languages is not None:
        rows = rows.where(F.col("_language.lang_pred").isin(*languages))
    filled = F.coalesce(F.col(f"_row.`{lang}`"), F.when(F.col("_language.lang_pred") != UNKNOWN, F.col("_language.lang_pred")))
    return rows.select(*[(filled if c == lang else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"))
