"""Operator 1: quality classifier.

Hashed word n-gram logistic regression, trained with follow-the-regularised-leader
updates and scored as a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import fit_on_executor, held_out, labelled_sample, table
from .ftrl import fit, sigmoid, slots

BITS = 18

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each word between white space: the hash of its lower case, and of its shape.

    A shape is the run-collapsed pattern of cases, digits and signs: ``Thing!!`` gives ``Aa!``.
    """
    b = np.frombuffer(data, np.uint8)
    starts, ends = bw.spans(data, bw.NOT_SPACE)
    word = bw.hashes(np.frombuffer(data.lower(), np.uint8), starts, ends)
    c = _CLASS[b]
    kept = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
    rank = np.r_[0, np.cumsum(kept)]
    return word, bw.hashes(c[kept], rank[starts], rank[ends])


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Hash slots of every word, word pair, shape, shape pair and shape-with-repeat flag of the whole text; its words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    parts = [word_codes(x) for x in bw.segments(data)]
    h, s = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    k = [np.uint64(x) for x in (1, 3, 5, 7, 11, 0x100000001B3)]
    same = (h[1:] == h[:-1]).astype(np.uint64)
    mixed = [h * k[5] + k[0], (h[:-1] * k[5] + h[1:]) * k[5] + k[1], s * k[5] + k[2], (s[:-1] * k[5] + s[1:]) * k[5] + k[3], (s[1:] * k[5] + same) * k[5] + k[4]]
    return slots(np.concatenate(mixed), BITS), len(h)


def example(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots with their share of the text's words."""
    f, n = features(text)
    f = np.sort(f)
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, int)
    return f[first], np.diff(np.r_[first, len(f)]) / max(1, n)


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 2) -> np.ndarray:
    return fit([example(t) for t in texts], labels, 1 << BITS, epochs, alpha=1.0, l1=0.02, l2=0.02)


def score(text: str | None, weights: np.ndarray) -> float:
    f, n = features(text)
    return float(sigmoid(weights[f].sum() / max(1, n) + weights[-1]))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 24_000_000, max_doc_chars: int = 200_000) -> np.ndarray:
    """Weights fitted on the bounded labelled sample (see ``labelled_sample``)."""
    sample = labelled_sample(docs, labels, ["quality"], max_rows, max_chars, max_doc_chars).select("doc_id", "text", "quality")

    def fit_rows(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        w = train([r[1] for r in rows], np.array([r[2] for r in rows], float))
        some = np.flatnonzero(w)
        return some, w[some]

    weights = np.zeros((1 << BITS) + 1)
    some, values = fit_on_executor(sample, fit_rows)
    weights[some] = values
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text.

    A null or empty text gets the score of the bias; other columns pass through, and a
    column of that name already there is replaced. No shuffle: one Arrow batch pass.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = model.value
        for texts in batches:
            yield pa.array([score(t, w) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(column, scored(F.col("text")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, weights, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score").withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
