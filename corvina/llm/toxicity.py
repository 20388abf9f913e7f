"""Operator 10: toxicity, by a classifier chain.

Categories are predicted in order. Each link is a linear model on hashed words and
word beginnings; from the second on it also gets the probabilities of the links before
it. Those are out-of-fold while fitting, so a later link never learns from a
probability that its own label has shaped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import fit_on_executor, held_out, labelled_sample, table
from .ftrl import fit, sigmoid, slots

BITS = 18
#: Bytes of the beginnings of words that count as features.
BEGINNINGS = (4, 5)
#: The chain's order. ``labels`` marks only toxic rows; the two finer links' labels are
#: learned: toxic rows fall into two kinds by which telling words come together.
KINDS = ("kind_a", "kind_b")
LINKS = (*KINDS, "toxic")
#: A telling slot: in at least so many toxic rows, and so many times likelier there.
LEAST_ROWS = 5
TELLING = 8.0
FOLDS = 3
#: Rows outside the toxic class score about 0.05, so the cut lies below one half.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Chain:
    """Weights, a column per link (the last row is the bias), and those for the earlier links' probabilities."""

    words: np.ndarray
    earlier: np.ndarray
    names: tuple[str, ...] = LINKS


def features(text: str | None) -> np.ndarray:
    """Distinct hash slots of the words of the whole text and of their first 4 and 5 bytes."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    found = []
    for part in bw.segments(data):
        b = np.frombuffer(part, np.uint8)
        starts, ends = bw.spans(part, bw.LETTER)
        total = bw.running(b)
        words, first = np.unique(bw.between(total, starts, ends), return_index=True)
        starts, ends = starts[first], ends[first]
        found.append(slots(words, BITS))
        for k in BEGINNINGS:
            found.append(slots(bw.between(total, starts, np.minimum(ends, starts + k)) + np.uint64(k * 0x9E37), BITS))
    return bw.distinct(np.concatenate(found))


def probabilities(f: np.ndarray, chain: Chain) -> list[float]:
    """The links' probabilities in order, each fed those before it."""
    out: list[float] = []
    for z, v in zip((chain.words[f].sum(0) + chain.words[-1]).tolist(), chain.earlier, strict=True):
        out.append(float(sigmoid(z + sum(a * p for a, p in zip(v, out, strict=False)))))
    return out


def train_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS, epochs: int = 2) -> Chain:
    """``rows`` of feature slots; ``labels`` has a column per link. A link without a positive row predicts none."""
    size, k = 1 << BITS, labels.shape[1]
    fold = np.random.default_rng(3).permutation(len(rows)) % folds
    opts = {"alpha": 0.3, "l1": 3.0, "l2": 0.1}
    words, earlier, out_of_fold = np.zeros((size + 1, k)), np.zeros((k, k)), np.zeros((len(rows), 0))

    class WithEarlier:
        """Examples made as they are asked for: a text's slots and, after them, its earlier probabilities."""

        def __init__(self, which: np.ndarray) -> None:
            self.which = which

        def __len__(self) -> int:
            return len(self.which)

        def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
            i = self.which[k]
            p = out_of_fold[i]
            return np.r_[rows[i], np.arange(size, size + len(p))], np.r_[np.ones(len(rows[i])), p]

    for j in range(k):
        if not labels[:, j].any():
            words[size, j] = -35.0
            out_of_fold = np.c_[out_of_fold, np.zeros(len(rows))]
            continue
        wide = size + j
        full = WithEarlier(np.arange(len(rows)))
        w = fit(full, labels[:, j], wide, epochs, **opts)
        words[:size, j], words[size, j], earlier[j, :j] = w[:size], w[-1], w[size:-1]
        if j + 1 < k:
            p = np.zeros(len(rows))
            for held in range(folds):
                on = np.flatnonzero(fold != held)
                w = fit(WithEarlier(on), labels[on, j], wide, epochs, **opts)
                for i in np.flatnonzero(fold == held):
                    slot, x = full[i]
                    p[i] = sigmoid(float(w[slot] @ x) + w[-1])
            out_of_fold = np.c_[out_of_fold, p]
    return Chain(words, earlier)


def kinds(rows: list[np.ndarray], toxic: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A label column per link from the toxic labels of rows of feature slots: two kinds of toxic rows, then toxic itself.

    Slots that tell toxic rows from others are weighed by log-odds; toxic rows are parted
    in two by spherical means over them, begun at the row with the most and the row least
    like it, the kind with more rows first. A toxic row without a telling slot (label
    noise, mostly) is of neither kind, as are all where nothing tells.
    """
    bad = toxic == 1
    out = np.zeros((len(rows), 3))
    out[:, 2] = bad
    size = 1 << BITS
    count = [np.zeros(size), np.zeros(size)]
    for f, y in zip(rows, bad, strict=True):
        count[int(y)][f] += 1
    n = [max(1, int((~bad).sum())), max(1, int(bad.sum()))]
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    telling = np.flatnonzero((count[1] >= LEAST_ROWS) & (odds >= np.log(TELLING)))
    place = np.full(size, -1)
    place[telling] = np.arange(len(telling))
    which = [i for i in np.flatnonzero(bad) if (place[rows[i]] >= 0).any()]
    if len(which) < 2:
        return out
    x = np.zeros((len(which), len(telling)))
    for k, i in enumerate(which):
        at = place[rows[i]]
        x[k, at[at >= 0]] = odds[telling[at[at >= 0]]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    first = int(np.argmax((x > 0).sum(1)))
    means = x[[first, int(np.argmin(x @ x[first]))]]
    of = np.zeros(len(which), int)
    for _ in range(rounds):
        of = np.argmax(x @ means.T, axis=1)
        new = np.array([x[of == k].sum(0) if (of == k).any() else means[k] for k in (0, 1)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, means):
            break
        means = new
    if (of == 1).sum() > (of == 0).sum():
        of = 1 - of
    out[which, of] = 1
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 7000, max_chars: int = 28_000_000, max_doc_chars: int = 200_000) -> Chain:
    """A chain fitted on the bounded labelled sample (see ``labelled_sample``). Without labels every link predicts none."""
    sample = labelled_sample(docs, labels, ["toxic"], max_rows, max_chars, max_doc_chars).select("doc_id", "text", "toxic")

    def fit_rows(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots_of = [features(r[1]).astype(np.int32) for r in rows]
        chain = train_chain(slots_of, kinds(slots_of, np.array([r[2] for r in rows], float)))
        some = np.flatnonzero(chain.words.any(1))
        return some, chain.words[some], chain.earlier

    some, values, earlier = fit_on_executor(sample, fit_rows)
    words = np.zeros(((1 << BITS) + 1, len(LINKS)))
    words[some] = values
    return Chain(words, earlier)


def toxicity_column(spark: SparkSession, chain: Chain, text: str = "text"):
    """A struct column of the links' probabilities for each whole text; null and empty texts get the biases'."""
    model = spark.sparkContext.broadcast(chain)

    @F.arrow_udf("struct<" + ",".join(f"{x}:double" for x in chain.names) + ">")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = model.value
        for texts in batches:
            p = np.array([probabilities(features(t), c) for t in texts.to_pylist()]).reshape(-1, len(c.names))
            yield pa.StructArray.from_arrays([pa.array(p[:, j], pa.float64()) for j in range(len(c.names))], list(c.names))

    return scored(F.col(text))


def reject_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose last link stays below ``threshold``, all columns as they came.

    Null and empty texts have no slot and score the bias; where no label was learned
    from, all rows stay.
    """
    return docs.filter(toxicity_column(docs.sparkSession, chain)[chain.names[-1]] < threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, a probability per category, and ``toxic`` (the last is THRESHOLD or more), for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    p = docs.withColumn("p", toxicity_column(spark, chain))
    return p.select("doc_id", held_out().alias("held_out"), *[F.col(f"p.{x}").alias(f"p_{x}") for x in LINKS], (F.col("p.toxic") >= THRESHOLD).alias("toxic"))
