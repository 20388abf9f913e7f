"""Operator 2: language identification by multilingual mixture inference.

A document is a mixture of languages. Expectation-maximisation estimates its
proportions from n-gram likelihoods; the set of languages is the one with the highest
likelihood less a penalty for each language in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import fit_on_executor, held_out, materialise, table

BITS = 16
NGRAM = 4
#: EM ends when a round gains less than SETTLED a n-gram; a further language begins with the share LEAST.
ROUNDS, SETTLED, LEAST = 200, 1e-5, 0.1
UNDETERMINED = "und"
_HAS_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(x if 97 <= x < 123 or x >= 128 else 32 for x in range(256))


@dataclass(frozen=True)
class Languages:
    """Sorted names; ``logp[slot, language]``."""

    names: tuple[str, ...]
    logp: np.ndarray


def grams(text: str) -> np.ndarray:
    """Hash slots of the 4-byte n-grams of the lower-cased whole text; all but letters counts as one kind of space.

    N-grams that are mostly space are left out, they tell nothing.
    """
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) + b" "
    found = []
    for at in range(0, max(1, len(data) - NGRAM + 1), bw.SPAN):
        b = np.frombuffer(data[at : at + bw.SPAN + NGRAM - 1], np.uint8).astype(np.uint32)
        if len(b) < NGRAM:
            continue
        code = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        code = code[(b[1:-2] != 32) & (b[2:-1] != 32)]
        found.append((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _em(like: np.ndarray, count: np.ndarray, theta: np.ndarray, rounds: int = ROUNDS, settled: float = SETTLED) -> tuple[np.ndarray, float]:
    """Proportions from ``theta`` on, until a round gains less than ``settled`` of log likelihood a n-gram (``rounds`` at most), and their log likelihood."""
    total = count.sum()
    mixed = like @ theta
    value = float(count @ np.log(mixed))
    for _ in range(rounds):
        theta = theta * (like.T @ (count / mixed)) / total
        mixed = like @ theta
        new = float(count @ np.log(mixed))
        gain, value = new - value, new
        if gain < settled * total:
            break
    return theta, value


def _counted(text: str | None, model: Languages) -> tuple[np.ndarray, np.ndarray] | None:
    """Counts of a text's n-grams and their rows of the model; none for a text that has no language."""
    if not text or not model.names or not _HAS_LETTER.search(text):
        return None
    g = np.sort(grams(text))
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(g)]) / NGRAM  # neighbouring n-grams share letters: they count as one
    return count, model.logp[g[first]]


def _mixture(count: np.ndarray, logp: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The chosen columns of ``logp``, at least one n-gram given, and their shares.

    Forward selection: the best single language, then again and again the one that raises
    the mixture's likelihood most steeply from where it stands, refitted by EM, as long
    as the likelihood gains more than a language's penalty. No set size is fixed.
    """
    single = count @ logp
    best = int(np.argmax(single))
    chosen, share, value = [best], np.ones(1), float(single[best])
    n = logp.shape[1]
    if n == 1:
        return np.array(chosen), share
    shift = logp.max(1)
    like, base = np.exp(logp - shift[:, None]), float(count @ shift)
    cost, total = penalty * np.log(1.0 + count.sum()), count.sum()
    while len(chosen) < n:
        slope = like.T @ (count / (like[:, chosen] @ share))  # above total: a share taken from all others pays
        slope[chosen] = 0.0
        new = int(np.argmax(slope))
        if slope[new] <= total:
            break
        part = [*chosen, new]
        t, ll = _em(like[:, part], count, np.r_[share * (1 - LEAST), LEAST] if len(chosen) > 1 else np.full(2, 0.5))
        if ll + base - cost <= value:
            break
        value, chosen, share = ll + base - cost, part, t
    return np.array(chosen), share


def infer(text: str | None, model: Languages, penalty: float = 3.0) -> tuple[str, float, list[str], list[float]]:
    """(language, its share, the language set, the set's shares), largest share first.

    A null text or one without a letter is ``und`` with share 0 and an empty set, as is
    any text where no language has been learned. Ties go to the first name in order.
    """
    got = _counted(text, model)
    if got is None:
        return UNDETERMINED, 0.0, [], []
    count, logp = got
    if not len(count):  # a text of single letters: all languages are alike
        return model.names[0], 1.0 / len(model.names), [model.names[0]], [1.0]
    chosen, share = _mixture(count, logp, penalty)
    by = np.argsort(-share, kind="stable")
    names, shares = [model.names[i] for i in chosen[by]], share[by].tolist()
    return names[0], min(1.0, max(0.0, shares[0])), names, shares


def standing(text: str | None, model: Languages, penalty: float = 3.0) -> float:
    """The largest share that a language holds of the whole text, what no learned language explains counted in.

    All languages and a background where each n-gram is as likely as any other share the
    text. The background pays the penalty of a language: where it doesn't gain as much,
    the languages share all. 0 for ``und``; a text of single letters is shared evenly.
    """
    got = _counted(text, model)
    if got is None:
        return 0.0
    count, logp = got
    if not len(count):
        return 1.0 / len(model.names)
    chosen, share = _mixture(count, logp, penalty)
    with_flat = np.c_[logp[:, chosen], np.full(len(count), -BITS * np.log(2.0))]
    shift = with_flat.max(1)
    like = np.exp(with_flat - shift[:, None])
    known, ll = _em(like, count, np.r_[share, 1.0] / 2.0)
    before = float(count @ np.log(like[:, :-1] @ share))
    return float((known[:-1] if ll - before > penalty * np.log(1.0 + count.sum()) else share).max())


def train(texts: list[str], langs: list[str], passes: int = 2, smooth: float = 0.5) -> Languages:
    """n-gram tables per language; after the first pass, texts that the model places elsewhere don't count."""
    names = tuple(sorted(set(langs)))
    got = [np.bincount(grams(t), minlength=1 << BITS).astype(np.float32) if len(t) > 20_000 else grams(t) for t in texts]
    of = {n: i for i, n in enumerate(names)}
    use, model = np.ones(len(texts), bool), Languages(names, np.zeros((1 << BITS, len(names)), np.float32))
    for p in range(passes):
        counts = np.full((1 << BITS, len(names)), smooth)
        for i, g in enumerate(got):
            if use[i]:
                counts[:, of[langs[i]]] += g if g.dtype == np.float32 else np.bincount(g, minlength=1 << BITS)
        model = Languages(names, np.log(counts / counts.sum(0)).astype(np.float32))
        if p + 1 < passes:
            use = np.array([of[langs[i]] == int(np.argmax(g @ model.logp if g.dtype == np.float32 else model.logp[g].sum(0))) for i, g in enumerate(got)])
    return model


def fit_languages(docs: DataFrame, per_language: int = 600, max_doc_chars: int = 20_000, max_chars: int = 48_000_000) -> Languages:
    """Fitted on at most ``per_language`` texts of each non-null ``lang`` among rows not held out.

    They're those with the smallest hash of their text, repeats counted once, none of
    over ``max_doc_chars``, and of each language as many as come to its even part of
    ``max_chars``, so the fit's memory has one bound for any number of languages. The
    rank is cut before its shuffle, so no language's texts gather anywhere.
    """
    slim = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_doc_chars)).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("key"), F.length("text").alias("n")
    )
    by_key = Window.partitionBy("lang").orderBy("key", "n")
    ranked = slim.distinct().withColumn("r", F.row_number().over(by_key)).filter(F.col("r") <= per_language)
    ranked = ranked.withColumn("run", F.sum("n").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    languages = docs.filter(~held_out() & F.col("lang").isNotNull()).agg(F.count_distinct(F.col("lang").cast("string"))).first()[0]
    kept = ranked.filter((F.col("run") <= max_chars / max(1, languages)) | (F.col("r") == 1))
    cut = materialise(kept.groupBy("lang").agg(F.max("key").alias("cut")), "cuts")
    rows = (
        docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") <= max_doc_chars))
        .select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("key"))
        .join(cut, "lang")
        .filter(F.col("key") <= F.col("cut"))
        .dropDuplicates(["lang", "key"])
        .select("lang", "text")
    )
    return fit_on_executor(rows, lambda got: train([r[1] for r in got], [r[0] for r in got]))


def language_column(spark: SparkSession, model: Languages, text: str = "text"):
    """A struct column (lang, share, langs, shares) for each whole text; null texts and those without a letter are ``und`` with share 0 and no set."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,share:double,langs:array<string>,shares:array<double>>")
    def inferred(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            rows = [infer(t, m) for t in texts.to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["lang", "share", "langs", "shares"])

    return inferred(F.col(text))


def reject_undetermined(docs: DataFrame, model: Languages, least_share: float = 0.25) -> DataFrame:
    """The rows of ``docs`` where one language holds at least ``least_share`` of the text, all columns as they came.

    Null texts and texts without a letter go, and those where no language stands out:
    gibberish, texts of no learned language, even mixtures of more than 1 / ``least_share``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def stands(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([standing(t, shared.value) for t in texts.to_pylist()], pa.float64())

    return docs.filter(stands(F.col("text")) >= least_share)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the language set with its shares, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs)
    p = docs.select("doc_id", "text").withColumn("p", language_column(spark, model))
    return p.select("doc_id", held_out().alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.share").alias("score"), F.col("p.langs").alias("langs"), F.col("p.shares").alias("shares"))
