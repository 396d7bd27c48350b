"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, toxic ones among them, is unlabelled. No document
counts as a confirmed negative anywhere. A linear model over the words of a text minimises the risk estimate
prior * R+(P) + max(0, R-(U) - prior * R-(P)): the positives hidden in U are taken off by the class prior, and where that
makes the negative part fall below zero, the step goes up along it instead, so the model can't fit the unlabelled rows as
negatives. The prior is estimated from P and U alone: for any set of documents, prior * P(set) <= U(set), and the sets
tried are those that a classifier of P against U, trained on the other half of the sample, scores highest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample, in documents: confirmed toxic, and unlabelled (about).
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
#: Words are features if they stand in so many sampled documents and their rates differ by so many standard errors.
LEAST_DOCUMENTS, LEAST_Z = 5, 4.0
#: The prior where there are too few positives to estimate one, and so many positives are needed.
FEW_PRIOR, FEW = 0.05, 20
#: Sets that are tried hold such a share of the positives at least; standard errors that are allowed for where they're compared.
LEAST_SHARE, ERRORS = 0.5, 2.0
CUT = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
HASH_SEED = 17


def word_hash(word: str) -> int:
    """32 bits: of a hundred million words some twenty share the weight of one of a thousand features."""
    import xxhash

    return xxhash.xxh32_intdigest(word.encode("utf-8", "replace"), HASH_SEED)


def features(text: str | None) -> bytes:
    """Distinct hashed words of the whole text, as packed 32-bit integers."""
    return np.array(sorted({word_hash(x) for x in LETTERS.findall((text or "").lower())}), dtype=np.uint32).tobytes()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    prior: float = FEW_PRIOR

    def scores(self, texts) -> np.ndarray:
        known: dict[str, float] = {}
        get, out = self.weights.get, []
        for text in texts:
            z = self.bias
            for x in set(LETTERS.findall((text or "").lower())):
                w = known.get(x)
                if w is None:
                    if len(known) > 200_000:
                        known.clear()
                    w = known[x] = get(word_hash(x), 0.0)
                z += w
            out.append(z)
        return sigmoid(np.array(out, dtype=np.float64))


class Rows:
    """A sparse 0/1 matrix: documents by kept features, and a column of ones at the end."""

    def __init__(self, sets: list[np.ndarray], kept: np.ndarray):
        self.shape = (len(sets), len(kept) + 1)
        at = np.concatenate([np.empty(0, dtype=np.uint32), *sets])
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.searchsorted(kept, at)
        hit = column < len(kept)
        hit[hit] = kept[column[hit]] == at[hit]
        self.row, self.column = row[hit], column[hit]

    def times(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, theta[self.column], self.shape[0]) + theta[-1]

    def sums(self, r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.column, r[self.row], self.shape[1] - 1)[: self.shape[1] - 1], r.sum())


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features whose rate among the positives is clearly higher or lower than among the unlabelled: all of them, sorted."""
    words, n = np.unique(np.concatenate([np.empty(0, dtype=np.uint32), *positive, *unlabelled]), return_counts=True)
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(np.searchsorted(words, np.concatenate(positive)), minlength=len(words))
    pool = (n + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - (n - in_p) / n_u) / np.sqrt(pool * (1 - pool) * (1 / n_p + 1 / n_u))
    return words[(np.abs(z) >= LEAST_Z) & (n >= LEAST_DOCUMENTS)]


def descend(gradient, size: int, bias: float, steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam on all rows at once; the last parameter is the bias, which doesn't decay."""
    theta = np.append(np.zeros(size - 1), bias)
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(theta)
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], splits: int = 4, steps: int = 300, rate: float = 0.05) -> float:
    """Share of positives among the unlabelled, from these two samples alone.

    The samples are halved at random some times. A ratio can only be too high for want of a good classifier, so of the
    estimates the lower quartile counts.
    """
    if min(len(positive), len(unlabelled)) < FEW:
        return FEW_PRIOR
    found, draw = [], np.random.default_rng(0)
    orders = [(draw.permutation(len(positive)), draw.permutation(len(unlabelled))) for _ in range(splits)]
    for of_positive, of_unlabelled, half in ((*x, half) for x in orders for half in (0, 1)):
        (p, p2), (u, u2) = ([[rows[i] for i in order[h::2]] for h in (half, 1 - half)] for rows, order in ((positive, of_positive), (unlabelled, of_unlabelled)))
        kept = telling(p, u)
        xp, xu = Rows(p, kept), Rows(u, kept)

        def gradient(theta):
            return xp.sums(sigmoid(xp.times(theta)) - 1) / len(p) + xu.sums(sigmoid(xu.times(theta))) / len(u)  # noqa: B023

        theta = descend(gradient, len(kept) + 1, 0.0, steps, rate, 1e-3)
        sp, su = np.sort(Rows(p2, kept).times(theta)), np.sort(Rows(u2, kept).times(theta))
        cuts = np.unique(sp)
        of_p, of_u = 1 - np.searchsorted(sp, cuts) / len(p2), 1 - np.searchsorted(su, cuts) / len(u2)
        # the set whose ratio is least when both rates are off by some standard errors
        error = lambda rate, n: ERRORS * np.sqrt((rate * n + 1) * ((1 - rate) * n + 1) / (n + 2) ** 3)
        least = of_p - error(of_p, len(p2))
        best = int(np.where((of_p >= LEAST_SHARE) & (least > 0), (of_u + error(of_u, len(u2))) / np.maximum(least, 1e-9), np.inf).argmin())
        found.append(of_u[best] / of_p[best])
    return float(np.clip(np.quantile(found, 0.25), 1 / len(unlabelled), 0.9))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None, steps: int = 1500, rate: float = 0.05, decay: float = 2e-5) -> Model:
    """Non-negative PU training with the logistic loss on the whole sample; the prior is estimated unless it's given."""
    prior = min(max(estimate_prior(positive, unlabelled) if prior is None else prior, 1e-4), 0.9)
    model = Model(float(np.log(prior / (1 - prior))), {}, prior)
    if not positive or not unlabelled:
        return model
    kept = telling(positive, unlabelled)
    xp, xu = Rows(positive, kept), Rows(unlabelled, kept)
    n_p, n_u = len(positive), len(unlabelled)

    def gradient(theta):
        sp, su = sigmoid(xp.times(theta)), sigmoid(xu.times(theta))
        # loss of a positive is -log s, of a negative -log(1 - s)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        as_negative = xu.sums(su) / n_u - prior * xp.sums(sp) / n_p
        return prior * xp.sums(sp - 1) / n_p + as_negative if negative >= 0 else -as_negative

    theta = descend(gradient, len(kept) + 1, model.bias, steps, rate, decay)
    return Model(float(theta[-1]), {int(k): float(w) for k, w in zip(kept, theta)}, prior)


def held_out(doc_id: Column) -> Column:
    """True for ids (crc32 of their text mod 3 is 1) whose labels training never sees; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit to bounded samples, drawn by hashes in one pass over the documents. Labels other than 1 aren't used.

    Ids with null or contradicting labels give no positives. Without positives the model is the prior. Copies of a text
    count once, and so do the documents of a repeated id.
    """
    known = labels.select(F.col(id_column).alias("i"), F.col(label_column).alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
    ids = known.groupBy("i").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = 1 AND hi = 1").orderBy(F.xxhash64("i")).limit(max_positive).select("i", F.lit(True).alias("positive"))

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in texts], dtype=object)

    share = min(1.0, max_unlabelled / max(1, docs.count()))
    whole = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).withColumn("h", F.xxhash64(F.lit(7), "i", "t"))
    whole = whole.withColumn("drawn", ~held_out(F.col("i")) & (F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    rows = whole.join(F.broadcast(ids), "i", "left").where("drawn OR positive").withColumn("f", hashed("t"))
    as_positive = F.when(F.col("positive"), F.struct(F.lit(True).alias("p"), F.col("i").cast("string").alias("k")))
    as_drawn = F.when(F.col("drawn"), F.struct(F.lit(False).alias("p"), F.col("h").cast("string").alias("k")))
    parts = rows.select(F.explode(F.array_compact(F.array(as_positive, as_drawn))).alias("e"), "f")
    # repeated ids and rows fall together before they're sent, so the bounds hold whatever repeats
    sample = {(r["p"], bytes(r["f"])) for r in parts.groupBy("e.p", "e.k").agg(F.min("f").alias("f")).collect()}
    positive, unlabelled = ([np.frombuffer(f, dtype=np.uint32) for p, f in sorted(sample) if p is which] for which in (True, False))
    return fit(positive, unlabelled, prior)


def score_column(text: Column, model: Model) -> Column:
    """Probability of the toxic label; a null text scores as an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1) and predicted (score >= 0.7).

    Only texts are inputs of a score: repeated rows and ties score alike, null and empty texts get the model's base rate.
    Columns of other names aren't read; an empty table of documents gives an empty result.
    """
    model = train(docs, labels, id_column, text_column, **options)
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), score_column(F.col(text_column), model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
