"""Quality classifier by hierarchical empirical Bayes.

A logistic model over measurements of the text gives every document its evidence. Hosts and, within them, paths have
posteriors of the quality rate: the mean probability of their documents, shrunk towards the global rate (host) or the
host's posterior (path) by a prior strength estimated from the spread between groups. A document's final log-odds are
its own plus what its path's posterior adds to the global rate. The posteriors that a document meets are those of the
other documents: its own evidence counts once. So sparse sites are judged by their texts and the global prior, a lone
document of a host by its text alone, and documents of large sites also by what these usually hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, skew_join

#: Bound of the training sample, in labelled documents.
MAX_LABELLED = 12000
BINS = 8
KEEP = 0.5
#: Prior strengths, in documents, between which the estimate must be.
STRENGTH = (5.0, 1e6)
SYMBOLS = "#*$%&|<>"


def measurements(text: str | None) -> list[float]:
    """Measurements of the whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n),
        1 - distinct / n if n else 0.0,
        1 - pairs / (n - 1) if n > 1 else 0.0,
        sum(map(text.count, SYMBOLS)) / chars,
        (text.count("!") + text.count("?")) / chars,
        sum(map(str.isupper, words)) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(text) / n if n else 0.0,
        sum(map(text.count, "0123456789")) / chars,
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(x))]
        for k, cuts in enumerate(self.cuts):
            at = np.searchsorted(cuts, x[:, k], side="right")
            columns += [(at > b).astype(float) for b in range(len(cuts))]
        return np.stack(columns, axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Ridge logistic regression on steps at quantiles of each measurement, by Newton's method."""
    if not len(y):
        return Model([np.empty(0)] * x.shape[1], np.zeros(1))
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    # quantiles of both classes, so that rare bad documents have steps of their own
    cuts = [np.unique(np.concatenate([np.quantile(x[y == c, k], grid) for c in (0, 1) if (y == c).any()])) for k in range(x.shape[1])]
    model = Model(cuts, np.zeros(1 + sum(map(len, cuts))))
    d, w = model.design(x), model.weights
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    model.weights = w
    return model


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit to a bounded sample of labelled rows, drawn by hash; ids with null or contradicting labels are left out."""
    known = labels.select(F.col(id_column).alias("i"), F.col(label_column).alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").select("i", "y").orderBy(F.xxhash64("i")).limit(max_labelled)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, measurements(x))) for x in texts], dtype=object)

    # one document for each id, should ids be repeated: that of the least measurements
    rows = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).join(F.broadcast(known), "i").select("i", "y", measured("t").alias("m"))
    rows = sorted(rows.groupBy("i", "y").agg(F.min("m").alias("m")).select("y", "m").collect())
    return fit(np.array([r[1] for r in rows]).reshape(len(rows), len(measurements(""))), np.array([r[0] for r in rows], dtype=float))


def evidence_column(text: Column, model: Model) -> Column:
    """Log-odds of good quality by the text alone."""

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(model.log_odds(np.array([measurements(x) for x in texts]).reshape(len(texts), -1)) if len(texts) else [], dtype="float64")

    return evidence(text)


def _strength(mean: Column) -> Column:
    """Beta prior strength by moments: between-group variance of the means beyond what their sizes explain."""
    rate = F.col("s") / F.col("n")
    spread = F.sum(F.col("n") * F.pow(rate - mean, 2)) / F.sum("n")
    noise = F.sum(mean * (1 - mean)) / F.sum("n")
    between = F.greatest(spread - noise, F.lit(1e-9))
    inner = F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")
    return F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), inner / between - 1))


def _logit(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", path_column: str = "lang", keep: float = KEEP) -> DataFrame:
    """One row per row of `docs`: doc_id, evidence, host_rate, path_rate, score and kept (score >= keep).

    A null host or path is a group of its own. Null and empty texts are measured as empty. Repeated rows and ties count one
    by one in their groups. Without labels all evidence is 0. Columns of other names aren't read; an empty table gives an
    empty result.
    """
    model = train(docs, labels, id_column, text_column)
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = durable(docs.select(F.col(id_column).alias("doc_id"), named(host_column).alias("host"), named(path_column).alias("path"), evidence_column(F.col(text_column), model).alias("evidence")))
    return posteriors(rows, keep)


def posteriors(rows: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score and kept of rows (doc_id, host, path, evidence), whose host and path aren't null."""
    paths = durable(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(_probability()).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = s / n if n else 0.5
    of_hosts = hosts.agg(_strength(F.lit(mean))).first()[0] or STRENGTH[0]
    rate = lambda n, s, strength, prior: (s + strength * prior) / (n + strength)
    paths = skew_join(paths, hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), ["host"])
    paths = durable(paths.withColumn("whole_rate", rate(F.col("host_n"), F.col("host_s"), F.lit(of_hosts), F.lit(mean))))
    of_paths = paths.agg(_strength(F.col("whole_rate"))).first()[0] or STRENGTH[0]
    out = skew_join(rows, paths.drop("whole_rate"), ["host", "path"]).withColumn("p", _probability())
    out = out.withColumn("host_rate", rate(F.col("host_n") - 1, F.col("host_s") - F.col("p"), F.lit(of_hosts), F.lit(mean)))
    out = out.withColumn("path_rate", rate(F.col("n") - 1, F.col("s") - F.col("p"), F.lit(of_paths), F.col("host_rate")))
    odds = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.lit(mean))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= keep).alias("kept"))


def _probability() -> Column:
    return 1 / (1 + F.exp(-F.col("evidence")))
