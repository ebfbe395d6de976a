"""Toxicity scores from confirmed toxic examples and unlabelled text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costspark.runtime import materialise, scratch_path

WORD = re.compile(r"[^\W_]+")


def features_of(text: str) -> set[str]:
    """The distinct words of a text in lower case, and their beginnings of five and six letters ("stupi*")."""
    words = set(WORD.findall(text.lower()))
    return words.union([w[:5] + "*" for w in words if len(w) > 5], [w[:6] + "*" for w in words if len(w) > 6])


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def nnpu_weights(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 3e-4
) -> np.ndarray:
    """Weights (last: constant) of a linear classifier under the non-negative PU risk.

    Risk: prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with logistic loss l.
    Where the second part falls below 0 the step goes up that part instead.
    """
    p = np.hstack([positive, np.ones((len(positive), 1), np.float32)])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), np.float32)])
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        toward = u.T @ (su / len(u)) - prior * (p.T @ (sp / len(p)))
        grad = prior * (p.T @ ((sp - 1) / len(p))) + toward if negative >= 0 else -toward
        grad = grad + ridge * np.append(w[:-1], 0)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, own in enumerate(rows):
        out[i, own] = 1
    return out


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = 3000,
    max_unlabelled: int = 6000,
    n_features: int = 400,
    members: int = 3,
    prior: float | None = None,
) -> dict[str, float] | None:
    """Feature weights ("" is the constant) of the mean of ``members`` classifiers; None without a toxic example.

    The sample is bounded: ``max_positive`` confirmed examples and ``max_unlabelled``
    documents of unknown label, both chosen by a hash of the id among rows that aren't held
    out.  Of its features the ``n_features`` that tell the two parts apart best are kept.  ``prior``
    is the share of toxic documents; by default that among the labelled rows learnt from.
    """
    spark = docs.sparkSession
    known = (
        labels.where(~held_out(id_col) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).alias("toxic"))
    )
    if prior is None:
        prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    prior = min(prior, 0.99)
    order = [F.xxhash64("id", F.lit(5)), F.col("id")]
    ids = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    chosen = (
        known.where("toxic = 1").select("id", F.lit(True).alias("toxic")).orderBy(*order).limit(max_positive)
        .unionByName(ids.select("id", F.lit(False).alias("toxic")).orderBy(*order).limit(max_unlabelled))
    )
    # At most max_positive + max_unlabelled ids.
    sample = F.broadcast(materialise(chosen, scratch_path(spark, "toxic-sample")))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "features": [list(features_of(t)) for t in b["text"]]})

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialise(
        texts.join(sample, "id").select("toxic", "text").mapInPandas(listed, "toxic boolean, features array<string>"),
        scratch_path(spark, "toxic-words"),
    )
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return None
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")
    )
    share_p, share_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    apart = F.abs(F.log(share_p / share_u)) * F.abs(share_p - share_u)
    best = counts.where("p + u >= 3").orderBy(apart.desc(), "feature").limit(n_features).collect()
    place = {r["feature"]: i for i, r in enumerate(best)}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [sorted(place[x] for x in features if x in place) for features in b["features"]]
            yield pd.DataFrame({"toxic": b["toxic"], "own": own})

    found = rows.mapInPandas(coded, "toxic boolean, own array<int>").collect()
    found.sort(key=lambda r: (r["toxic"], r["own"]))  # the same rows in any order give the same model
    positive = _matrix([r["own"] for r in found if r["toxic"]], len(place))
    unlabelled = _matrix([r["own"] for r in found if not r["toxic"]], len(place))
    weights = np.zeros(len(place) + 1)
    for k in range(members):
        part = np.arange(len(unlabelled)) % members != k if members > 1 and len(unlabelled) > members else slice(None)
        weights += nnpu_weights(positive, unlabelled[part], prior) / members
    return {**{w: float(weights[i]) for w, i in place.items()}, "": float(weights[-1])}


def toxicity_score(text: Column, model: dict[str, float] | None) -> Column:
    """Probability of toxic text, from the set of its features; 0 without a model, null text counts as empty."""
    if model is None:
        return F.lit(0.0)
    weights, constant = {w: x for w, x in model.items() if w}, model[""]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        sums = [constant + sum(map(weights.__getitem__, features_of(t) & weights.keys())) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -500, 500))))

    return score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced.

    Rows without an id are scored and count as not held out; several labels of one id count
    as toxic if one is.  Nothing but the text enters the score.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, **options)
    return (
        docs.withColumn("held_out", held_out(id_col))
        .withColumn("score", toxicity_score(F.col(text_col), model))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
