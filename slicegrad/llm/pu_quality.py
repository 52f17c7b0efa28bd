"""Quality classifier from positive and unlabelled texts (non-negative risk).

Trusted positives are the labelled good texts of the training folds; the rest is unlabelled web text. With class prior
``p`` and logistic loss, the risk of a scorer is ``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))``. The
bracket estimates the loss on the unseen negatives; it counts as zero where it falls below, so the scorer cannot gain by
calling everything negative that it memorised. With this loss both terms are convex. So is the risk, the larger of the
risk with the bracket and the risk without it: its least value is that of the whole risk if the bracket is not negative
there, and otherwise lies where the bracket, weighted by a factor between zero and one, is zero; halving finds the factor.
The prior is estimated first, by the best bin: a scorer that tells positives from unlabelled texts is fitted, and over
its thresholds the least upper bound of ``P(unlabelled above) / P(positives above)`` is taken, with a term for the error
of both shares. Negative labels are never used.

A text is described by the logarithms of a few shares (signs, capitals, letters, words and lines said again) that do
not depend on its length, made in one pass over the whole text. The eight numbers of every text of the training folds are
written once. All of them are the unlabelled side: their means, their histogram of scores and the loss, slope and
curvature of each Newton step are sums over all rows, made per task and added by Spark, so the driver sees a few hundred
numbers a step. Only the labelled side is a sample: at most ``SAMPLE`` positives, those with the smallest hashes of their
ids. Scoring covers all rows.

Defined results: null counts as empty, and empty texts get a score like others; a null id is never a training row;
repeated rows are scored one by one; of several labels of one id the least quality counts; without trusted positives
every score is 0.5; an empty table gives an empty result; columns other than the text are never inputs of a score.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicegrad.llm.common import drop_saved, fresh, saved, text_of, unit_hash

#: Bound of the sample of labelled positives.
SAMPLE = 20_000
#: Bins of the scores from which the prior is estimated.
BINS = 4096
#: Most Newton steps of a fit, and halvings of the bracket's factor.
STEPS = 25
HALVINGS = 12
FOLDS = 5
THRESHOLD = 0.3

SIGN_BYTES = np.zeros(256, bool)
SIGN_BYTES[list(b"#*$%&|<>@^~_+=/\\{}[]`")] = True
N_FEATURES = 8


def held_out(key: Column) -> Column:
    """True for the fifth of the ids whose labels are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def describe(text: str) -> list[float]:
    """The features of one text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(data, minlength=256)
    chars = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    second = data[1:][data[:-1] == 0xC3]  # Latin-1 letters
    upper = counts[65:91].sum() + ((second >= 0x80) & (second <= 0x9E)).sum()
    letters = counts[65:91].sum() + counts[97:123].sum() + len(second)
    log = lambda share: float(np.log1p(100 * share))
    return [
        log(counts[SIGN_BYTES].sum() / chars),
        log(counts[ord("!")] / chars),
        log(upper / max(1, letters)),
        log(counts[ord("|")] / chars),
        log(counts[list(b"#%&$")].sum() / chars),
        log(sum(map(eq, words, words[1:])) / n),
        log((len(lines) - len(set(lines))) / max(1, len(lines))),
        log(letters / chars) / 5,
    ]


def described(rows: DataFrame) -> DataFrame:
    """``sg_id`` and the features ``x`` of each of ``rows(sg_id, text)``."""
    kind = rows.schema["sg_id"].dataType.simpleString()

    def features(batches):
        for batch in batches:
            found = [describe(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("sg_id"), pa.array(found, pa.list_(pa.float64()))], names=["sg_id", "x"])

    return rows.select("sg_id", "text").mapInArrow(features, f"sg_id {kind}, x array<double>")


def summed(table: DataFrame, make) -> np.ndarray:
    """Sum of the vectors that ``make(features)`` gives for the batches of ``table(x)``; added per task, then over tasks."""

    def partial_sums(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + make(batch.column(0).flatten().to_numpy().reshape(-1, N_FEATURES))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    rows = table.select("x").mapInArrow(partial_sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(rows.num_rows)
    out[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Scorer:
    """Logistic scorer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, prior: float):
        self.mean, self.scale, self.w, self.prior = mean, scale, w, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.minimum(z, 0) ** 2, np.maximum(z, 0) ** 2, np.ones((len(z), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(x) @ self.w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from histograms of scores that tell the two sets apart (best bin)."""
    above = lambda counts: np.cumsum(counts[::-1])[::-1] / counts.sum()
    p, u = above(positive), above(unlabelled)
    error = np.sqrt(np.log(4 / delta) / 2)
    enough = p > 0.1
    bound = (u + error / np.sqrt(unlabelled.sum()) + error / np.sqrt(positive.sum())) / np.maximum(p, 1e-9)
    best = np.flatnonzero(enough)[np.argmin(bound[enough])]
    return float(np.clip(u[best] / p[best], 0.05, 0.99))


def moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])


class Side:
    """Means over one set of texts: of the loss of calling them negative, with its slope and curvature, and of inputs."""

    def __init__(self, n: float, add):
        self.n, self.add = n, add

    def negative(self, scorer: Scorer, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        size = len(w)

        def sums(x):
            inputs = scorer.inputs(x)
            z = inputs @ w
            s = sigmoid(z)
            curve = (inputs * (s * (1 - s))[:, None]).T @ inputs
            return np.concatenate([[np.logaddexp(0, z).sum()], inputs.T @ s, curve.ravel()])

        total = self.add(sums) / self.n
        return float(total[0]), total[1 : size + 1], total[size + 1 :].reshape(size, size)

    def histogram(self, scorer: Scorer, w: np.ndarray) -> np.ndarray:
        return self.add(lambda x: np.bincount(np.minimum(sigmoid(scorer.inputs(x) @ w) * BINS, BINS - 1).astype(int), minlength=BINS).astype(float))


def newton(value, w: np.ndarray, ridge: float, tolerance: float = 1e-7) -> np.ndarray:
    """Least value of a convex function with a ridge; ``value(w)`` gives value, slope and curvature."""
    full = lambda w: (lambda f, g, h: (f + ridge / 2 * w @ w, g + ridge * w, h + ridge * np.eye(len(w))))(*value(w))
    f, g, h = full(w)
    for _ in range(STEPS):
        move = np.linalg.solve(h, g)
        gain, rate = g @ move, 1.0
        if gain < tolerance:
            break
        while True:
            new = w - rate * move
            nf, ng, nh = full(new)
            if nf <= f - 0.1 * rate * gain or rate < 1e-3:
                break
            rate /= 2
        w, f, g, h = new, nf, ng, nh
    return w


def fit(positive: np.ndarray, table: DataFrame, ridge: float = 1e-2) -> Scorer:
    """Scorer of least non-negative risk; ``positive`` are features of trusted texts, ``table(x)`` those of all unlabelled ones."""
    known = moments(positive)
    total = summed(table, moments)
    mean, square = np.split((total[1:] / total[0] + known[1:] / known[0]) / 2, 2)
    scorer = Scorer(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6, np.zeros(1), 0.5)
    good, web = Side(known[0], lambda make: make(positive)), Side(total[0], lambda make: summed(table, make))
    inputs = scorer.inputs(positive).mean(0)  # the loss of calling a text positive is that of calling it negative, less its score
    start = np.zeros(len(inputs))

    def apart(w):
        (fp, gp, hp), (fu, gu, hu) = good.negative(scorer, w), web.negative(scorer, w)
        return (fp - inputs @ w + fu) / 2, (gp - inputs + gu) / 2, (hp + hu) / 2

    first = newton(apart, start, ridge)
    prior = estimate_prior(good.histogram(scorer, first), web.histogram(scorer, first))

    def weighted(share):
        """Risk on the positives and ``share`` of the bracket."""

        def value(w):
            (fp, gp, hp), (fu, gu, hu) = good.negative(scorer, w), web.negative(scorer, w)
            keep = prior * (1 - share)
            return keep * fp - prior * (inputs @ w) + share * fu, keep * gp - prior * inputs + share * gu, keep * hp + share * hu

        return value

    bracket = lambda w: web.negative(scorer, w)[0] - prior * good.negative(scorer, w)[0]
    w = newton(weighted(1.0), first, ridge)
    if bracket(w) < 0:
        low, high = 0.0, 1.0
        for _ in range(HALVINGS):
            share = (low + high) / 2
            w = newton(weighted(share), w, ridge)
            low, high = (share, high) if bracket(w) > 0 else (low, share)
    scorer.w, scorer.prior = w, prior
    return scorer


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scorer | None:
    """Fit on the training folds: a bounded sample of trusted positives, all texts as unlabelled; None without positives."""
    rated = labels.groupBy(F.col(f"`{key}`").alias("sg_id")).agg(F.min("quality").alias("quality"))
    trusted = rated.filter((F.col("quality") == 1) & ~held_out(F.col("sg_id")) & F.col("sg_id").isNotNull())
    chosen = trusted.orderBy(unit_hash(F.col("sg_id")), "sg_id").limit(sample).select("sg_id")
    rows = docs.select(F.col(f"`{key}`").alias("sg_id"), text_of(text).alias("text")).filter(F.col("sg_id").isNotNull() & ~held_out(F.col("sg_id")))
    table, path = saved(described(rows), "features")
    known = table.join(F.broadcast(chosen), "sg_id").orderBy(unit_hash(F.col("sg_id")), "x").limit(sample).select("x").toArrow()
    positive = np.array(known.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    scorer = fit(positive, table) if len(positive) else None
    drop_saved(docs.sparkSession, path)
    return scorer


def score(docs: DataFrame, scorer: Scorer | None, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every row as a new last column."""
    (body,) = fresh(docs, "sg_text")
    held = docs.withColumn(body, text_of(text))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def scored(batches):
        for batch in batches:
            x = np.array([describe(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.float64).reshape(-1, N_FEATURES)
            values = scorer(x) if scorer else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=schema.names)

    return held.mapInArrow(scored, schema)


def good_documents(docs: DataFrame, scorer: Scorer | None, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    (name,) = fresh(docs, "sg_score")
    return score(docs, scorer, text=text, name=name).filter(F.col(name) >= threshold).drop(name)
