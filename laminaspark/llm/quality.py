"""Quality classifier by positive-unlabelled learning (non-negative risk, Kiryo et al. 2017)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import identified, over_batches, read, slices

#: Folds of crc32(doc_id as text); fold 0 is held out. Trusted positives, and web texts that lay the cells out, that the driver
#: sees at most. Least score that is kept.
FOLDS, SAMPLE, KEEP = 5, 12_000, 0.3
#: Random planes; the sides of them on which a text's features lie are its cell. All web texts are summed up by cell.
PLANES = 10
_LINE = re.compile(r"\n+")
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b".,;:'\"-()?", b"!", b"|", b"#$%&*@+=~^_<>/\\", b"{}[]", b"\n"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k


def features(text: str) -> np.ndarray:
    """Dense features of a whole text: shares of byte classes, shape and repetition of words and lines. Empty text: zeros."""
    raw = text.encode()
    words = text.split()
    if not words:
        return np.zeros(N_FEATURES)
    share = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=len(_CLASSES) + 1) / len(raw)
    n, counts = len(words), Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lines = [x for x in _LINE.split(text) if x]
    upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    odd = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'")
    again = sum(map(str.__eq__, words, words[1:]))
    long = sum(c for w, c in counts.items() if len(w) > 18)
    values = [np.log1p(n), len(counts) / n, top[0] / n, sum(top) / n, np.log(len(counts)) / np.log1p(n), upper / n, odd / n, again / n, long / n, (len(raw) - n) / n / 10, np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), sum(c for w, c in counts.items() if w[-1] in ".?") / n]
    return np.concatenate([share, np.sqrt(share[:-1]), values, [1.0]])


N_FEATURES = 2 * len(_CLASSES) + 1 + 13 + 1


@dataclass
class Model:
    """A small network on standardised features: score = sigmoid of its output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    @classmethod
    def constant(cls, hidden: int = 16) -> Model:
        """Scores every text 0.5, so that nothing is rejected without evidence."""
        return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 0.5)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, weights: np.ndarray | None = None, moments: tuple[np.ndarray, np.ndarray] | None = None, hidden: int = 16, steps: int = 700, rate: float = 0.01, decay: float = 1e-4, seed: int = 7, separate: bool = False) -> Model:
    """Minimises prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss by Adam. Where the
    second term falls below zero the step goes up its gradient instead, as in the published algorithm. weights: how many texts
    each unlabelled row stands for. moments: mean and deviation of the features, by the rows given if not told. separate: tell
    positives from unlabelled rows instead, each half of the risk."""
    share = np.full(len(unlabelled), 1 / len(unlabelled)) if weights is None else weights / weights.sum()
    every = np.concatenate([positive, unlabelled])
    mean, scale = moments or (every.mean(0), every.std(0))
    scale = np.where(scale < 1e-9, 1.0, scale)
    rng = np.random.default_rng(seed)
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    theta = [rng.normal(0, 0.3, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.array([np.log(prior / (1 - prior))])]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    def forward(x):
        h = np.tanh(x @ theta[0] + theta[1])
        return h, h @ theta[2] + theta[3][0]

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def back(x, h, dg):
        dh = np.outer(dg, theta[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]

    for t in range(1, steps + 1):
        (hp, gp), (hu, gu) = forward(p), forward(u)
        negative = share @ np.logaddexp(0, gu) - prior * np.logaddexp(0, gp).mean()
        dp_up = -prior * sigmoid(-gp) / len(p)
        dp_down, du = -prior * sigmoid(gp) / len(p), sigmoid(gu) * share
        if separate:
            grads = [a + b for a, b in zip(back(p, hp, dp_up), back(u, hu, (1 - prior) * du), strict=True)]
        elif negative >= 0:
            grads = [a + b for a, b in zip(back(p, hp, dp_up + dp_down), back(u, hu, du), strict=True)]
        else:
            grads = [a - b for a, b in zip(back(p, hp, -dp_down), back(u, hu, du), strict=True)]
        for k, g in enumerate(grads):
            g = g + decay * theta[k] * (k in (0, 2))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _features_of(docs: DataFrame) -> DataFrame:
    def start():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t or "") for part in slices(batch, "text") for t in part.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(x, pa.list_(pa.float64()))], names=["kind", "x"])

        return f

    return over_batches(docs.select("kind", "text"), start, "kind int, x array<double>")


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random planes through the middle of these rows' standardised features: a text's cell is x @ planes > offsets, as bits."""
    mean, scale = x.mean(0), x.std(0)
    normal = np.random.default_rng(5).normal(0, 1, (x.shape[1], PLANES)) / np.where(scale < 1e-9, 1.0, scale)[:, None]
    return normal, mean @ normal


def cells(web: DataFrame, normal: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Rows (n, sums of features, sums of their squares) over all texts of `web`, one a cell: 2 ** PLANES at most, whatever the
    number of texts. Each task sums up its own texts first."""
    names = ["n", *(f"x{k}" for k in range(N_FEATURES)), *(f"q{k}" for k in range(N_FEATURES))]

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([features(t or "") for t in part.column("text").to_pylist()]).reshape(-1, N_FEATURES)
                at = ((x @ normal > offset) << np.arange(PLANES)).sum(axis=1)
                rows = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
                order = np.argsort(at, kind="stable")
                firsts = np.flatnonzero(np.diff(at[order], prepend=-1)) if len(at) else order
                for cell, row in zip(at[order][firsts].tolist(), np.add.reduceat(rows[order], firsts) if len(at) else (), strict=True):
                    total[cell] = total[cell] + row if cell in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array(c) for c in np.array(list(total.values())).T)], names=["cell", *names])

    summed = web.select("text").mapInArrow(run, "cell long, " + ", ".join(f"{n} double" for n in names))
    return np.array([list(r) for r in summed.groupBy("cell").agg(*(F.sum(n).alias(n) for n in names)).orderBy("cell").drop("cell").collect()], dtype=np.float64).reshape(-1, len(names))


def class_prior(positive: np.ndarray, web: np.ndarray, moments: tuple[np.ndarray, np.ndarray] | None = None, delta: float = 0.1) -> float:
    """The share of positives among web texts, from positives and web texts alone (best bin estimation, Garg et al. 2021). A
    logistic fit tells one half of the positives from one half of the web texts; over the other halves, of all scores c the
    share of web texts at c or above, divided by that of positives, bounds the prior from above, and is taken where its
    confidence bound is least. The mean of both ways round, between 0.02 and 0.98; 0.5 where there are too few texts."""
    if len(positive) < 4 or len(web) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        model = fit(positive[k::2], web[k::2], 0.5, None, moments, hidden=8, steps=150, decay=1e-2, separate=True)
        p, u = (np.sort(model.logits(x[1 - k :: 2])) for x in (positive, web))
        at = np.unique(np.concatenate([p, u]))
        of_p, of_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
        of_p, of_u = of_p[of_p > 0], of_u[of_p > 0]
        slack = np.sqrt(np.log(4 / delta) / 2 / len(p)) + np.sqrt(np.log(4 / delta) / 2 / len(u))
        best = np.argmin((of_u + 1.01 * slack) / of_p)
        found.append(of_u[best] / of_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` trusted positives, chosen by a hash of id, text and place, and on all web texts outside the
    held-out fold, summed up by cell: features of `sample` of them at most lay the cells out, then every text counts in its
    cell, in the features' means and deviations, and with the cell in the risk. The class prior is estimated from the
    positives and those `sample` web texts. Labelled negatives serve for nothing.

    Null ids, and labels other than 1, are passed over; repeated rows count as often as they occur. Where nothing can be
    learnt (an empty table, no trusted positive or no web text outside the held-out fold) the model is constant."""
    tagged = identified(docs.select("doc_id", "text"))
    rows = tagged.select(F.col("_d.doc_id").cast("long").alias("doc_id"), F.coalesce("_d.text", F.lit("")).alias("text"), "_row").where("doc_id IS NOT NULL").where(~held_out())
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality = 1").where(~held_out())
    ids = rows.select("doc_id", F.xxhash64("doc_id", "text", "_row").alias("h"), "_row")

    def some(of: DataFrame, kind: int) -> DataFrame:
        chosen = F.broadcast(of.orderBy("h", "_row").limit(sample).select("_row"))  # `sample` longs
        return rows.join(chosen, "_row", "left_semi").select(F.lit(kind).alias("kind"), "text")

    got = _features_of(some(ids.join(good.select("doc_id"), "doc_id", "left_semi"), 1).unionByName(some(ids, 0))).toPandas()
    x, kind = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES), got["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return Model.constant()
    x = x[np.lexsort(np.vstack([x.T, kind]))]  # rows arrive in any order; the fit shall not depend on it
    positive, some_web = x[-int((kind == 1).sum()) :], x[: int((kind == 0).sum())]
    summed = cells(rows, *planes(some_web))
    n, sums, squares = summed[:, 0], summed[:, 1 : 1 + N_FEATURES], summed[:, 1 + N_FEATURES :]
    mean = sums.sum(0) / n.sum()
    moments = mean, np.sqrt(np.maximum(0, squares.sum(0) / n.sum() - mean * mean))
    web = sums / n[:, None]
    return fit(positive, web, class_prior(positive, some_web, moments), n, moments)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, empty and null ones too, by the text alone. Repeated rows
    repeat; an empty table gives no rows."""

    def start():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [float(y) for part in slices(batch, "text") for y in model.score(np.array([features(t or "") for t in part.column("text").to_pylist()]).reshape(-1, N_FEATURES))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(y >= keep) for y in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        return f

    return over_batches(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), start, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows whose text the model scores at least `keep`, with their own columns; a filter by an Arrow function, so
    that no text is shuffled. Null texts are scored as empty."""

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t or "") for t in text]).reshape(-1, N_FEATURES)))

    return docs.where(scored(F.col("text")) >= keep)
