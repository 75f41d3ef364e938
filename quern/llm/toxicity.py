"""Toxicity: cumulative-link (proportional odds) ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): the grades share one weight vector and differ in
ordered thresholds. x marks which words a text holds, and which beginnings of 4 and 5 bytes its
longer words have (inflected and compound forms share them); w is fitted with an L1 penalty
(proximal gradient with momentum), so scoring looks up few features. A document's severity is its
expected grade; it is toxic if P(grade >= 1) is at least ``cut``.

Fitting takes at most ``sample_rows`` labelled documents (those whose ids hash lowest; a
documented bound) and at most ``vocabulary`` features of them. Scoring covers every whole text, one
Arrow batch at a time.

Where labels say yes or no only, severity grades are bootstrapped: a two-grade model is fitted
first and the toxic rows are split at the median of its margin into grades 1 and 2.

Defined cases: null or empty texts, and texts without any feature of the model, get the lowest
grade; rows with a null label are not
used; labels without a document neither; if one grade only is seen, every severity is that grade;
repeated rows are scored one by one (one copy is fitted); an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and digits stay (A-Z lower-cased), other ASCII separates, non-ASCII bytes are letters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def features(text: str | None) -> set[bytes]:
    """The words of a text, and the marked beginnings of its longer words."""
    ws = set(tokens(text))
    return ws | {w[:5] + b"*" for w in ws if len(w) > 5} | {w[:4] + b"*" for w in ws if len(w) > 4}


@dataclass
class OrdinalModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    base: int = 0  # the grade of all rows if there are no thresholds

    def margin(self, text: str | None) -> float:
        known = sorted(features(text) & self.weights.keys())
        return sum(self.weights[t] for t in known) if known else float("-inf")

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k; rows x thresholds, falling along a row."""
        return 1.0 / (1.0 + np.exp(np.clip(np.array(self.thresholds)[None, :] - margin[:, None], -60, 60)))

    def severity(self, margin: np.ndarray) -> np.ndarray:
        return self.base + self.above(margin).sum(axis=1)


class Sample:
    """The features of the rows to fit on, as flat arrays: an entry costs a few bytes."""

    def __init__(self, rows: Iterable[Collection[bytes]] = ()):
        ids: dict[bytes, int] = {}
        cols, lens = array("i"), array("i")
        for r in rows:
            lens.append(len(r))
            cols.extend(ids.setdefault(t, len(ids)) for t in r)
        self.tokens = list(ids)
        self.cols = np.array(cols, dtype=np.int32)
        self.rows = np.repeat(np.arange(len(lens), dtype=np.int32), np.array(lens, dtype=np.int64))
        self.shape = (len(lens), len(ids))

    def kept(self, least: int, most: int) -> "Sample":
        """Only tokens of at least ``least`` rows, the ``most`` most frequent (ties by token)."""
        df = np.bincount(self.cols, minlength=self.shape[1])
        if self.shape[1] <= most and (df >= least).all():
            return self
        order = sorted(np.flatnonzero(df >= least), key=lambda i: (-df[i], self.tokens[i]))[:most]
        new = np.full(self.shape[1], -1, dtype=np.int32)
        new[order] = np.arange(len(order), dtype=np.int32)
        cols = new[self.cols]
        out = Sample()
        out.tokens = [self.tokens[i] for i in order]
        out.cols, out.rows = cols[cols >= 0], self.rows[cols >= 0]
        out.shape = (self.shape[0], len(order))
        return out

    def margins(self, model: OrdinalModel) -> np.ndarray:
        return self.dot(np.array([model.weights.get(t, 0.0) for t in self.tokens]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w.astype(np.float32)[self.cols], self.shape[0])

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g.astype(np.float32)[self.rows], self.shape[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _loss_slopes(s: np.ndarray, y: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the mean negative log likelihood in the margins and in the thresholds."""
    edges = np.concatenate(([-np.inf], th, [np.inf]))
    hi, lo = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
    p = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    n = len(y)
    k = len(th)
    g_th = np.zeros(k)
    up, down = y < k, y > 0
    np.add.at(g_th, y[up], -d_hi[up] / n)
    np.add.at(g_th, y[down] - 1, d_lo[down] / n)
    return (d_hi - d_lo) / n, g_th


def fit(sample: Sample, grades: np.ndarray, vocabulary: int = 50_000, l1: float = 0.02, steps: int = 300) -> OrdinalModel:
    """Fit on a sample and its grades 0, 1, ...; deterministic. The penalty is ``l1`` over the root
    of the number of rows, as chance associations fade."""
    l1 = l1 / max(1, len(grades)) ** 0.5
    levels = np.unique(grades)
    if len(levels) < 2:
        return OrdinalModel(base=int(levels[0]) if len(levels) else 0)
    y = np.searchsorted(levels, grades)
    x = sample.kept(3, vocabulary)
    kept = x.tokens
    k = len(levels) - 1
    share = np.clip(np.array([(y <= j).mean() for j in range(k)]), 1e-4, 1 - 1e-4)
    th = np.log(share / (1 - share))
    # Columns are scaled by the root of their spread: a compromise between common and rare features.
    scale = np.power(np.bincount(x.cols, minlength=len(kept)) / len(y) + 1e-6, -0.25)
    w, mw, vw = np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept))
    mt, vt = np.zeros(k), np.zeros(k)
    for step in range(1, steps + 1):
        rate = 0.1 * (1 - 0.9 * step / steps)
        gs, gt = _loss_slopes(x.dot(w * scale), y, th)
        gw = scale * x.t_dot(gs)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        size = rate / (np.sqrt(vw / c2) + 1e-4)
        w = w - size * mw / c1
        w = np.sign(w) * np.maximum(np.abs(w) - size * l1, 0.0)
        th = np.sort(th - rate * (mt / c1) / (np.sqrt(vt / c2) + 1e-4))
    w = w * scale
    # Grades that don't occur between two levels get the same threshold as the level above.
    spread = [float(th[j]) for j in range(k) for _ in range(int(levels[j + 1] - levels[j]))]
    weights = {t: float(v) for t, v in zip(kept, w, strict=True) if v != 0.0}
    return OrdinalModel(weights, spread, int(levels[0]))


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"t_label": b["t_label"], "t_words": [b" ".join(sorted(features(t))) for t in b["t_text"]]})


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, sample_rows: int, vocabulary: int = 50_000) -> tuple[Sample, np.ndarray]:
    lab = labels.select(F.col("doc_id").alias("l_id"), label.cast("int").alias("t_label")).where("l_id is not null and t_label is not null")
    lab = lab.groupBy("l_id").agg(F.max("t_label").alias("t_label"))
    lab = lab.orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    d = docs.select("doc_id", F.col("text").alias("t_text"))
    x = d.join(F.broadcast(lab), F.col("doc_id") == F.col("l_id"))  # at most sample_rows rows
    # Of a repeated id the least text is taken, so reruns agree.
    x = x.groupBy("doc_id").agg(F.max("t_label").alias("t_label"), F.min("t_text").alias("t_text")).drop("doc_id")
    got = x.mapInPandas(_feature_rows, "t_label int, t_words binary").toPandas()
    order = sorted(range(len(got)), key=lambda i: bytes(got["t_words"][i]))  # sums don't depend on arrival
    y = got["t_label"].to_numpy(dtype=np.int64)[order]
    words = [got["t_words"][i] for i in order]
    del got
    # Features of one or two rows go at once; they are most of the distinct ones.
    return Sample(bytes(w).split() for w in words).kept(3, vocabulary), y


def train(docs: DataFrame, labels: DataFrame, label: Column | None = None, sample_rows: int = 8_000, graded: bool = False) -> OrdinalModel:
    """Fit on labelled rows. With ``graded`` the label is a grade 0, 1, ...; else yes or no."""
    sample, y = training_rows(docs, labels, F.col("toxic") if label is None else label, sample_rows)
    if graded or not (y > 0).any() or (y > 0).all():
        return fit(sample, y)
    y = (y > 0).astype(np.int64)
    s = sample.margins(fit(sample, y))
    return fit(sample, y + (y > 0) * (s > np.median(s[y > 0])))


def score(docs: DataFrame, model: OrdinalModel, cut: float = 0.4) -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic, grade (the likeliest) and toxic."""
    keep = [c for c in docs.columns if c not in ("severity", "p_toxic", "grade", "toxic")]
    verdict = F.pandas_udf(_scorer(model), "struct<severity double, p_toxic double, grade int>")
    x = docs.select(*[F.col(f"`{c}`") for c in keep], verdict(F.col("text")).alias("t_verdict"))
    return x.select(*[F.col(f"`{c}`") for c in keep], "t_verdict.*", (F.col("t_verdict.p_toxic") >= cut).alias("toxic"))


def _scorer(model: OrdinalModel):
    def verdict(texts: pd.Series) -> pd.DataFrame:
        s = np.array([model.margin(t) for t in texts], dtype=np.float64)
        up = model.above(s) if model.thresholds else np.zeros((len(s), 0))
        full = np.concatenate([np.ones((len(s), 1)), up, np.zeros((len(s), 1))], axis=1)
        likeliest = (full[:, :-1] - full[:, 1:]).argmax(axis=1) + model.base
        at = max(0, -model.base)  # P(grade >= 1) is P(grade > 0)
        p = up[:, at] if up.shape[1] > at and model.base < 1 else np.full(len(s), float(model.base >= 1))
        return pd.DataFrame({"severity": model.base + up.sum(axis=1), "p_toxic": p, "grade": likeliest.astype("int32")})

    verdict.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return verdict


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", "grade", "toxic")


def reject_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.4) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with the columns of ``docs``."""
    model = train(docs, labels)
    verdict = F.pandas_udf(_scorer(model), "struct<severity double, p_toxic double, grade int>")
    return docs.where(verdict(F.col("text")).getField("p_toxic") < cut)
