"""Toxicity by a classifier chain: linear models in a row, each fed the earlier categories' probabilities."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelev.llm.common import sliced, table, utf8

#: Category -> (column of the labels, value that means yes), in the chain's order.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
_WORD = re.compile(r"[^\W_]+")


def words(text: bytes) -> set[str]:
    return set(_WORD.findall(text.decode().lower()))


def features(word: str) -> list[str]:
    """A word's features: itself and its beginnings of four to six letters."""
    return ["=" + word] + [word[:n] for n in (4, 5, 6) if len(word) >= n]


class Known(dict):
    """word -> numbers of its chosen features; remembered up to a bound."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word):
        got = self[word] = tuple(self.index[f] for f in features(word) if f in self.index)
        return got

    def of(self, text: bytes) -> tuple[list[int], int]:
        """Numbers of the text's features, and its count of distinct words."""
        if len(self) > 100_000:
            self.clear()
        ws, out = words(text), set()
        for w in ws:
            if got := self[w]:
                out.update(got)
        return sorted(out), len(ws)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Sparse rows of ones (feature numbers) beside a dense part."""

    def __init__(self, ids: list[list[int]], dense: np.ndarray, width: int):
        self.n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter((j for r in ids for j in r), np.int64, int(self.n.sum()))
        self.row = np.repeat(np.arange(len(ids)), self.n)
        self.dense, self.width = dense, width

    def dot(self, w):
        return np.bincount(self.row, w[self.ids], len(self.n)) + self.dense @ w[self.width:]

    def back(self, g):
        return np.concatenate([np.bincount(self.ids, g[self.row], self.width), self.dense.T @ g])

    def take(self, keep):
        out = object.__new__(Rows)
        new = np.cumsum(keep) - 1
        on = keep[self.row]
        out.n, out.ids, out.row, out.dense, out.width = self.n[keep], self.ids[on], new[self.row[on]], self.dense[keep], self.width
        return out


def fit_logistic(rows: Rows, y: np.ndarray, l2: float = 0.3, steps: int = 60) -> np.ndarray:
    """Weights of an L2-regularised logistic regression (the constant, the last weight, is free), by L-BFGS."""
    size = rows.width + rows.dense.shape[1]
    w, pen = np.zeros(size), np.full(size, l2)
    pen[-1] = 1e-6
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 9.5))
    if not len(y) or y.min() == y.max():
        return w

    def value(w):
        z = rows.dot(w)
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(pen * w * w), rows.back(_sigmoid(z) - y) + pen * w

    f, g = value(w)
    past: list = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, t in reversed(past):
            alphas.append((s @ d) / (t @ s))
            d = d - alphas[-1] * t
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, t), a in zip(past, reversed(alphas)):
            d = d + s * (a - (t @ d) / (t @ s))
        step = 1.0 if past else 1.0 / max(1.0, np.abs(g).sum())
        while step > 1e-9:
            f2, g2 = value(w + step * d)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (g2 - g) @ d > 0:
            past = [*past[-6:], (step * d, g2 - g)]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        w, f, g = w + step * d, f2, g2
        if done:
            break
    return w


@dataclass
class Chain:
    """Chosen features and, for each category in order, weights over features, dense part and earlier logits."""

    index: dict[str, int]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, ids: list[list[int]], n_words: np.ndarray) -> dict[str, np.ndarray]:
        out, dense = {}, [np.log1p(n_words)]
        for c, w in self.weights.items():
            rows = Rows(ids, np.stack([*dense, np.ones(len(ids))], 1), len(self.index))
            z = rows.dot(w)
            dense.append(np.clip(z, -8, 8))
            out[c] = _sigmoid(z)
        return out


def fit_chain(index: dict, ids: list, n_words: np.ndarray, y: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """Fit the chain; a later category learns from the earlier ones' out-of-fold logits, not from fitted ones."""
    chain, dense = Chain(index), [np.log1p(n_words)]
    for c, t in y.items():
        rows = Rows(ids, np.stack([*dense, np.ones(len(ids))], 1), len(index))
        chain.weights[c] = fit_logistic(rows, t)
        if c != list(y)[-1]:
            z = np.zeros(len(ids))
            for k in np.unique(folds):
                z[folds == k] = rows.take(folds == k).dot(fit_logistic(rows.take(folds != k), t[folds != k]))
            dense.append(np.clip(z, -8, 8))
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_rows: int = 20_000, per_category: int = 400, min_docs: int = 2,
        folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain on the labelled documents, at most ``max_rows`` of them (those with the least id hash).

    Labels with a null id or a null in a category's column don't count; several labels of an id
    count as yes if one says yes. Of several texts with one id the least is taken, null texts as
    empty. Feature counts by category are made by Spark over the whole training rows; the
    ``per_category`` features with the largest chi-square that speak for a category and that at
    least ``min_docs`` rows hold are kept, so what reaches the driver is bounded by ``max_rows`` and ``per_category``.
    """
    spark, cats = docs.sparkSession, list(categories)
    whole = F.lit(True)
    for c, _ in categories.values():
        whole = whole & F.col(f"`{c}`").isNotNull()
    yes = [F.max((F.col(f"`{c}`") == v).cast("int")).alias(f"y{j}") for j, (c, v) in enumerate(categories.values())]
    marks = (labels.where(whole & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("i")).agg(*yes)
             .join(docs.select(F.col(f"`{id_col}`").alias("i")).distinct(), "i", "left_semi")
             .orderBy(F.xxhash64("i"), "i").limit(max_rows))
    marked = marks.toArrow()
    if not marked.num_rows:
        return fit_chain({}, [], np.zeros(0), {c: np.zeros(0) for c in cats}, np.zeros(0))
    label = spark.createDataFrame(marked.to_pandas())  # bounded by max_rows
    train = (docs.join(F.broadcast(label), F.col(f"`{id_col}`") == F.col("i"), "left_semi")
             .groupBy(F.col(f"`{id_col}`").alias("i")).agg(F.min(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t")))
    ys = np.stack([marked.column(f"y{j}").to_numpy() for j in range(len(cats))], 1)
    truth = spark.sparkContext.broadcast(dict(zip(marked.column("i").to_pylist(), map(tuple, ys.tolist()))))

    def count(batches):
        for b in sliced(batches, 2000):
            n, by = Counter(), [Counter() for _ in cats]
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                fs = {f for w in words(t) for f in features(w)}
                n.update(fs)
                for j, y in enumerate(truth.value[i]):
                    if y:
                        by[j].update(fs)
            names = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64())]
                                             + [pa.array([c[f] for f in names], pa.int64()) for c in by], ["f", "n", *[f"p{j}" for j in range(len(cats))]])

    total, pos = len(ys), ys.sum(0)
    counts = (train.mapInArrow(count, "f string, n long, " + ", ".join(f"p{j} long" for j in range(len(cats))))
              .groupBy("f").agg(F.sum("n").cast("double").alias("n"), *[F.sum(f"p{j}").cast("double").alias(f"p{j}") for j in range(len(cats))])
              .where(F.col("n") >= min_docs).persist())
    index: dict[str, int] = {}
    for j in range(len(cats)):
        p, n, big = F.col(f"p{j}"), F.col("n"), float(pos[j])
        if not 0 < pos[j] < total:
            continue
        cross = p * (total - big - n + p) - (big - p) * (n - p)
        chi = cross * cross / (n * F.greatest(total - n, F.lit(0.5)))
        for r in counts.where(p * total > big * n).orderBy(chi.desc(), "f").limit(per_category).select("f").collect():
            index.setdefault(r["f"], len(index))
    counts.unpersist()
    sent = spark.sparkContext.broadcast(index)

    def chosen(batches):
        known = Known(sent.value)
        for b in sliced(batches, 2000):
            got = [known.of(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int64())], ["i", "ids", "n"])

    kind = dict(train.dtypes)["i"]
    rows = train.mapInArrow(chosen, f"i {kind}, ids array<int>, n long").toArrow().sort_by("i")  # bounded by max_rows
    keys = rows.column("i").to_pylist()
    y = np.array([truth.value[i] for i in keys], np.float64)
    return fit_chain(index, rows.column("ids").to_pylist(), rows.column("n").to_numpy().astype(float), {c: y[:, j] for j, c in enumerate(cats)},
                     np.arange(len(keys)) % folds)


def score(docs: DataFrame, chain: Chain, reject: str = "toxic", threshold: float = 0.2, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` for each category and ``rejected``; columns of these names are replaced.

    ``prefix`` goes before the new names, so that a caller can keep columns that have them.

    Whole texts are read; null and empty texts have no features. Rows stay as they are, repeated ones too.
    """
    names, verdict = [f"{prefix}p_{c}" for c in chain.weights], f"{prefix}rejected"
    kept = [c for c in docs.columns if c not in (*names, verdict)]
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    at = kept.index(text_col)

    def run(batches):
        known = Known(sent.value.index)
        for b in sliced(batches, 2000):
            got = [known.of(t) for t in utf8(b.column(at))]
            p = sent.value.predict([g[0] for g in got], np.array([g[1] for g in got], np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(p[c]) for c in p], pa.array(p[reject] >= threshold)], [*b.schema.names, *names, verdict])

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(base.schema.fields))
    for n in names:
        schema = schema.add(n, DoubleType())
    return base.mapInArrow(run, schema.add(verdict, BooleanType()))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by the chain fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.drop("text")
