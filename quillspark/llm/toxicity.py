"""Toxicity: a classifier chain of linear models.

Categories are predicted one after the other by logistic regressions over word occurrences
and a few measures of the whole text (``MEASURES``), in standard deviations of the sample; each
later model also gets the earlier categories' probabilities. While fitting, those are out-of-fold
predictions, so that a later model learns from probabilities as good as it will see on new texts. The labels table names the chain: low quality first, then toxic.

Models are fitted on a bounded sample of labelled rows (``sample_rows``); each category's
features are the words whose share of its documents exceeds their share of the others most,
by a z-score of the two shares (at least 4). The model that predicts a fold chooses its words on
the other folds, so no label of the fold has a part in its out-of-fold probabilities. A text's
fold follows from its hash. Prediction reads whole texts where they lie.

Contract: null or empty texts have no features (measures count as the sample's means) and get
the models' base rates; a label that is null is not fitted on; labels for unknown documents are
ignored; equal texts and repeated labels are one example, with the label that most of them have
(of as many, the positive one); without labels, or with one class only, the category's probability
is its (smoothed) base rate; texts of any length are scored whole. Other columns are carried along
unused; one named like a result is refused. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, materialize
from .sampling import bounded

WORD = re.compile(r"[^\W_]+")
#: Features of every link beside its words, see ``measures``.
MEASURES = ("symbols", "distinct_words", "repeated_lines", "log_length")


@dataclass(frozen=True)
class Link:
    """One category's linear model: weights of words, of measures and of earlier probabilities.

    ``bias`` goes with the measures as they are, ``blank`` stands for both in an empty text.
    """

    category: str
    words: dict[str, float]
    measures: tuple[float, ...]
    earlier: tuple[float, ...]
    bias: float
    blank: float


def measures(lower: str, words: list[str]) -> tuple[float, float, float, float]:
    """Share of symbols, share of distinct words, share of repeated lines, log length.

    Symbols are characters that are neither white space nor part of a word.
    """
    solid = sum(map(len, lower.split()))
    lines = [x for line in lower.split("\n") if (x := line.strip())]
    return (
        (solid - sum(map(len, words))) / max(solid, 1),
        len(set(words)) / len(words) if words else 1.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        math.log1p(len(lower)),
    )


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 15) -> np.ndarray:
    """Weights with the bias last, by damped Newton steps on the regularised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, dense: np.ndarray, words: list[list[list[str]]], labels: dict[str, np.ndarray], folds: np.ndarray) -> list[Link]:
    """Fit each category in turn; columns of ``x`` are all words in order.

    ``words`` holds a category's words as chosen on all folds, then without each fold in turn;
    ``dense`` holds the measures, ``labels`` 0, 1 or -1 (unknown), ``folds`` a row's fold.
    """
    links, earlier = [], np.zeros((len(x), 0))
    mean, spread = (dense.mean(axis=0), dense.std(axis=0)) if len(dense) else (np.zeros(len(MEASURES)), np.ones(len(MEASURES)))
    spread = np.where(spread > 1e-9, spread, 1.0)
    scaled = (dense - mean) / spread
    place = {w: i for i, w in enumerate(sorted({w for sets in words for own in sets for w in own}))}

    def fitted(rows: np.ndarray, y: np.ndarray, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        features = np.hstack([x[:, [place[w] for w in own]], scaled, earlier])
        return features, fit_logistic(features[rows], y[rows]) if rows.any() else np.zeros(features.shape[1] + 1)

    for (category, y), (vocabulary, *without) in zip(labels.items(), words, strict=True):
        known = y >= 0
        _, w = fitted(known, y, vocabulary)
        out = np.zeros(len(x))
        for f, own in enumerate(without):
            features, fold_w = fitted(known & (folds != f), y, own)
            at = folds == f
            out[at] = sigmoid(features[at] @ fold_w[:-1] + fold_w[-1])
        n, m = len(vocabulary), len(vocabulary) + len(MEASURES)
        raw = w[n:m] / spread
        links.append(Link(category, {v: float(a) for v, a in zip(vocabulary, w[:n], strict=True) if abs(a) > 1e-9}, tuple(map(float, raw)), tuple(map(float, w[m:-1])), float(w[-1] - raw @ mean), float(w[-1])))
        earlier = np.hstack([earlier, out[:, None]])
    return links


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8_000, words: int = 200, n_folds: int = 5) -> list[Link]:
    """Fit the chain on a sample of at most about ``sample_rows`` labelled documents.

    ``categories`` maps each category, in chain order, to a boolean column of ``labels``.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    marks = labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(f"c{i}") for i, c in enumerate(categories.values())])
    marks = bounded(marks.where("id is not null"), sample_rows, "id")  # before texts are moved
    own = [f"c{i}" for i in range(len(categories))]
    # At most about sample_rows small rows; copies of a text would make its every word look telling.
    found = text.join(F.broadcast(marks), "id").groupBy("text").agg(*[(F.avg(c) >= 0.5).cast("int").alias(c) for c in own])
    sample = materialize(found.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(n_folds)).cast("int")))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    chosen = telling_words(sample.select("fold", *own, F.explode(tokens).alias("word")), sample, own, words, n_folds)
    vocabulary = sorted({w for sets in chosen for one in sets for w in one})
    at = {w: i for i, w in enumerate(vocabulary)}
    held = docs.sparkSession.sparkContext.broadcast(at)  # at most words * categories * (folds + 1) entries

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dense = [], []
            for lower in (t.lower() for t in b.column("text").to_pylist()):
                found = WORD.findall(lower)
                ids.append(sorted(held.value[w] for w in set(found) & held.value.keys()))
                dense.append(measures(lower, found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64())), b.column("fold"), *[b.column(c) for c in own]], names=["at", "dense", "fold", *own])

    kinds = ", ".join(f"{c} int" for c in own)
    rows = in_arrow(sample.select("text", "fold", *own), featurise, f"at array<int>, dense array<double>, fold int, {kinds}").collect()  # the bounded sample
    discard(sample)
    rows.sort(key=lambda r: (list(r["at"]), list(r["dense"]), r["fold"], [r[c] is None or r[c] for c in own]))
    x = np.zeros((len(rows), len(vocabulary)))
    for i, r in enumerate(rows):
        x[i, list(r["at"])] = 1
    dense = np.array([r["dense"] for r in rows]).reshape(len(rows), len(MEASURES))
    y = {name: np.array([-1 if r[c] is None else r[c] for r in rows]) for name, c in zip(categories, own, strict=True)}
    return fit_chain(x, dense, chosen, y, np.array([r["fold"] for r in rows], dtype=np.int64))


def telling_words(exploded: DataFrame, sample: DataFrame, categories: list[str], most: int, n_folds: int) -> list[list[list[str]]]:
    """For each category, the words chosen on all folds, then without each fold in turn."""
    count = lambda c, f: F.sum(F.when(F.col("fold") == f, F.coalesce(c, F.lit(0))).otherwise(0))
    sums = [*[count(F.lit(1), f).alias(f"n{f}") for f in range(n_folds)], *[count(c, f).alias(f"{c}_{f}") for c in categories for f in range(n_folds)]]
    totals = {k: v or 0 for k, v in sample.agg(*sums).first().asDict().items()}
    counted = exploded.groupBy("word").agg(*sums)
    scores = []
    for i, c in enumerate(categories):
        for left in range(-1, n_folds):
            folds = [f for f in range(n_folds) if f != left]
            n, k = sum(totals[f"n{f}"] for f in folds), sum(totals[f"{c}_{f}"] for f in folds)
            if not 0 < k < n:
                continue
            seen, hits = (reduce(lambda a, b: a + b, [F.col(f"{name}{f}") for f in folds]) for name in ("n", f"{c}_"))
            rate = seen / F.lit(float(n))
            z = (hits / F.lit(float(k)) - (seen - hits) / F.lit(float(n - k))) / F.sqrt(rate * (1 - rate) * (1.0 / k + 1.0 / (n - k)) + 1e-12)
            scores.append(F.struct(F.lit(i).alias("category"), F.lit(left).alias("left"), F.when(seen >= 5, z).alias("z")))
    chosen: list[list[list[str]]] = [[[] for _ in range(n_folds + 1)] for _ in categories]
    if scores:
        ranked = counted.select("word", F.explode(F.array(*scores)).alias("s")).select("word", "s.*").where("z > 4")
        order = Window.partitionBy("category", "left").orderBy(F.desc("z"), "word")
        for r in ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).collect():  # most words for each category and fold
            chosen[r["category"]][r["left"] + 1].append(r["word"])
    return [[sorted(own) for own in sets] for sets in chosen]


def chain_probabilities(links: list[Link], texts: list[str | None]) -> list[list[float]]:
    """Each text's probability of each category, along the chain."""
    vocabulary = frozenset().union(*(link.words for link in links)) if links else frozenset()
    out = []
    for text in texts:
        lower = text.lower() if text else ""
        found = WORD.findall(lower)
        present = sorted(vocabulary.intersection(found))
        dense = measures(lower, found)
        probs: list[float] = []
        for link in links:
            base = link.bias + sum(a * v for a, v in zip(link.measures, dense, strict=True)) if lower else link.blank
            s = base + sum(link.words.get(w, 0.0) for w in present) + sum(a * p for a, p in zip(link.earlier, probs, strict=True))
            probs.append(float(sigmoid(s)))
        out.append(probs)
    return out


def score(docs: DataFrame, links: list[Link], text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability column ``p_<category>`` for each link of the chain."""
    names = [f"{prefix}{link.category}" for link in links]
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}; choose another prefix")
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                probs = chain_probabilities(links, part.column(where).to_pylist())
                new = [pa.array([p[i] for p in probs], pa.float64()) for i in range(len(links))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{c}` double" for c in names])
    return in_arrow(docs, run, schema)


def label_categories() -> dict[str, Column]:
    """The chain over the labels table: low quality, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxic_documents(docs: DataFrame, labels: DataFrame, prefix: str = "p_") -> DataFrame:
    """``docs`` with the chain's probabilities, fitted on these documents' labels."""
    links = fit(docs, labels, label_categories())
    return score(docs, links, prefix=prefix)
