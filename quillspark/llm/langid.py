"""Language identification by words first, backing off to character n-grams.

A known word scores its log frequency in each language. An unseen word falls back to its
character n-grams, with marks at its ends: the longest length of which some n-grams are
known decides, by the mean of their log frequencies. A text's score of a language is the
sum over all its words, and the answer is the posterior with equal priors.

The frequency tables come from a bounded sample of labelled rows (``sample_rows``). Each
language names its ``max_words`` most frequent words and ``max_grams`` n-grams, and an entry that
any language names is kept with the counts of all, so that a large language does not push out a
small one and what is broadcast has a fixed bound for a given set of languages. Prediction reads
whole texts where they lie, without a shuffle.

Contract: a null text, or one without a letter (Unicode category L), gives ``und`` with score 0,
as does every text if nothing can be learned; rows with a null language are not learned from;
repeated rows are predicted each; of languages with equal scores the first by name stands; texts
of any length are predicted whole; an input column named like a result is refused, others are
carried along; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, materialize, per_worker
from .sampling import bounded

WORD = re.compile(r"[^\W\d_]+")  # letters, and a few signs that are neither letters nor digits, such as a raised two
LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"
MAX_N = 4
#: Unseen words whose scores a worker keeps; beyond them it starts anew, which costs time only.
CACHE_WORDS = 200_000


@dataclass
class Model:
    """Log frequencies: a row of ``word_rows`` or ``gram_rows`` holds one for each language."""

    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray
    key: str = ""


def marked(word: str) -> str:
    return f"\x02{word}\x03"


def table(rows: list, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Entries and their smoothed log frequencies by language."""
    at: dict[str, int] = {}
    for r in rows:
        at.setdefault(r["entry"], len(at))
    counts = np.full((len(at), len(languages)), 0.5)
    column = {x: i for i, x in enumerate(languages)}
    for r in rows:
        counts[at[r["entry"]], column[r["lang"]]] += r["n"]
    return at, np.log(counts / np.maximum(counts.sum(axis=0), 1)) if len(at) else counts


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 20_000, max_words: int = 25_000, max_grams: int = 25_000) -> Model:
    """Learn from at most about ``sample_rows`` of the labelled rows."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sample = bounded(rows, sample_rows, "id")
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("entry"))
    counted = materialize(words.groupBy("lang", "entry").agg(F.count("*").alias("n")))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    padded = F.concat(F.lit("\x02"), F.col("entry"), F.lit("\x03"))
    grams = F.flatten(F.transform(F.lit(list(range(1, MAX_N + 1))), lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, n))).otherwise(F.array().cast("array<string>"))))
    gram_counts = counted.select("lang", "n", F.explode(grams).alias("entry")).groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    gram_counts = materialize(gram_counts)

    def most(df: DataFrame, k: int) -> list:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "entry")
        named = df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("entry").distinct()
        return df.join(named, "entry", "left_semi").select("lang", "entry", "n").collect()  # at most k * languages ** 2 rows

    model = Model(languages, *table(most(counted, max_words), languages), *table(most(gram_counts, max_grams), languages), uuid.uuid4().hex)
    discard(counted, gram_counts)
    return model


def words_of(text: str | None) -> list[str]:
    """All runs of letters, in lower case."""
    words = WORD.findall(text.lower()) if text else []
    return words if not words or "".join(words).isalpha() else LETTERS.findall(text.lower())


class Scorer:
    """Scores texts by a model, keeping the scores of words that it has met."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.reset()

    def reset(self) -> None:
        m = self.model
        self.at, self.used = dict(m.words), len(m.words)
        self.rows = np.zeros((self.used + CACHE_WORDS, self.width))
        self.rows[: self.used] = m.word_rows

    def unseen(self, word: str) -> np.ndarray:
        """The mean log frequencies of the longest n-grams that are known at all."""
        text, grams = marked(word), self.model.grams
        for n in range(min(MAX_N, len(text)), 0, -1):
            known = [i for i in map(grams.get, (text[j : j + n] for j in range(len(text) - n + 1))) if i is not None]
            if known:
                return self.model.gram_rows[known].mean(axis=0)
        return np.zeros(self.width)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.width:
            return UNKNOWN, 0.0
        if self.used + len(words) > len(self.rows):
            self.reset()
        if len(words) > CACHE_WORDS:  # a very long text: part by part
            total = sum(self.total(words[i : i + CACHE_WORDS // 2]) for i in range(0, len(words), CACHE_WORDS // 2))
        else:
            total = self.total(words)
        p = np.exp(total - total.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.model.languages[best], float(p[best])

    def total(self, words: list[str]) -> np.ndarray:
        at = self.at
        for w in set(words).difference(at):
            if self.used == len(self.rows):
                self.reset()
                return self.total(words)
            self.rows[self.used] = self.unseen(w)
            at[w] = self.used
            self.used += 1
        return self.rows[list(map(at.__getitem__, words))].sum(axis=0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its posterior probability."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}; choose other names")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams for each language
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_worker(("language", held.value.key), lambda: Scorer(held.value))
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                found = [scorer.predict(t) for t in part.column(where).to_pylist()]
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[0]}` string", f"`{names[1]}` double"])
    return in_arrow(docs, run, schema, keeps=True)
