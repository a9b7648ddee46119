"""Toxicity (operator 1): cumulative-link ordinal regression on sparse word counts.

``P(grade <= k | x) = sigmoid(threshold_k - w . x)`` for the ordered grades 0..K-1: one weight vector for all thresholds. The
result is the expected grade, ``sum_k P(grade > k)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.byte_bpe import by_text, slices
from attestor.llm.common import cut, read, whole

GRADES = 4
# The fit reads at most about this many labelled rows and uses at most so many features; both bound the sample, not the scoring.
MAX_LABELLED = 12_000
MAX_FEATURES = 512
MIN_ROWS = 3
MIN_ODDS, MIN_Z = 2.0, 4.0  # a feature's log odds of the toxic class, and how many standard errors they are above 0
PREFIXES = (4, 5, 6)
L2 = 1e-4
REJECT = 0.5

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """A word's features: itself and its beginnings, which compounds and inflections share."""
    return (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))


def counts_of(text: str) -> dict[str, int]:
    """How often each feature occurs in the whole text."""
    out: dict[str, int] = {}
    for word in WORD.findall(text.lower()):
        for name in features(word):
            out[name] = out.get(name, 0) + 1
    return out


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self):
        """Function from a text to ``w . x``, where x holds log(1 + count) of each feature; remembers which words have features."""
        weights = {w: float(v) for w, v in zip(self.words, self.weights) if v}
        seen: dict[str, tuple[str, ...]] = {}

        def link(text: str) -> float:
            found: dict[str, int] = {}
            for word in WORD.findall(text.lower()):
                names = seen.get(word)
                if names is None:
                    if len(seen) >= 100_000:
                        seen.clear()
                    names = seen[word] = tuple(f for f in features(word) if f in weights)
                for name in names:
                    found[name] = found.get(name, 0) + 1
            return sum(weights[f] * log1p(n) for f, n in sorted(found.items()))

        return link

    def above(self, links: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - links[:, None], -60, 60)))


def fit_links(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_words: int, n_grades: int = GRADES,
              l2: float = L2, steps: int = 800, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that minimise the cumulative-link negative log likelihood plus an L2 penalty (Adam).

    The sparse matrix is given as (row, column, value). Thresholds are a first one and positive steps (kept as logarithms).
    Weights stay at 0 or more, so no amount of harmless words hides an insult, and most of them are 0.
    """
    n = len(grades)
    weights, cuts = np.zeros(n_words), np.r_[1.0, np.zeros(n_grades - 2)]
    moments = [np.zeros(n_words + n_grades - 1) for _ in range(2)]
    for step in range(1, steps + 1):
        thresholds = cuts[0] + np.r_[0.0, np.cumsum(np.exp(cuts[1:]))]
        link = np.bincount(rows, values * weights[columns], minlength=n)
        edge = np.r_[-np.inf, thresholds, np.inf]
        with np.errstate(over="ignore"):
            upper = 1.0 / (1.0 + np.exp(np.clip(-(edge[grades + 1] - link), -60, 60)))
            lower = 1.0 / (1.0 + np.exp(np.clip(-(edge[grades] - link), -60, 60)))
        mass = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        by_link = (up - low) / n  # derivative of -log mass by the link
        by_threshold = np.bincount(grades, -up, minlength=n_grades)[:-1] / n + np.bincount(grades, low, minlength=n_grades)[1:] / n
        by_cut = np.r_[by_threshold.sum(), np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(cuts[1:])]
        gradient = np.r_[np.bincount(columns, values * by_link[rows], minlength=n_words) + l2 * weights, by_cut]
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient ** 2
        move = rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
        weights, cuts = np.maximum(weights - move[:n_words], 0.0), cuts - move[n_words:]
    return weights, cuts[0] + np.r_[0.0, np.cumsum(np.exp(cuts[1:]))]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    """Model from rows with a text and a label 0 or 1 (rows with another or no label are left out).

    Spark counts, per feature, the rows of each class over a sample chosen by a hash of the text (all rows, or about ``max_labelled`` of
    them where there are more), and keeps the ``max_features`` features that speak most surely for label 1. Grades: 0 for rows labelled
    0; rows labelled 1 get 1, 2 or 3 by the tertile of their evidence, the sum of log(1 + count) over kept features. Only counts of
    kept features leave Spark. Without rows of both classes the model rejects nothing.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(whole(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
    share = max_labelled / max(rows.count(), 1)
    pick = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) if share < 1 else F.lit(True)

    def make(texts):
        return [pa.array([list(counts_of(t).items()) for t in texts], pa.map_(pa.string(), pa.int64()))]

    sample = cut(by_text(rows.where(pick), "text", make, "counts map<string,bigint>", 1 << 18, drop_text=True).select("y", "counts"))
    per_class = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    none, some = per_class.get(0, 0), per_class.get(1, 0)
    if not none or not some:
        return Model([], np.zeros(0), np.full(GRADES - 1, 60.0))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (some + 1.0 - a)) - F.log(b / (none + 1.0 - b))
    error = F.sqrt(1 / a + 1 / b + 1 / (some + 1.0 - a) + 1 / (none + 1.0 - b))
    kept = sample.select("y", F.explode(F.map_keys("counts")).alias("name")).groupBy("name").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")) \
        .where(F.col("a") + F.col("b") >= MIN_ROWS).select("name", odds.alias("odds"), (odds / error).alias("z")) \
        .where((F.col("odds") >= MIN_ODDS) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "name").limit(max_features).collect()
    index = {r.name: i for i, r in enumerate(kept)}

    def pick_features(batches):
        for batch in batches:
            found = [sorted((index[f], n) for f, n in counts if f in index) for counts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())),
                                              pa.array([[log1p(n) for _, n in f] for f in found], pa.list_(pa.float64()))], names=["y", "at", "x"])

    table = sample.mapInArrow(pick_features, "y int, at array<long>, x array<double>").toPandas()
    y = table["y"].to_numpy()
    evidence = table["x"].map(np.sum).to_numpy()
    steps = np.quantile(evidence[y == 1], [1 / 3, 2 / 3])
    grades = np.where(y == 1, 1 + np.searchsorted(steps, evidence, side="right"), 0).astype(np.int64)
    at = np.repeat(np.arange(len(table)), table["at"].map(len).to_numpy())
    columns = np.concatenate([*table["at"], np.zeros(0, np.int64)]).astype(np.int64)
    values = np.concatenate([*table["x"], np.zeros(0)])
    return Model(list(index), *fit_links(at, columns, values, grades, len(index)))


def score(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``p_toxic`` (``P(grade > 0)``), ``grade`` (most likely) and ``toxic``.

    One pass over whole texts without a shuffle; a null or empty text scores like a text without known features.
    """
    link = []

    def make(texts):
        if not link:
            link.append(model.scorer())
        links = np.array([link[0](t) for t in texts])
        above = model.above(links)
        mass = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
        return [pa.array(np.round(above.sum(axis=1), 6)), pa.array(np.round(above[:, 0], 6)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= reject)]

    return by_text(docs, text_col, make, "severity double, p_toxic double, grade int, toxic boolean", drop_text=drop_text)


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Text and label of the documents that have one."""
    return documents.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").select("text", F.col("label").alias("toxic"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """Rows of ``docs`` that the model does not reject; their columns stay as they are, whatever their names."""
    at_text = docs.columns.index(text_col)

    def run(batches):
        link = model.scorer()
        for batch in batches:
            for part in slices(batch, at_text):
                links = np.array([link(t or "") for t in part.column(at_text).to_pylist()])
                yield part.filter(pa.array(model.above(links)[:, 0] < reject))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op1_toxicity(spark, d):
    model = fit(labelled_documents(read(spark, d, "documents"), read(spark, d, "labels")))
    scored = score(read(spark, d, "documents").select("doc_id", F.col("text").alias("_text")), model, "_text", drop_text=True)
    return scored.withColumn("kept", ~F.col("toxic"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
