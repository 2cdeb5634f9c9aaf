"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a short vector of transformed statistics (logarithms and
logits of counts and shares over the whole text). Per class, one aggregation
gathers the row count, the sums and the sums of products; the class covariance
is shrunk towards the pooled one and towards a multiple of the identity. The
score is the logistic of the difference of the two Gaussian log-densities,
each a Mahalanobis distance by the class's Cholesky factor plus its log
determinant and log prior. The factors are computed once and shipped as a few
hundred numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import dropped, held_out, only, publish, table, unused

THRESHOLD = 0.3
#: Weights of the pooled covariance and of the identity in a class covariance.
POOLED = 0.1
IDENTITY = 0.02

_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")

_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_SENTENCE_MARK = np.zeros(256, bool)
_SENTENCE_MARK[[ord(c) for c in ".,;:'\"-()"]] = True
_MARK = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH | _SENTENCE_MARK)
_MARK[:32] = False

FEATURES = (
    "log_bytes",
    "log_word_bytes",
    "upper_share",
    "digit_share",
    "mark_share",
    "pause_share",
    "space_share",
    "bang_share",
    "bar_share",
    "mark_entropy",
    "distinct_share",
    "repeated_lines",
    "packed_share",
    "sentence_words",
    "marked_words",
)


def _logit(share: float, n: float) -> float:
    """Log odds of a share, drawn in by half a count at either end."""
    n = max(n, 1.0)
    share = (share * n + 0.5) / (n + 1.0)
    return float(np.log(share / (1.0 - share)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda mask: float(counts[mask].sum()) / max(n, 1)
    marks = counts[_MARK].astype(float)
    total = marks.sum()
    p = marks[marks > 0] / total if total else np.ones(1)
    ends = len(_SENTENCE.findall(text)) if text else 0
    # Distinct words fall with length in any text: measured over windows of 100, a tail of up to 50 with the one before it.
    edges = [*range(0, max(m - 50, 1), 100), m]
    windows = [words[a:b] for a, b in zip(edges, edges[1:])]
    distinct = sum(len(set(w)) for w in windows) / max(sum(map(len, windows)), 1) if m else 1.0
    packed = len(zlib.compress(raw, 1)) / max(n, 1) if n else 1.0
    marked = sum(1 for w in words if w[-1] in b"*$%&#!|@^~=_+<>") / max(m, 1)
    return [
        float(np.log1p(n)),
        float(np.log((n + 1.0) / (m + 1.0))),
        _logit(share(_UPPER), n),
        _logit(share(_DIGIT), n),
        _logit(share(_MARK), n),
        _logit(share(_SENTENCE_MARK), n),
        _logit(share(_SPACE), n),
        _logit(float(counts[ord("!")]) / max(n, 1), n),
        _logit(float(counts[ord("|")]) / max(n, 1), n),
        float(-(p * np.log(p)).sum()),
        _logit(distinct, m),
        _logit(1.0 - len(set(lines)) / max(len(lines), 1) if lines else 0.0, len(lines)),
        float(np.log(packed + 0.02)),
        float(np.log((m + 1.0) / (ends + 1.0))),
        _logit(marked, m),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians: means, inverted Cholesky factors and constants per class."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [k - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, k in zip(self.means, self.whiten, self.constants)]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def _vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    dropped()
    for texts in batches:
        yield pd.Series([statistics(t) for t in texts], dtype=object)


def with_statistics(docs: DataFrame, text_column: str, name: str) -> DataFrame:
    """The frame with an array of the text's statistics beside its columns."""
    return docs.withColumn(name, F.pandas_udf(_vectors, "array<double>")(F.col(f"`{text_column}`")))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    dropped()
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for part in batches:
        for label in (0, 1):
            x = np.array(part.loc[part.quality == label, "x"].tolist(), float).reshape(-1, d)
            sums[label] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    at = np.arange(sums.shape[1])
    yield pd.DataFrame({"label": np.repeat([0, 1], len(at)), "at": np.tile(at, 2), "v": sums.ravel()})


def fit(rows: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """Fit on (x, quality) rows by one aggregation of sums, a few hundred numbers.

    A class without rows takes the other's moments; without any rows the score
    is one half everywhere.
    """
    d = len(FEATURES)
    found = (
        rows.select("x", F.col("quality").cast("int").alias("quality"))
        .where("quality in (0, 1)")
        .mapInPandas(_moments, "label int, at int, v double")
        .groupBy("label", "at")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    sums = np.zeros((2, 1 + d + d * d))
    for r in found:
        sums[r["label"], r["at"]] = r["v"]
    n = sums[:, 0]
    if n.sum() == 0:
        sums[:, 0], sums[:, 1 + d :] = 1.0, np.eye(d).ravel()
        n = sums[:, 0]
    every = sums.sum(0)
    centre = every[1 : 1 + d] / every[0]
    second = every[1 + d :].reshape(d, d) / every[0]
    scale = np.sqrt(np.maximum(np.diag(second) - centre**2, 1e-6))
    means, spreads = [], []
    for label in (0, 1):
        s = sums[label] if n[label] else sums[1 - label]
        mean = s[1 : 1 + d] / s[0]
        cov = s[1 + d :].reshape(d, d) / s[0] - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        spreads.append(cov / np.outer(scale, scale))
    weight = np.maximum(n, 1) / np.maximum(n, 1).sum()
    common = weight[0] * spreads[0] + weight[1] * spreads[1]
    whiten, constants = [], []
    for label in (0, 1):
        cov = (1 - pooled) * spreads[label] + pooled * common
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(lower))
        constants.append(np.log(weight[label]) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(whiten), np.array(constants))


def scored(frame: DataFrame, model: Discriminant, vectors: str, name: str) -> DataFrame:
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dropped()
        for x in batches:
            yield pd.Series(model.score(np.array(x.tolist(), float).reshape(len(x), -1)))

    return frame.withColumn(name, F.pandas_udf(score, "double")(F.col(vectors)))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels whose crc32(id) mod 5 is 0 are held out of the fit. Null texts count
    as empty; every text, empty ones too, gets a score. A null id is scored and
    never learnt from; ids that repeat give a row each; a repeated label counts
    as often as it is given. An empty table gives an empty result.
    """
    frame = publish(with_statistics(only(docs, id_column, text_column), "text", "x").drop("text"), "statistics")
    model = fit_on(frame, labels)
    out = scored(frame.withColumn("held_out", held_out("doc_id", 5, 0)), model, "x", "score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit_on(frame: DataFrame, labels: DataFrame) -> Discriminant:
    learnt = labels.select("doc_id", "quality").where(~held_out("doc_id", 5, 0))
    return fit(frame.join(learnt, "doc_id"))


def with_score(docs: DataFrame, model: Discriminant, text_column: str, name: str) -> DataFrame:
    """The frame with the score of the whole text beside its columns."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dropped()
        for texts in batches:
            yield pd.Series(model.score(np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))))

    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col(f"`{text_column}`")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with their own columns."""
    frame = with_statistics(only(docs, "doc_id", "text"), "text", "x").drop("text")
    model = fit_on(publish(frame, "statistics"), table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return with_score(docs, model, "text", score).where(F.col(score) >= THRESHOLD).drop(score)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
