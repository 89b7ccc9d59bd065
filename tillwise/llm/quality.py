"""Quality classifier learnt from positive and unlabelled texts.

A small network over counts of a text's bytes, words and lines is trained on the non-negative
risk: ``prior * loss(positives, 1) + max(0, loss(unlabelled, 0) - prior * loss(positives, 0))``.
Trusted positives are the labelled rows of quality 1 that may be learnt from; the unlabelled are
documents without a label; the prior is the share of quality 1 among the labels learnt from.
Texts enter the sample by a hash of their content, SAMPLE of each kind at most; everything is
scored.

Defined results: a null text is scored as the empty one; repeated rows score alike; a document
without an id is never learnt from; without positives or unlabelled texts every score is the
prior, or 0.5 if there are no labels either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.frames import byte_table, scan, small_batches, text_slices, window_hashes, with_struct

#: Most texts of each kind that a model is fitted on.
SAMPLE = 8000
#: Scores from here up count as good.
THRESHOLD = 0.3
FOLDS = 5

SCORED = T.StructType([T.StructField("score", T.DoubleType())])

#: Groups of bytes whose shares of a text are features.
BYTE_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:", b"!",
    b"?", b"|", b"#$%&*", b"@", b"/\\", b"<>{}[]()", b"_-=+~^", b"'\"`",
)


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text, from all of it."""
    out = np.zeros((len(column), len(BYTE_GROUPS) + 12))
    group = np.full(256, len(BYTE_GROUPS), np.int64)
    group[128:] = len(BYTE_GROUPS) + 1
    for i, members in enumerate(BYTE_GROUPS):
        group[list(members)] = i
    table = byte_table()
    kinds = len(BYTE_GROUPS) + 2
    for start, stop, data, bounds in text_slices(column):
        n = stop - start
        text = np.repeat(np.arange(n), np.diff(bounds))
        counts = np.bincount(text * kinds + group[data], minlength=n * kinds).reshape(n, kinds)
        size = np.maximum(np.diff(bounds), 1)[:, None]
        out[start:stop, :kinds] = counts / size
        opens, ends, hashes, first = scan(data, bounds, table)
        for i in range(n):
            own = hashes[first[i] : first[i + 1]]
            words = len(own)
            row = out[start + i, kinds:]
            row[0] = np.log1p(words)
            if not words:
                continue
            lengths = ends[first[i] : first[i + 1]] - opens[first[i] : first[i + 1]]
            _, each = np.unique(own, return_counts=True)
            row[1] = np.log(lengths.mean())
            row[2] = len(each) / words
            row[3] = each.max() / words
            row[4] = (own[1:] == own[:-1]).mean() if words > 1 else 0
            runs = window_hashes(own, 3)
            row[5] = len(np.unique(runs)) / len(runs) if len(runs) else 1
            row[6] = np.log1p(words / (1 + counts[i, 4]))
            row[7] = np.log1p(lengths.max())
            row[8] = np.log(len(each)) / np.log1p(words)
            row[9] = (lengths <= 2).mean()
    return out


@dataclass
class Model:
    """A network with one hidden layer, or a constant where there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    output: np.ndarray
    output_bias: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        margin = np.tanh(z @ self.hidden + self.hidden_bias) @ self.output + self.output_bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, units: int = 16) -> Model:
    """Minimise the non-negative risk by full-batch Adam, from a fixed start."""
    if not len(positive) or not len(unlabelled):
        return Model(*[np.zeros(0)] * 5, 0.0, constant=float(prior))
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    rng = np.random.default_rng(7)
    params = [
        rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], units)), np.zeros(units), rng.normal(0, 0.1, units), np.zeros(1)
    ]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
    for step in range(1, steps + 1):
        w, b, v, c = params
        hidden_p, hidden_u = np.tanh(p @ w + b), np.tanh(u @ w + b)
        score_p, score_u = sigmoid(hidden_p @ v + c), sigmoid(hidden_u @ v + c)
        # of the logistic loss: slope for 1 is score - 1, for 0 it is score
        negative = np.mean(-np.log(1 - score_u + 1e-12)) - prior * np.mean(-np.log(1 - score_p + 1e-12))
        if negative >= 0:
            slope_p = prior * ((score_p - 1) - score_p) / len(p)
            slope_u = score_u / len(u)
        else:  # the estimate fell below zero, which no true risk does: climb back
            slope_p = prior * score_p / len(p)
            slope_u = -score_u / len(u)
        inner_p, inner_u = (np.outer(s, v) * (1 - h * h) for s, h in ((slope_p, hidden_p), (slope_u, hidden_u)))
        slopes = [
            p.T @ inner_p + u.T @ inner_u + 1e-4 * w, inner_p.sum(axis=0) + inner_u.sum(axis=0),
            hidden_p.T @ slope_p + hidden_u.T @ slope_u + 1e-4 * v, np.array([slope_p.sum() + slope_u.sum()]),
        ]
        for x, slope, (m, s) in zip(params, slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            s += 0.001 * (slope * slope - s)
            x -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    w, b, v, c = params
    return Model(mean, scale, w, b, v, float(c[0]))


def is_held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """True for the fold that labels are not learnt from; rows without an id are in it."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit a model on bounded samples of trusted positives and of unlabelled texts."""
    small_batches(docs.sparkSession)
    marked = labels.select("doc_id", "quality").where("doc_id is not null")
    learnt = marked.where(~is_held_out() & F.col("quality").isin(0, 1))
    share = learnt.agg(F.avg("quality")).first()[0]
    prior = 0.5 if share is None else min(max(float(share), 0.01), 0.99)
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    good = hashed.join(learnt.where("quality = 1"), "doc_id", "left_semi").select("h").distinct()
    free = hashed.where("doc_id is not null").join(marked, "doc_id", "left_anti").select("h").distinct()
    # at most 2 * sample rows, so this side may be broadcast
    chosen = (
        good.orderBy("h").limit(sample).withColumn("positive", F.lit(True))
        .unionByName(free.orderBy("h").limit(sample).withColumn("positive", F.lit(False)))
    )
    texts = (
        docs.select(F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(chosen), "h")
    )

    def run(batches):
        for batch in batches:
            rows = features(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                names=["h", "positive", "x"],
            )

    described = texts.select("text", "h", "positive").mapInArrow(run, "h long, positive boolean, x array<double>")
    rows = described.groupBy("h", "positive").agg(F.first("x").alias("x")).collect()
    rows.sort(key=lambda r: r.h)
    width = len(features(pa.array([""]))[0])
    side = lambda kind: np.array([r.x for r in rows if r.positive == kind]).reshape(-1, width)
    return fit(side(True), side(False), prior)


def add_scores(
    docs: DataFrame, model: Model, name: str = "quality", keep: list[str] | None = None
) -> DataFrame:
    """Add a struct column with each text's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        fitted = shared.value

        def compute(column: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays(
                [pa.array(fitted.score(features(column)), pa.float64())], names=["score"]
            )

        return compute

    return with_struct(docs, name, SCORED, prepare, keep)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``."""
    scored = add_scores(docs, train(docs, labels), "quality_report")
    return scored.where(F.col("quality_report.score") >= threshold).select(*docs.columns)
