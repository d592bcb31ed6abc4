"""Quality classifier learned from positive and unlabelled documents.

Trusted positives (label 1) and unlabelled web text train a linear score by
minimising the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` under the sigmoid loss,
where the class prior is estimated from the labelled rows that may be learned
from.  Labels 0 serve for that estimate only.

A document's features are the square roots of the shares of its adjacent
byte-class pairs, over its whole text, counted for whole Arrow columns at a
time.  Their distance from the mean counts by ``pairs / (pairs + SHRINK)``, so a
short text, of which little is known, is judged like the average one.  Training rows are a bounded sample
(``most_positive``, ``most_unlabelled``), drawn by a hash of doc_id, so only that
many feature vectors reach the driver; the weights that go back are a few KB.

Cases: null and empty texts have no pairs and get the average text's score.
Without any label nothing can be rejected: every score is 1.  Where only labels 0 are known every
score is 0.  A very long text is a piece of its own.
Repeated rows get equal scores; an empty table gives no rows; extra columns are
left out (``score``) or kept (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.textarrays import bounded, column_bytes, pieces

# The classes of bytes, by their members.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", "'\"", "()[]{}", "<>/\\", "-_:;@=+"]
C = len(CLASSES) + 3  # other ASCII, first and later bytes of longer characters
_CLASS = np.full(256, C - 3, np.int16)
for _i, _members in enumerate(CLASSES):
    _CLASS[list(_members.encode())] = _i
_CLASS[0x80:0xC0] = C - 1
_CLASS[0xC0:] = C - 2
WIDTH = C * C + 1  # the last is the weight of the text's own pairs
SHRINK = 100.0


def features(texts: pa.Array) -> np.ndarray:
    """One float32 row of WIDTH numbers for each text."""
    raw, offsets = column_bytes(texts)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for a, b in pieces(offsets):
        own = offsets[a : b + 1] - offsets[a]
        part = _CLASS[raw[offsets[a] : offsets[b]]]
        length = np.diff(own)
        if len(part) > 1:
            row = np.repeat(np.arange(b - a, dtype=np.int64), length)
            pair = row[1:] * (C * C) + part[:-1] * C + part[1:]
            pair = pair[row[1:] == row[:-1]]
            counts = np.bincount(pair, minlength=(b - a) * C * C).reshape(b - a, C * C)
            out[a:b, :-1] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        out[a:b, -1] = length / (length + SHRINK)
    return out


@dataclass(frozen=True)
class Model:
    """score = logistic(bias + own * (x - centre) . weights)."""

    weights: np.ndarray
    centre: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(x[:, -1] * ((x[:, :-1] - self.centre) @ self.weights) + self.bias, -500, 500)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.02, decay: float = 0.8, seed: int = 7) -> Model:
    """Full-batch Adam on the non-negative risk plus decay / n; where the risk turns negative the step goes back up."""
    n = len(positive) + len(unlabelled)
    sums = sum(x[:, :-1].sum(0, dtype=np.float64) for x in (positive, unlabelled))
    squares = sum(np.einsum("ij,ij->j", x[:, :-1], x[:, :-1], dtype=np.float64) for x in (positive, unlabelled))
    centre = (sums / n).astype(np.float32)
    spread = (np.sqrt(np.maximum(squares / n - centre.astype(np.float64) ** 2, 0)) + 1e-2).astype(np.float32)
    p, u = (x[:, -1:] * (x[:, :-1] - centre) / spread for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    w, bias = rng.normal(0, 0.01, len(centre)), 0.0
    m = v = np.zeros(len(centre) + 1)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + bias, -60, 60))) for x in (p, u))
        negative = su.mean() - prior * sp.mean()
        # Slopes of the loss of being called negative; those of being called positive are their opposites.
        gp, gu = sp * (1 - sp) / len(p), su * (1 - su) / max(len(u), 1)
        up, uu = (-prior * gp - prior * gp, gu) if negative >= 0 else (prior * gp, -gu)
        grad = np.append(p.T @ up.astype(np.float32) + u.T @ uu.astype(np.float32) + decay / len(p) * w, up.sum() + uu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model((w / spread).astype(np.float32), centre.astype(np.float32), float(bias), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _sample(ids: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of doc_id."""
    n = ids.count()
    if n <= most:
        return ids
    return ids.where(_chosen(salt, most, n))


def _chosen(salt: str, most: int, n: int) -> Column:
    """Whether a row is among about ``most`` of ``n``; the hash is fine enough for any n."""
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 62)) < int((1 << 62) * min(1.0, most / max(n, 1)))


def train(documents: DataFrame, labels: DataFrame, *, most_positive: int = 6000, most_unlabelled: int = 12000) -> Model | None:
    """The model, or None without labels; where all labels are 0 its prior is 0, and so is every score."""
    usable = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    prior = usable.agg(F.avg("quality")).first()[0]
    if prior is None:
        return None
    nothing = Model(np.zeros(WIDTH - 1, np.float32), np.zeros(WIDTH - 1, np.float32), -500.0, 0.0)
    if not prior:
        return nothing
    good = _sample(usable.where("quality = 1").select("doc_id").distinct(), most_positive, "positive").withColumn("positive", F.lit(True))
    rows = bounded(documents).select("doc_id", "text").where(~held_out(F.col("doc_id")))
    n = rows.select("doc_id").count()
    rows = rows.withColumn("unlabelled", _chosen("unlabelled", most_unlabelled, n)).join(F.broadcast(good), "doc_id", "left").where("positive or unlabelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("positive"), batch.column("unlabelled")], ["x", "positive", "unlabelled"])

    got = rows.select("text", "positive", "unlabelled").mapInArrow(run, "x binary, positive boolean, unlabelled boolean").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    mark = lambda c: np.array(got[c].fill_null(False).to_pylist(), bool)
    positive, unlabelled = x[mark("positive")], x[mark("unlabelled")]
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, float(prior))


def with_score(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with a column ``_score``; other columns pass through untouched."""
    if model is None:
        return documents.withColumn("_score", F.lit(1.0))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(features(texts)))

    return bounded(documents).withColumn("_score", score("text"))


def score(documents: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    df = with_score(documents.select("doc_id", "text"), model)
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    return with_score(documents, model).where(F.col("_score") >= threshold).select(*documents.columns)
