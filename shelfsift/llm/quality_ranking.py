"""Quality of documents by Bradley-Terry ranking.

A document has a score w.x over measures of its style. Of a document labelled good and one labelled
bad, the good one is preferred, with probability sigmoid(w.x_good - w.x_bad): the weights minimise
the logistic loss of such pairs on the differences of their measures. There is no intercept, since
it would cancel in every pair; where good begins is read off afterwards, as the quantile of the
training scores that leaves the share of bad documents below it. The score given out is the
probability that a document is preferred to one that lies at this threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The weights are fitted on the driver from the measures of at most so many labelled documents,
#: those whose ids have the least hash, and on at most so many pairs of them.
SAMPLE_DOCS = 20_000
PAIRS = 60_000
RIDGE = 3e-3
#: Standardised measures are held within this, so that one odd document does not bend the fit.
WITHIN = 6.0

#: Kinds of bytes: lower case, upper case, digit, space, line break, sentence mark, other mark, symbol, beyond ASCII.
KINDS = 9
_KIND = np.full(256, 6, np.int64)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\x0b\x0c\r", b"\n", b".,;:'\"()-?", b"", b"#*$%&|<>{}[]\\/^~`@_=+", range(128, 256))):
    _KIND[list(_bytes)] = _kind
MEASURES = 14
WIDTH = MEASURES + KINDS * KINDS


def measures(text: str | None) -> np.ndarray:
    """Of a whole text; a null text is an empty one."""
    out = np.zeros(WIDTH)
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    words = (text or "").split()
    if not len(raw) or not words:
        return out
    kinds = _KIND[raw]
    share = np.bincount(kinds, minlength=KINDS) / len(raw)
    letters = share[0] + share[1] + share[8]
    lines = [line for line in text.split("\n") if line.strip()]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(n for n in windows.values() if n > 1)
    counts = Counter(words)
    out[:MEASURES] = (
        math.log1p(len(words)), math.log1p(len(raw) / len(words)), share[1] / max(letters, 1e-9), letters, share[2], share[7], share[6], share[5],
        len(counts) / math.sqrt(len(words)), len(counts) / len(words), repeated / max(len(words) - 2, 1), 1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(len(words) / max(len(lines), 1)), max(counts.values()) / len(words),
    )
    out[MEASURES:] = np.sqrt(np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) / len(raw))
    return out


@dataclass(frozen=True)
class RankingModel:
    """Weights on standardised measures, and the score from which on documents are good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -WITHIN, WITHIN) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


def preference_pairs(y: np.ndarray, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) places of pairs: all of them, or ``most`` in which every document has its turn:
    the two sides are stepped through in fixed shuffled orders, shifted against each other a round."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    total = len(good) * len(bad)
    if total <= most:
        return np.repeat(good, len(bad)), np.tile(bad, len(good))
    rng = np.random.default_rng(7)
    good, bad = rng.permutation(good), rng.permutation(bad)
    k = np.arange(most)
    return good[k % len(good)], bad[(k + k // math.lcm(len(good), len(bad))) % len(bad)]


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.(x_better - x_worse))) + ridge/2 |w|^2, by Newton steps."""
    d = x[better] - x[worse]
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(d @ v)).mean() + ridge / 2 * v @ v)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = -(d.T @ p) / len(d) + ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(bend, slope), 1.0
        while (ahead := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - ahead < 1e-10:
            break
        w, now = w - size * step, ahead
    return w


def fit(x: np.ndarray, y: np.ndarray) -> RankingModel:
    """Without documents of both labels nothing can be preferred: every score is then 0.5 or, with
    one label only, that label's side."""
    if not len(y) or len(np.unique(y)) < 2:
        only = 0.0 if not len(y) else (-1.0 if y[0] == 1 else 1.0)
        return RankingModel(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), only)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -WITHIN, WITHIN)
    w = fit_pairs(z, *preference_pairs(y))
    # The quantile that leaves as many documents below as are labelled bad, midway between two scores.
    strengths, bad = np.sort(z @ w), int((y == 0).sum())
    return RankingModel(mean, scale, w, float((strengths[bad - 1] + strengths[bad]) / 2))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> RankingModel:
    """Learn from labelled documents; null labels and ids teach nothing, null texts count as empty.

    The ids with the least hash are taken before any text is read, so the texts stay where they are
    and only measures of at most SAMPLE_DOCS documents reach the driver, also where ids repeat.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    ids = known.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(SAMPLE_DOCS)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.try_validate_utf8(F.col(text)).alias("_text"))
    rows = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select(F.xxhash64("_id").alias("h"), "_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measures(t.as_py()).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.binary())], names=["h", "_id", "_y", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"h bigint, _id {kind}, _y int, x binary").orderBy("h", "_id", "_y", "x").limit(SAMPLE_DOCS).collect()
    x = np.array([np.frombuffer(r["x"]) for r in found]) if found else np.zeros((0, WIDTH))
    return fit(x, np.array([r["_y"] for r in found], np.int64))


def rank_quality(docs: DataFrame, model: RankingModel, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``doc`` (the columns of ``carry``, all by default) with ``score`` (0 to 1) and ``predicted``
    (1 from 0.5 on). Whole texts; null, empty and blank ones have no measures and share one score.
    Repeated rows are scored alike; empty tables give no rows."""
    kept = F.struct(*[F.col(c) for c in (docs.columns if carry is None else carry)]).alias("doc")
    rows = docs.select(kept, F.try_validate_utf8(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, WIDTH))
            for i, value in enumerate(batch.column(1)):
                x[i] = measures(value.as_py())
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc", "score", "predicted"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double, predicted int")
