"""Severity of toxicity by cumulative-link ordinal regression.

A document has a score w.x over sparse word features and its grade is above k with probability
sigmoid(w.x - t_k): one weight vector for all ordered thresholds t_0 < t_1 < ... The expected
severity is the sum of these probabilities. Labels are binary, so training grades are made from
them: 0 for clean documents; toxic ones are graded by how many telling words they hold for their
length, at the quantiles of the toxic training documents.

Features are the damped counts log(1 + n) of telling words and word beginnings: those whose
document frequency among toxic training documents stands out from that among clean ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: The classifier is fitted on the driver from at most so many labelled documents, those with the
#: least hash, of at most so many characters in all: bounded whatever the table's size.
SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 32_000_000
GRADES = 3
#: A feature is telling if the log-likelihood ratio of its two frequencies is at least this, and
#: the one among toxic documents is at least so many times the other.
STANDS_OUT = 30.0
TIMES = 4.0
#: Features of the model, the most telling first.
MAX_FEATURES = 512
#: Lengths of word beginnings.
STEMS = range(4, 10)
#: Words whose features a worker remembers before it starts anew; never changes results.
REMEMBERED = 100_000
#: Documents are toxic from this expected severity on.
REJECT_FROM = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked as such."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) >= n)]


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature and thresholds; both small and fixed after training."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None, remembered: dict[str, list[str]] | None = None) -> float:
        counts: Counter[str] = Counter()
        seen = remembered if remembered is not None else {}
        for word in words(text or ""):
            own = seen.get(word)
            if own is None:
                own = seen[word] = [f for f in features_of(word) if f in self.weights]
            if own:
                counts.update(own)
        return sum(self.weights[f] * math.log1p(n) for f, n in sorted(counts.items()))

    def severity(self, text: str | None) -> float:
        """Expected grade, from 0 to the number of thresholds."""
        score = self.score(text)
        return sum(1 / (1 + math.exp(min(50.0, max(-50.0, t - score)))) for t in self.thresholds)


def fit_ordinal(x: np.ndarray, grades: np.ndarray, levels: int, ridge: float = 1e-5, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of the grades, by
    gradient steps with momentum and step sizes by coordinate. Thresholds are kept in order as
    sums of positive gaps."""
    n, d = x.shape
    params = np.zeros(d + levels - 1)
    params[d] = 1.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, gaps = params[:d], np.exp(np.clip(params[d + 1 :], -10, 10))
        t = params[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - t[None, :], -50, 50)))
        # P(grade) = p_{g-1} - p_g, with 1 in front and 0 behind.
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        own = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = p * (1 - p)
        upper = np.where(grades > 0, slope[np.arange(n), np.maximum(grades - 1, 0)], 0.0)
        lower = np.where(grades < levels - 1, slope[np.arange(n), np.minimum(grades, levels - 2)], 0.0)
        pull = (upper - lower) / own
        grad_w = x.T @ pull / n - ridge * w
        grad_t = np.zeros(levels - 1)
        np.add.at(grad_t, np.maximum(grades - 1, 0), -np.where(grades > 0, upper / own, 0.0) / n)
        np.add.at(grad_t, np.minimum(grades, levels - 2), np.where(grades < levels - 1, lower / own, 0.0) / n)
        tails = np.cumsum(grad_t[::-1])[::-1]
        grad = np.concatenate([grad_w, [tails[0]], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params += 0.2 / (1 + step / 100) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:d], params[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(params[d + 1 :], -10, 10)))])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", grades: int = GRADES) -> OrdinalModel:
    """Learn from documents with a non-null label and text. Without toxic ones or telling words
    the model finds every document clean."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    # The ids with the least hash are taken before any text is read.
    ids = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(SAMPLE_DOCS)
    sized = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    joined = sized.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).filter(F.length("_text") <= SAMPLE_CHARS // 64)
    rows, held = [], 0
    for row in sorted(joined.select("_text", "_y", F.xxhash64("_id").alias("h")).collect(), key=lambda r: (r["h"], r["_text"], r["_y"])):
        held += len(row["_text"])
        if held > SAMPLE_CHARS:
            break
        rows.append((row["_text"], row["_y"]))
    return fit(rows, grades)


def _likelihood_ratio(n: int, a: int, m: int, b: int) -> float:
    """Of n in a and m in b against one common frequency."""
    p = (n + m) / (a + b)
    part = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
    return 2 * (part(n, a * p) + part(a - n, a * (1 - p)) + part(m, b * p) + part(b - m, b * (1 - p)))


def fit(rows: list[tuple[str, int]], grades: int = GRADES) -> OrdinalModel:
    """From (text, label) pairs."""
    y = np.array([1 if label > 0 else 0 for _, label in rows], np.int64)
    a, b = int(y.sum()), int(len(y) - y.sum())
    none = OrdinalModel({}, tuple(5.0 + k for k in range(grades - 1)))
    if not a or not b:
        return none
    frequency: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for (text, _), toxic in zip(rows, y, strict=True):
        if toxic:
            frequency[1].update({f for w in set(words(text)) for f in features_of(w)})
    for (text, _), toxic in zip(rows, y, strict=True):
        if not toxic:  # of clean documents only what toxic ones hold matters
            frequency[0].update({f for w in set(words(text)) for f in features_of(w) if f in frequency[1]})
    clean, toxic = frequency
    likelihood = {f: ratio for f, n in toxic.items() if n / a >= TIMES * clean[f] / b and (ratio := _likelihood_ratio(n, a, clean[f], b)) >= STANDS_OUT}
    telling = sorted(sorted(likelihood), key=lambda f: -likelihood[f])[:MAX_FEATURES]
    if not telling:
        return none
    index = {f: i for i, f in enumerate(telling)}
    x, strength = np.zeros((len(rows), len(telling))), np.zeros(len(rows))
    for i, (text, _) in enumerate(rows):
        for w in words(text):
            own = [index[f] for f in features_of(w) if f in index]
            if own:
                x[i, own] += 1
                strength[i] += 1
    x = np.log1p(x)
    cuts = np.quantile(strength[(y == 1) & (strength > 0)], [k / (grades - 1) for k in range(1, grades - 1)])
    levels = np.where(y == 1, np.minimum(1 + np.searchsorted(cuts, strength, side="right"), grades - 1), 0)
    w, t = fit_ordinal(x, levels, grades)
    return OrdinalModel(dict(zip(telling, w.tolist(), strict=True)), tuple(t.tolist()))


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text", reject_from: float = REJECT_FROM, name: str = "severity") -> DataFrame:
    """``docs`` (all columns, under ``doc``) with ``severity`` (expected grade), ``grade`` (the
    likeliest whole grade) and ``toxic``. Whole texts; null and empty ones have no features, which
    is the severity of a document without telling words. Repeated rows are graded alike."""
    thresholds = np.array(model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, list[str]] = {}
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, value in enumerate(batch.column(1)):
                scores[i] = model.score(value.as_py(), remembered)
                if len(remembered) > REMEMBERED:
                    remembered.clear()
            p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -50, 50)))
            full = np.concatenate([np.ones((len(scores), 1)), p, np.zeros((len(scores), 1))], axis=1)
            likeliest = np.argmax(full[:, :-1] - full[:, 1:], axis=1)
            severity = p.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity), pa.array(likeliest.astype(np.int32)), pa.array(severity >= reject_from)],
                names=["doc", name, "grade", "toxic"],
            )
        give_back()

    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc {docs.schema.simpleString()}, {name} double, grade int, toxic boolean")
