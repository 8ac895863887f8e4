"""Language identification by interpolated Kneser-Ney character models.

Each language has a model over letters and word edges, orders 1 to ``ORDER``. The n-grams of all
languages stand in sorted hash arrays, one an order, with the discounted probability and the
weight of the shorter context beside them, a column for each language. A text's language is the
one with the least cross-entropy a letter. The text is rejected (``rejected``, score below the
calibrated level) if even that one is high: the level is a quantile of training documents under
their own language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

ORDER = 4
DISCOUNT = 0.75
#: The models are fitted on the driver from at most so many documents a language, those with the
#: least hash, and at most so many characters a language. A document gives at most the first
#: DOC_SHARE-th of those, so one that is longer ends no sample.
SAMPLE_DOCS = 600
SAMPLE_CHARS = 4_000_000
DOC_SHARE = 8
#: And at most so many characters of all languages together.
ALL_CHARS = 64_000_000
#: The arrays have a row for an n-gram of any language and a column for each language, so from
#: FEW_LANGUAGES on characters times languages squared are bounded as well. No language is left out.
FEW_LANGUAGES = 16
CELLS = 1 << 28
#: Share of training documents that would be rejected under their own language.
REJECT_SHARE = 0.001
UNDETERMINED = "und"
#: Text bytes that a task looks at together.
CHUNK_BYTES = 1 << 20

#: Bits of a symbol in an n-gram code. Symbol 0 is the edge of a word.
_BITS = 16


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points folded to 16 bits; runs of anything else are one 0, and
    a 0 stands at both ends. Empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64)
    letters = _letters(points)
    codes = np.where(letters, points % 65521 + 1, 0).astype(np.uint64)
    keep = letters | np.concatenate([[False], letters[:-1]])
    codes = codes[keep]
    if not len(codes):
        return codes
    return np.concatenate([[0], codes, [0] if codes[-1] else []]).astype(np.uint64)


_TABLE = np.zeros(0, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    global _TABLE
    if not len(_TABLE):
        _TABLE = np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])
    return _TABLE[points]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams that end at each symbol from the n-th on."""
    out = codes[: len(codes) - n + 1].copy() if len(codes) >= n else codes[:0]
    for k in range(1, n):
        out = (out << np.uint64(_BITS)) | codes[k : len(codes) - n + 1 + k]
    return out


@dataclass
class CharModels:
    """``keys[n]`` sorted n-gram codes; ``probability[n]`` and ``backoff[n]`` (weight left to the
    shorter context, for n-grams as contexts) have a row each and a column a language. ``limits``
    and ``spreads`` calibrate rejection."""

    languages: list[str]
    keys: list[np.ndarray]
    probability: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray

    def log_probabilities(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct full n-grams of a text's codes: (-log2 p per language for each, which one each
        symbol has). The first symbol is context only."""
        padded = np.concatenate([np.zeros(ORDER - 2, np.uint64), codes])
        unique, which = np.unique(_grams(padded, ORDER), return_inverse=True)
        p = np.broadcast_to(self.floor, (len(unique), len(self.languages))).copy()
        for n in range(1, ORDER + 1):
            tail = unique & np.uint64((1 << (_BITS * n)) - 1) if n < 4 else unique
            if n > 1:
                slot, hit = self._find(n - 1, tail >> np.uint64(_BITS))
                p *= np.where(hit[:, None], self.backoff[n - 1][slot], 1.0)
            slot, hit = self._find(n, tail)
            p += np.where(hit[:, None], self.probability[n][slot], 0.0)
        return -np.log2(p), which

    def _find(self, n: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n]
        if not len(keys):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        slot = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return slot, keys[slot] == codes


def fit(samples: dict[str, Sequence[str]]) -> CharModels:
    """Interpolated Kneser-Ney: the highest order counts occurrences, lower ones count different
    predecessors; a discount is taken from every count and given to the shorter context."""
    languages = sorted(samples)
    per: list[list[tuple]] = [[] for _ in range(ORDER + 1)]
    alphabet: set[int] = set()
    for language in languages:
        texts = [symbols(t) for t in samples[language]]
        alphabet.update(int(c) for t in texts for c in np.unique(t))
        joined = np.concatenate([np.concatenate([np.zeros(ORDER - 1, np.uint64), t]) for t in texts if len(t)] or [np.zeros(0, np.uint64)])
        codes, counts = np.unique(_grams(joined, ORDER), return_counts=True)
        for n in range(ORDER, 0, -1):
            context, place = np.unique(codes >> np.uint64(_BITS), return_inverse=True)
            total = np.bincount(place, counts, len(context)) if len(codes) else np.zeros(0)
            kinds = np.bincount(place, minlength=len(context))
            p = np.maximum(counts - DISCOUNT, 0) / total[place] if len(codes) else np.zeros(0)
            per[n].append((codes, p, context, DISCOUNT * kinds / total if len(codes) else np.zeros(0)))
            # Counts of the next order: different symbols in front.
            codes, counts = np.unique(codes & np.uint64((1 << (_BITS * (n - 1))) - 1), return_counts=True)
    keys, probability, backoff = [], [], []
    for n in range(ORDER + 1):
        # n-grams, and as contexts of the next order.
        own = [c for c, *_ in per[n]] + ([x[2] for x in per[n + 1]] if n < ORDER else [])
        key = np.unique(np.concatenate(own)) if n and own else np.zeros(0, np.uint64)
        p, b = np.zeros((len(key), len(languages))), np.ones((len(key), len(languages)))
        for i in range(len(languages)):
            if n:
                p[np.searchsorted(key, per[n][i][0]), i] = per[n][i][1]
                if n < ORDER:
                    b[np.searchsorted(key, per[n + 1][i][2]), i] = per[n + 1][i][3]
        keys.append(key)
        probability.append(p)
        backoff.append(b)
    left = np.array([x[3][0] if len(x[3]) else 1.0 for x in per[1]])
    models = CharModels(languages, keys, probability, backoff, left / (len(alphabet) + 1.0), np.zeros(len(languages)))
    for i, language in enumerate(languages):
        own = [h[i] for t in samples[language] if (h := entropy(models, t)) is not None]
        models.limits[i] = np.quantile(own, 1 - REJECT_SHARE) * 1.15 if own else math.inf
    return models


def entropy(models: CharModels, text: str) -> np.ndarray | None:
    """Bits a symbol under each language, or None without a letter."""
    codes = symbols(text)
    if not len(codes):
        return None
    bits, which = models.log_probabilities(codes)
    return bits[which].sum(axis=0) / len(which)


def sample_chars(languages: int) -> int:
    """Characters a language of the training sample."""
    most = min(SAMPLE_CHARS, ALL_CHARS // max(languages, 1))
    return max(DOC_SHARE, most if languages <= FEW_LANGUAGES else min(most, CELLS // languages**2))


def train(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> CharModels:
    """Fit on ``docs`` with a non-null language and a text with a letter. Every such language has a
    sample; long documents give their beginning, from the first letter on. At most SAMPLE_DOCS documents a language
    reach the driver; they are chosen per (language, slice of the hash) first, so that a language
    with most of the rows is never sorted in one task."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    keyed = known.select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.length(text).alias("n"), F.col(text).alias("text"))
    languages = [r[0] for r in keyed.select("lang").distinct().collect()]
    most = sample_chars(len(languages))
    # A slice keeps SAMPLE_DOCS at most and holds a 64th of a language; only hashes are sorted.
    slices = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    whole = Window.partitionBy("lang").orderBy("h")
    few = keyed.select("lang", "h", "n").distinct().withColumn("r", F.row_number().over(slices)).filter(F.col("r") <= SAMPLE_DOCS)
    chosen = few.withColumn("r", F.row_number().over(whole)).withColumn("upto", F.sum(F.least("n", F.lit(most // DOC_SHARE))).over(whole)).filter((F.col("r") <= SAMPLE_DOCS) & (F.col("upto") <= most))
    beginning = F.when(F.col("n") > most // DOC_SHARE, F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, most // DOC_SHARE)).otherwise(F.col("text"))
    rows = keyed.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", beginning.alias("text")).collect()
    samples: dict[str, list[str]] = {x: [] for x in languages}
    for row in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        if row["lang"] in samples:
            samples[row["lang"]].append(row["text"])
    return fit({k: v for k, v in samples.items() if any(len(symbols(t)) for t in v)})


def identify(docs: DataFrame, models: CharModels, text: str = "text") -> DataFrame:
    """``doc`` (the whole row), ``lang_pred``, ``score`` (the language's posterior at even priors,
    0 to 1), ``bits`` (its cross-entropy a symbol) and ``rejected``.

    Null text and text without a letter are "und" with score 0 and not rejected; so is every text
    if nothing was learned. Ties go to the language first in order. Whole texts are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            bits, rejected = np.full(n, np.nan), np.zeros(n, bool)
            for low, high in slices([len(x.as_buffer() or b"") for x in batch.column(1)], CHUNK_BYTES):
                codes = {i: c for i in range(low, high) if len(c := symbols(batch.column(1)[i].as_py() or ""))}
                rows = list(codes)
                if not rows or not m.languages:
                    continue
                # Texts follow each other with a whole context of edges between them.
                sizes = np.array([len(codes[i]) for i in rows])
                joined = np.concatenate([np.concatenate([codes[i], np.zeros(ORDER - 2, np.uint64)]) for i in rows])
                per, which = m.log_probabilities(joined[: len(joined) - (ORDER - 2)])
                starts = np.cumsum(sizes + ORDER - 2) - (sizes + ORDER - 2)
                for i, at, size in zip(rows, starts, sizes, strict=True):
                    own = which[at : at + size - 1]
                    sums = np.bincount(own, minlength=0) if size > 4 * len(per) else None
                    total = sums @ per[: len(sums)] if sums is not None else per[own].sum(axis=0)
                    best = int(np.argmin(total))
                    gap = np.clip(total - total[best], 0, 1000)
                    pred[i], score[i] = m.languages[best], 1 / np.sum(2.0**-gap)
                    bits[i] = total[best] / max(size - 1, 1)
                    rejected[i] = bits[i] > m.limits[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits)), pa.array(rejected)],
                names=["doc", "lang_pred", "score", "bits", "rejected"],
            )

    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc {docs.schema.simpleString()}, lang_pred string, score double, bits double, rejected boolean")
