"""Language-model scores of texts from a weighted backoff automaton over the whole corpus.

The smoothed n-grams of one to ORDER words become states and arcs. A state is a run of up to
ORDER - 1 words that was seen, beginning at the start of the text or later; the root is the empty
one. The arc of word w from state h leads to the longest state that h w ends with and weighs

    P(w | h) = (c(h w) + MU P(w | h')) / (c(h) + MU)

where h' is h without its first word. A word without an arc from h takes h's failure arc, which leads
to h' at the weight MU / (c(h) + MU). The root gives a known word (c(w) - D) / N, and all that was
discounted, D V / N, to the one unknown word, with D = n1 / (n1 + 2 n2) from the numbers of words
seen once and twice. A text is read once from left to right: the state is carried along and the
weights of the arcs taken, failure arcs too, are added up. Long texts are read in lanes of LANE
words, side by side; ORDER - 1 words in front of a lane lead from the root to its first state, since
no state remembers more.

Counts are never gathered in one place. Documents lie in blocks; a block asks for the counts of
its own distinct n-grams, and brings its training counts along. Questions are dealt to buckets by
hash range, a bucket adds up what all blocks bring and answers each block in the order it asked.
So a bucket gets an n-gram at most once a block, however frequent it is, and a block holds the
part of the automaton that its texts can reach. N, V, n1 and n2 come as one small part with each
answer. n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

ORDER, MU = 3, 30.0
#: Words that a lane of the traversal reads.
LANE = 512
#: Text bytes of a block and of a bucket's share, on average.
BLOCK_BYTES = 20 << 20
SLICE_BYTES = 2 << 20

# Any fixed values: the end of a text as a word, the start as a state.
END, START = np.uint64(0x5AFE0B57AC1E0E4D), np.uint64(0x1F3A9C58E2D7B604)
_LEFT, _RIGHT, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of all texts, each text closed by END, and where each text ends. Words of
    about SLICE_BYTES of text are held as such at once."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in slices([len(t) for t in texts], SLICE_BYTES):
        split = [t.lower().split() for t in texts[low:high]]  # bytes: lowers A-Z alone, splits at ASCII white space
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        words = hashes[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))] if flat else np.zeros(0, np.uint64)
        parts.append(np.insert(words, np.cumsum(lengths), END))
        counts.append(lengths + 1)
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def grams_of(words: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order`` the 64-bit codes of the n-grams that end at each word. The start
    of a text counts as a word in front of it; where an n-gram would reach beyond, its code is 0."""
    place = np.arange(len(words)) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0))
    codes = [words]
    for k in range(2, order + 1):
        front = np.empty_like(words)
        front[1:] = codes[-1][:-1]
        if k == 2:
            front[place == 0] = START
        code = front * _LEFT + (words ^ (words >> np.uint64(31))) * _RIGHT
        code ^= code >> np.uint64(33)
        code *= _STIR
        code ^= code >> np.uint64(29)
        code[place < k - 2] = 0
        codes.append(code)
    return codes


def _pack(*columns: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob) if n else b"", 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind))
        at += size
    return out


def _cells(table: pa.Table, text: str) -> list[bytes]:
    """UTF-8 texts of the rows carried in ``doc``; null is empty."""
    return [b for chunk in table.column("doc").chunks for x in chunk.field(text).cast(pa.large_binary()) for b in (x.as_py() or b"",)]


def _schema(columns) -> pa.Schema:
    return pa.schema([(c, pa.binary() if c[:4] == "blob" else pa.int64()) for c in columns])


def _parts(order: int) -> str:
    return ", ".join(f"n_{k} long, blob_{k} binary" for k in range(1, order + 1))


def _ask(buckets: int, text: str, order: int):
    """Questions of a block: for each bucket the keys in its range, with the block's own counts."""

    def run(table: pa.Table) -> pa.Table:
        words, ends = tokens_of(_cells(table, text))
        learn = np.repeat(table.column("learn").to_numpy(), np.diff(ends, prepend=0))
        rows: dict[str, list] = {"bucket": list(range(buckets)), "block": [table.column("block")[0].as_py()] * buckets}
        for k, codes in enumerate(grams_of(words, ends, order), 1):
            keys = np.unique(codes)
            counts = np.zeros(len(keys), np.uint32)
            seen, n = np.unique(codes[learn], return_counts=True)
            counts[np.searchsorted(keys, seen)] = n
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows[f"n_{k}"] = np.diff(edges).tolist()
            rows[f"blob_{k}"] = [
                _pack(np.diff(keys[low:high], prepend=np.uint64(0)), counts[low:high]) if high > low else b"" for low, high in zip(edges[:-1], edges[1:], strict=True)
            ]
        return pa.table(rows, schema=_schema(rows))

    return lean(run)


STATS = ("tokens", "known", "once", "twice")


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total of each place's key, totals of the distinct keys). ``keys`` are sorted runs, one a block,
    which a stable sort merges."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    line = np.argsort(keys, kind="stable")
    ordered = keys[line]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    sums = np.add.reduceat(counts[line].astype(np.uint64), np.flatnonzero(new))
    total = np.empty(len(keys), np.uint64)
    total[line] = sums[np.cumsum(new) - 1]
    return total, sums


def _answer(order: int):
    """Adds up a bucket's counts and sends every block those it asked for."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, object] = {"block": table.column("block"), "bucket": table.column("bucket")}
        for k in range(1, order + 1):
            lengths = table.column(f"n_{k}").to_pylist()
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
            for blob, n in zip(table.column(f"blob_{k}"), lengths, strict=True):
                gaps, own = _unpack(blob.as_py(), n, "<u8", "<u4")
                keys.append(np.cumsum(gaps, dtype=np.uint64))
                counts.append(own)
            total, sums = _totals(np.concatenate(keys), np.concatenate(counts))
            ends = np.cumsum(lengths)
            out[f"n_{k}"] = lengths
            out[f"blob_{k}"] = [_pack(total[e - n : e]) if n else b"" for n, e in zip(lengths, ends, strict=True)]
            if k == 1:
                stats = [int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())]
        for name, value in zip(STATS, stats, strict=True):
            out[name] = [value] * table.num_rows
        return pa.table(out, schema=_schema(out))

    return lean(run)


class BackoffAutomaton:
    """The states and arcs that a set of texts can reach, with weights as log10.

    ``codes`` are the texts' n-grams (``grams_of``), ``counts`` those of the sorted distinct ones of
    each length. ``number[k][i]`` is the n-gram of k + 1 words that ends at word i: as an arc, the one
    that word i takes from the state of k words in front of it; as a state, the one it may lead to.
    """

    def __init__(self, codes: list[np.ndarray], counts: list[np.ndarray], ends: np.ndarray, totals: tuple[int, int, int, int], texts_learned: float, mu: float = MU):
        self.order, self.ends, self.begins = len(codes), ends, ends - np.diff(ends, prepend=0)
        self.number, self.seen, self.weight, self.failure = [], [], [], []
        n, v, once, twice = totals
        self.starts = np.zeros(len(codes[0]), bool)
        self.starts[self.begins[self.ends > self.begins]] = True
        below = front = None
        for k, code in enumerate(codes):
            keys, number = np.unique(code, return_inverse=True)
            number = number.astype(np.int32)
            c = counts[k].astype(float)
            if k == 0:
                discount = once / (once + 2 * twice) if once else 0.5
                unknown = discount * v / n if n else 1.0
                p = np.where(c > 0, (c - discount) / max(n, 1), unknown)
                p = np.where(p > 0, p, 0.5 / max(n, 1))  # every word is seen once: D = 1
            else:
                where = np.zeros(len(keys), np.int64)
                where[number] = np.arange(len(number))  # some place of each
                of_state = front[self._in_front(k, where)]
                p = (c + mu * below[self.number[k - 1][where]]) / (of_state + mu)
            self.number.append(number)
            self.seen.append(c > 0)
            self.weight.append(np.log10(p))
            below = p
            # The last state of one word is the start of a text.
            front = np.append(c, texts_learned) if k == 0 else c
            if k + 1 < self.order:
                self.failure.append(np.log10(mu / (front + mu)))

    def _in_front(self, k: int, at: np.ndarray) -> np.ndarray:
        """The state of k words in front of each place."""
        state = self.number[k - 1][at - 1]
        return np.where(self.starts[at], len(self.seen[0]), state) if k == 1 else state

    def read(self, lane: int | None = None) -> np.ndarray:
        """log10 probability of each text, by one traversal of all lanes."""
        lane, most = lane or LANE, self.order - 1
        lanes = -(-(self.ends - self.begins) // lane)
        text = np.repeat(np.arange(len(lanes)), lanes)
        first = self.begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        last = np.minimum(first + lane, self.ends[text])
        enter = np.maximum(first - most, self.begins[text])
        line = np.argsort(enter - last, kind="stable")  # the longest first
        text, first, last, enter = text[line], first[line], last[line], enter[line]
        # The words a state holds; with the place they end at, that is the state.
        held = (enter == self.begins[text]).astype(np.int8)
        total, reads = np.zeros(len(text)), last - enter
        for step in range(int(reads[0]) if len(reads) else 0):
            n = len(reads) - np.searchsorted(reads[::-1], step, "right")  # lanes that still read
            at, state = enter[:n] + step, held[:n]
            to, gained = np.zeros(n, np.int8), np.zeros(n)
            for k in range(most, -1, -1):
                here = np.flatnonzero(state == k)
                arc = self.number[k][at[here]]
                if k == 0:
                    gained[here] += self.weight[0][arc]
                    to[here] = self.seen[0][arc]
                    continue
                there = self.seen[k][arc]
                gained[here[there]] += self.weight[k][arc[there]]
                to[here[there]] = min(k + 1, most)
                fails = here[~there]
                gained[fails] += self.failure[k - 1][self._in_front(k, at[fails])]
                state[fails] = k - 1
            held[:n] = to
            total[:n] += np.where(at >= first[:n], gained, 0.0)
        return np.bincount(text, total, len(lanes))


def _score(mu: float, text: str, order: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, ends = tokens_of(_cells(texts, text))
        codes = grams_of(words, ends, order)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        counts = [np.concatenate([_unpack(r[f"blob_{k}"], r[f"n_{k}"], "<u8")[0] for r in rows] or [np.zeros(0)]) for k in range(1, order + 1)]
        totals = tuple(sum(r[c] for r in rows) for c in STATS)
        n, v = totals[:2]
        # As many texts begin as end; every text holds END, so its count is always among the answers.
        texts_learned = float(counts[0][np.searchsorted(np.unique(words), END)]) if len(words) else 0.0
        automaton = BackoffAutomaton(codes, counts, ends, totals, texts_learned, mu)
        c = counts[0][automaton.number[0]].astype(float)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        add = lambda x: np.add.reduceat(x, automaton.begins) if len(ends) else x[:0]  # noqa: E731  no text is without END
        return pa.table({
            "doc": texts.column("doc"), "n_tokens": pa.array(np.diff(ends, prepend=0)), "n_known": pa.array(add((c > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(ends), n, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(automaton.read()),
        })

    return lean(run)


def score(docs: DataFrame, learn: Column, text: str = "text", mu: float = MU, order: int = ORDER) -> DataFrame:
    """``doc`` (the whole row) with n_tokens, n_known, train_tokens, base_score and score; ``order`` is at
    least two words.

    Learns from the rows for which ``learn`` holds (a null counts as no), scores all of them, in
    whole texts. Null and empty texts are one end. Repeated rows count as often as they come.
    Without training rows every word is the unknown one and scores 0. An empty table gives an
    empty result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"), F.coalesce(learn, F.lit(False)).alias("learn"))
    total = own.agg(F.sum(F.length("bytes"))).first()[0] or 0
    n = max(parts, total // BLOCK_BYTES + 1)
    # Rows spread by their text, with a salt by id, so many copies of one text do not meet.
    salt = F.xxhash64("bytes", *[F.col("doc")[c].cast("string") for c, kind in docs.dtypes if kind in ("bigint", "int", "string") and c != text])
    blocked = own.withColumn("block", F.pmod(salt, F.lit(n))).drop("bytes").repartition(n, "block")
    questions = blocked.groupBy("block").applyInArrow(_ask(n, text, order), f"bucket long, block long, {_parts(order)}")
    answers = questions.groupBy("bucket").applyInArrow(_answer(order), f"block long, bucket long, {_parts(order)}, {', '.join(f'{c} long' for c in STATS)}")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(mu, text, order), f"doc {docs.schema.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
