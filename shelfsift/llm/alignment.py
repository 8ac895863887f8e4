"""Alignment of two tokenizers' tokens over the same bytes.

Both token sequences of a text are arrays of byte ends. While the two agree at the current index
shift, exponential probing compares slices of the end arrays, so a stretch of one-to-one tokens is
jumped over in a logarithmic number of comparisons. Where they disagree, the irregular group is
walked token by token until both end at the same byte; its sides give the new shift.

How many documents hold an id pair linked is a count over the whole corpus. Texts are aligned in
blocks of bounded size that number their own pairs; a block sends each of its pairs once, however
many documents hold it, and gets the pair's count back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
#: Bytes of texts in a block (one longer text is a block of its own) and in what is aligned at once.
BLOCK_BYTES = 8_000_000
SLICE_BYTES = 1_000_000
#: What a row costs besides its text.
ROW_BYTES = 64
#: Fixed value: how byte-level files with use_regex cut texts before merging.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters beyond these may be classed differently by two versions of Unicode.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: Pairs in a row of a block's list of them.
CHUNK = 8192


@dataclass(frozen=True)
class Alignment:
    """``group_a`` and ``group_b``: index after the last token of each group. ``link_a`` and
    ``link_b``: indexes of the two tokens of each link."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Of two strictly growing arrays that end at the same byte."""
    raw_a, raw_b = ends_a.astype(np.int64).tobytes(), ends_b.astype(np.int64).tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n_a, n_b = len(list_a), len(list_b)
    runs_at: list[int] = []
    runs_to: list[int] = []
    runs_long: list[int] = []
    stops: list[int] = []
    odd_a: list[int] = []
    odd_b: list[int] = []
    i = j = 0
    while i < n_a:
        if list_a[i] == list_b[j]:
            # Twice as many tokens at each probe that holds, then half as many again.
            most, long, step = min(n_a - i, n_b - j), 1, 2
            at, to = 8 * i, 8 * j
            while long + step <= most and raw_a[at + 8 * long : at + 8 * (long + step)] == raw_b[to + 8 * long : to + 8 * (long + step)]:
                long += step
                step *= 2
            while step:
                if long + step <= most and raw_a[at + 8 * long : at + 8 * (long + step)] == raw_b[to + 8 * long : to + 8 * (long + step)]:
                    long += step
                step >>= 1
            runs_at.append(i)
            runs_to.append(j)
            runs_long.append(long)
            i += long
            j += long
            if i >= n_a:
                break
        end_a, end_b = list_a[i], list_b[j]
        odd_a.append(i)
        odd_b.append(j)
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = list_a[i]
            else:
                j += 1
                end_b = list_b[j]
            odd_a.append(i)
            odd_b.append(j)
        i += 1
        j += 1
        stops.append(i)
        stops.append(j)
    long = np.array(runs_long, np.int64)
    steps = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    one_a, one_b = np.repeat(np.array(runs_at, np.int64), long) + steps, np.repeat(np.array(runs_to, np.int64), long) + steps
    at_end = np.array(stops, np.int64).reshape(-1, 2)
    last_a, last_b = np.zeros(n_a + 1, bool), np.zeros(n_b + 1, bool)
    last_a[one_a + 1] = last_a[at_end[:, 0]] = True
    last_b[one_b + 1] = last_b[at_end[:, 1]] = True
    return Alignment(
        np.flatnonzero(last_a), np.flatnonzero(last_b), np.concatenate([one_a, np.array(odd_a, np.int64)]), np.concatenate([one_b, np.array(odd_b, np.int64)])
    )


class Vocabularies:
    """The two tokenizers and the bytes of their tokens. A is a byte-level file of the tokenizers
    library, B a sentencepiece model with byte fallback that puts a space in front."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        words = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes_a[i] = bytes(byte_of.get(c, 63) for c in word)
        self.fast_a = self._as_ranks(path_a)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            own = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes_b.append(own)
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Decimal ids with what follows them: another id of the group, the other side, another group.
        self.spelt = [f"{i}{mark}" for n, mark in ((len(self.bytes_a), ","), (len(self.bytes_a), "|"), (len(self.bytes_b), ","), (len(self.bytes_b), ";")) for i in range(n)]

    def _as_ranks(self, path: str):
        """The merges of the file as ranks, several times as fast on Latin texts; None if its ids do
        not grow with its merges or it does more than cutting and merging bytes."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [model["vocab"].get(x + y, -1) for x, y in pairs]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not told["normalizer"]
        if not plain or made != sorted(set(made)) or len(model["vocab"]) != 256 + len(made) + sum(t["content"] in model["vocab"] for t in told["added_tokens"]):
            return None
        added = {t["content"] for t in told["added_tokens"]}
        ranks = {self.bytes_a[i]: i for word, i in model["vocab"].items() if word not in added}
        return tiktoken.Encoding("merges", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        if self.fast_a is not None and not _BEYOND_LATIN.search(text):
            return self.fast_a.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) of each text; none where their bytes are not a space and the text."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        own = [k for k, t in enumerate(texts) if t]
        out = [none] * len(texts)
        if not own:
            return out
        for k, b in zip(own, self.b.encode([texts[k] for k in own], num_threads=1), strict=True):
            a = self.encode_a(" " + texts[k])
            whole = b" " + texts[k].encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole:
                out[k] = (np.array(a, np.int64), np.array(b, np.int64))
        return out


@cache
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """One pair a worker process."""
    return Vocabularies(path_a, path_b)


@dataclass
class Slice:
    """Aligned texts: counts by text, groups spelt out, and the distinct pairs of each text, its
    number in the slice in ``owner``, with how often each is linked in it."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    owner: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def align_texts(own: Vocabularies, texts: Sequence[str]) -> Slice:
    """Texts laid end to end are one alignment, since each ends at the same byte on both sides."""
    encoded = own.encode(texts)
    n_a, n_b = (np.array([len(e[side]) for e in encoded], np.int64) for side in (0, 1))
    a, b = (np.concatenate([np.zeros(0, np.int64), *[e[side] for e in encoded]]) for side in (0, 1))
    found = align(np.cumsum(own.lengths_a[a]), np.cumsum(own.lengths_b[b]))
    upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
    n_groups = np.diff(np.searchsorted(found.group_a, upto_a, side="right"), prepend=0)
    # Places of the tokens when each group gives its tokens of A and then those of B.
    in_a, in_b = np.diff(found.group_a, prepend=0), np.diff(found.group_b, prepend=0)
    place_a = np.arange(len(a)) + np.repeat(found.group_b - in_b, in_a)
    place_b = np.arange(len(b)) + np.repeat(found.group_a, in_b)
    codes = np.zeros(len(a) + len(b), np.int64)
    size_a, size_b = len(own.bytes_a), len(own.bytes_b)
    code_a, code_b = a.copy(), b + 2 * size_a
    code_a[found.group_a - 1] += size_a
    code_b[found.group_b - 1] += size_b
    codes[place_a], codes[place_b] = code_a, code_b
    edges = np.concatenate([[0], upto_a + upto_b]).tolist()
    groups = ["".join(map(own.spelt.__getitem__, codes[s:e].tolist()))[:-1] for s, e in zip(edges, edges[1:])]
    # A text's distinct pairs: sort by (text, pair) and count equal neighbours.
    owner = np.searchsorted(upto_a, found.link_a, side="right")
    key = np.sort((owner * size_a + a[found.link_a]) * size_b + b[found.link_b])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    text, pair = np.divmod(key, size_a * size_b)
    return Slice(n_a, n_b, n_groups, groups, text, pair, times)


def _small(values: np.ndarray) -> tuple[bytes, bytes]:
    """One byte a value; those of 255 and more in full behind."""
    return np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype(np.uint32).tobytes()


def _large(small: bytes, rest: bytes) -> np.ndarray:
    values = np.frombuffer(small, np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(rest, np.uint32)
    return values


FACTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
PACKED = ("steps", "far", "times", "more")


def _block(own: Vocabularies, number: int, kept: pa.Array, texts: list[str | None], sizes: list[int]) -> Iterator[tuple[str, pa.Table]]:
    """("text", a row each) and ("pair", the block's distinct pairs)."""
    parts: list[Slice] = []
    bases: list[int] = []
    hashes: list[str] = []
    for start, end in slices(sizes, SLICE_BYTES):
        part = align_texts(own, [t or "" for t in texts[start:end]])
        hashes += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in part.groups]
        part.groups = []
        parts.append(part)
        bases.append(start)
    pair, owner, times = (np.concatenate(x) for x in ([p.pair for p in parts], [p.owner + s for p, s in zip(parts, bases, strict=True)], [p.times for p in parts]))
    code, distinct = pd.factorize(pair)
    held = np.bincount(code, minlength=len(distinct))
    # Pairs that many texts hold get small numbers, so the steps between a text's pairs are short.
    order = np.argsort(-held, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[code]
    by_text = np.argsort(owner * max(len(distinct), 1) + code, kind="stable")
    code, times, edges = code[by_text], times[by_text], np.searchsorted(owner[by_text], np.arange(len(texts) + 1))
    packed: dict[str, list[bytes]] = {n: [] for n in PACKED}
    for s, e in zip(edges.tolist(), edges[1:].tolist()):
        for names, values in ((PACKED[:2], np.diff(code[s:e], prepend=0)), (PACKED[2:], times[s:e])):
            for name, value in zip(names, _small(values), strict=True):
                packed[name].append(value)
    n_a, n_b, n_groups = (np.concatenate([getattr(p, n) for p in parts]) for n in ("n_a", "n_b", "n_groups"))
    facts = [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_a + n_b - n_groups), pa.array(hashes, pa.string())]
    yield "text", pa.table([pa.array([number] * len(texts), pa.int64()), kept, *facts, *[pa.array(packed[n], pa.binary()) for n in PACKED]], names=["block", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *PACKED])
    chunks = range(0, len(order), CHUNK)
    listed = [distinct[order][c : c + CHUNK] for c in chunks]
    counts = [held[order][c : c + CHUNK] for c in chunks]
    yield "pair", pa.table([
        pa.array([number] * len(chunks), pa.int64()), pa.array(list(chunks), pa.int64()),
        pa.array(listed, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())),
    ], names=["block", "first", "pairs", "held"])


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, text: str, carry: Sequence[str] | None) -> DataFrame:
    """Rows of texts and rows of their blocks' pairs, written once."""
    kept = F.struct(*[F.col(c) for c in (docs.columns if carry is None else carry)]).alias("doc")
    rows = docs.select(kept, F.try_validate_utf8(F.col(text)).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"block bigint, doc {kind}, {FACTS}, {', '.join(n + ' binary' for n in PACKED)}, first bigint, pairs array<bigint>, held array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        names = None
        for batch in batches:
            column = batch.column(1)
            sizes = [ROW_BYTES + (n or 0) for n in pc.binary_length(column).to_pylist()]
            for start, end in slices(sizes, BLOCK_BYTES):
                texts, kept = column[start:end].to_pylist(), batch.column(0)[start:end]
                for _, table in _block(own, number, kept, texts, sizes[start:end]):
                    if names is None:
                        empty = {"first": pa.int64(), "pairs": pa.list_(pa.int64()), "held": pa.list_(pa.int64())}
                        names = pa.schema([*table.schema, *[pa.field(n, t) for n, t in empty.items()]])
                    filled = [table[f.name].combine_chunks() if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in names]
                    yield from pa.table(filled, schema=names).to_batches()
                number += 1

    return written(rows.mapInArrow(run, schema), "aligned")


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best) of the corpus: in how many texts a pair is linked, and whether no other
    pair of its id of A has a higher count. An id of A has at most as many pairs as B has ids."""
    listed = blocks.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("_e"))
    counts = listed.groupBy(F.col("_e.pairs").alias("pair")).agg(F.sum("_e.held").alias("count"))
    by_a = Window.partitionBy(F.floor(F.col("pair") / size_b))
    return counts.withColumn("best", F.col("count") == F.max("count").over(by_a))


def cross_align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``doc`` (the columns of ``carry``, all by default) with n_a, n_b, n_groups, n_links,
    groups_sha256, n_best and count_sum.

    Texts that are null, empty, not valid UTF-8, or not spelt out by either tokenizer have zeros
    and an empty digest. Each row counts as a document of its own, repeated rows and ids included.
    Empty tables give no rows.
    """
    import sentencepiece

    blocks = aligned_blocks(docs, path_a, path_b, text, carry)
    counts = pair_counts(blocks, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size())
    asked = blocks.filter("pairs IS NOT NULL").select("block", "first", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select(F.col("block").alias("to_block"), (F.col("first") + F.col("at")).alias("code"), "count", "best")
    texts = blocks.filter("pairs IS NULL").drop("first", "pairs", "held")
    kind = texts.schema["doc"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        code = right["code"].to_numpy()
        count[code], best[code] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        n_best, count_sum = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        columns = [left[n].to_pylist() for n in PACKED]
        for k, (steps, far, times, more) in enumerate(zip(*columns, strict=True)):
            if steps:
                own, often = np.cumsum(_large(steps, far)), _large(times, more)
                n_best[k], count_sum[k] = best[own] @ often, count[own] @ often
        kept = left.select(["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))

    return texts.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(run, f"doc {kind}, {FACTS}, n_best bigint, count_sum bigint")
