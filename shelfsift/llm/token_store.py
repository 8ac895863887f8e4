"""Token ids as directly addressable codes.

A block of ids is split into levels of ``chunk_bits`` bits, lowest bits first. Every id has a
chunk in level 0; a set bit in the level's continuation bitmap says that the id goes on in the
next level, at the place given by the rank of that bit. A rank directory holds the number of set
bits before each group of ``RANK_EVERY``, so any id is read with one directory entry and one
popcount a level, without decoding its block.

Payload of a block, little endian: ``MAGIC``, then uint32 chunk bits, levels and ids; a level is
uint32 lengths of its chunks, bitmap and directory in bytes, followed by the three.
Chunks are 8 bits wide here, so a chunk is a byte.

The container is a Parquet table written by Spark (commits whole tasks, on any store): one row a
block with its part and number, document ids, id counts, and the payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back
from .tokens import encoder, forget_rare, groups

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_EVERY = 512
#: A block is closed at the document that fills it.
BLOCK_IDS = 1 << 20

STORE_SCHEMA = "part long, block long, n_docs long, n_ids long, first_doc_id long, last_doc_id long, doc_ids binary, doc_known binary, doc_tokens binary, payload binary"


def pack_codes(ids: np.ndarray) -> bytes:
    """The payload of a block."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        going = more > 0
        bits = np.packbits(going, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(going[: len(going) // RANK_EVERY * RANK_EVERY].reshape(-1, RANK_EVERY).sum(axis=1))])
        levels.append(((rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ones.astype("<u4").tobytes()))
        rest = more[going]
        if not len(rest):
            break
    head = MAGIC + struct.pack("<III", CHUNK_BITS, len(levels), len(ids))
    return head + b"".join(struct.pack("<III", *map(len, parts)) + b"".join(parts) for parts in levels)


class Codes:
    """Reader of one payload: ``codes[i]`` is one id, ``codes.all()`` all of them."""

    def __init__(self, payload: bytes):
        view = memoryview(payload)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.bits, count, self.size = struct.unpack_from("<III", view, 4)
        self.levels, at = [], 16
        for _ in range(count):
            lengths = struct.unpack_from("<III", view, at)
            at += 12
            parts = []
            for length, kind in zip(lengths, (np.uint8, np.uint8, np.dtype("<u4")), strict=True):
                parts.append(np.frombuffer(view[at : at + length], kind))
                at += length
            self.levels.append(tuple(parts))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            group = i // RANK_EVERY
            part = int.from_bytes(bitmap[group * RANK_EVERY // 8 : (i >> 3) + 1].tobytes(), "little")
            i = int(ranks[group]) + (part & ((1 << (i - group * RANK_EVERY)) - 1)).bit_count()
            shift += self.bits
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        going, values = np.arange(self.size), np.zeros(self.size, np.uint32)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            values[going] |= chunks.astype(np.uint32) << np.uint32(self.bits * level)
            going = going[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return values


def _pack_partition(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            known = np.array([d is not None for d in docs], np.uint8)
            ids = np.concatenate(held)
            row = {
                "part": part, "block": block, "n_docs": len(docs), "n_ids": len(ids), "first_doc_id": docs[0], "last_doc_id": docs[-1],
                "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_known": known.tobytes(),
                "doc_tokens": np.concatenate(counts).astype("<i8").tobytes(), "payload": pack_codes(ids),
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in groups(texts.to_pylist()):
                flat, n = encode(texts[low:high].to_pylist())
                held.append(np.insert(flat, np.cumsum(n), end_id).astype(np.uint32))
                counts.append(n + 1)
                docs += doc_ids[low:high]
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield close()
                    block, docs, counts, held, size = block + 1, [], [], [], 0
        if docs:
            yield close()
        forget_rare()
        give_back()

    return run


_ARROW = pa.schema(
    [(n, pa.binary() if k == "binary" else pa.int64()) for n, k in (c.split() for c in STORE_SCHEMA.split(", "))]
)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the blocks to ``path``.

    Documents are range-partitioned by id and sorted, so parts and blocks follow ascending ids;
    a null id comes first. Documents with equal ids stay next to each other. An empty table gives
    an empty store. Other columns are not read.
    """
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        .repartitionByRange("d")
        .sortWithinPartitions("d")
    )
    ordered.mapInArrow(_pack_partition(vocabulary, end_id), STORE_SCHEMA).write.parquet(path)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, block_start): ids in front of each block. Sums inside a part first, so no
    task sees more than the blocks of one part or one row a part."""
    blocks = spark.read.schema(STORE_SCHEMA).parquet(path).select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("front"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return placed.join(parts, "part").select("part", "block", (F.col("front") + F.col("inner")).alias("block_start"))


def _read_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Codes(row["payload"]).all().astype("<u4")
            doc_ids, known = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_known"], np.uint8)
            n = np.frombuffer(row["doc_tokens"], "<i8")
            ends = np.cumsum(n)
            offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i4").tobytes())
            cells = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), row["part"])), pa.array(np.full(len(n), row["block"])),
                    pa.array(doc_ids, mask=known == 0), pa.array(ends - n), pa.array(n), cells,
                ],
                names=["part", "block", "doc_id", "inner_start", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents in front), n_tokens, and ids as little-endian uint32."""
    stored = spark.read.schema(STORE_SCHEMA).parquet(path).select("part", "block", "doc_ids", "doc_known", "doc_tokens", "payload")
    rows = stored.mapInArrow(_read_partition, "part long, block long, doc_id long, inner_start long, n_tokens long, ids binary")
    return rows.join(block_starts(spark, path), ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("inner_start")).alias("start"), "n_tokens", "ids"
    )


def token_at(spark: SparkSession, path: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """The id at each asked position of the store (null outside of it), read by rank without
    decoding a block. Positions meet their block by equality on a grid no block is shorter than
    the gaps of: each block is listed under every grid cell it touches."""
    cell = BLOCK_IDS
    spans = block_starts(spark, path).join(spark.read.schema(STORE_SCHEMA).parquet(path), ["part", "block"]).select(
        "block_start", "n_ids", "payload", F.explode(F.sequence(F.floor(F.col("block_start") / cell), F.floor((F.col("block_start") + F.col("n_ids") - 1) / cell))).alias("cell")
    )
    asked = positions.select(F.col(position).cast("long").alias("position")).withColumn("cell", F.floor(F.col("position") / cell))
    inside = (F.col("position") >= F.col("block_start")) & (F.col("position") < F.col("block_start") + F.col("n_ids"))
    met = asked.join(spans, "cell").filter(inside).select("position", (F.col("position") - F.col("block_start")).alias("at"), "payload")

    def look(batches):
        for batch in batches:
            at, payloads = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([Codes(p)[i] for i, p in zip(at, payloads, strict=True)], pa.int64())], names=["position", "token"]
            )

    found = met.mapInArrow(look, "position long, token long")
    return asked.select("position").join(found.dropDuplicates(["position"]), "position", "left")
