"""Token store and packing: same ids as the tokenizers library, exact round trips."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfsift.llm.common import scratch_path
from shelfsift.llm.packing import cut_lengths, pack
from shelfsift.llm.token_store import Codes, pack_codes, read_tokens, token_at, write_tokens
from shelfsift.llm.tokens import PieceEncoder

P = pytest.importorskip("public_tokenizers")
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def plain(file):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(file))
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("file", FILES)
def test_ids_of_pieces_are_those_of_whole_texts(file):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", " ", "a", "Été", "é", "é", "́", "'s", "'S", "don't", "12", "٣", ".", ",", "...", "中文", "ΑΣ", "İ", "straße", "\x1c", "\x85", "😀", "<|endoftext|>", "of.", "it,", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    ids, n = PieceEncoder(P.path(file)).encode(texts)
    got = np.split(ids, np.cumsum(n)[:-1])
    assert [x.tolist() for x in got] == plain(file)(texts)


def test_encoder_forgets_rare_pieces_and_keeps_common_ones():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    encoder, ids_of = PieceEncoder(P.path("byte_bpe_50k.json")), plain("byte_bpe_50k.json")
    for _ in range(3):
        texts = [" ".join(["often"] * 3 + [word() for _ in range(60_000)]), "whole\x00" + word() * 5000]
        ids, n = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == ids_of(texts)
        encoder.forget()
        assert " often" in encoder.known and len(encoder.known) < 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip_and_random_access(values):
    codes = Codes(pack_codes(np.array(values, np.uint32)))
    assert codes.all().tolist() == values
    assert [codes[i] for i in range(0, len(values), 7)] == values[::7]


def test_codes_rank_over_many_groups():
    values = np.random.default_rng(2).integers(0, 50_000, 5000).astype(np.uint32)
    codes = Codes(pack_codes(values))
    assert [codes[i] for i in range(5000)] == values.tolist()
    with pytest.raises(IndexError):
        codes[5000]


def expected_ids(rows, file):
    return [x + [1] for x in plain(file)([r[1] or "" for r in rows])]


def test_store_holds_all_ids_in_order(spark, edge, edge_rows):
    path = scratch_path(spark, "store")
    write_tokens(edge, path, P.path(FILES[0]), 1)
    rows = read_tokens(spark, path).orderBy("start").collect()
    ids = defaultdict(list)
    for r, x in zip(edge_rows, expected_ids(edge_rows, FILES[0]), strict=True):
        ids[r[0]].append(x)
    at, order = 0, []
    for r in rows:
        own = list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids)))
        assert r.start == at and own in ids[r.doc_id]
        at += r.n_tokens
        order.append(-(2**63) if r.doc_id is None else r.doc_id)
    assert order == sorted(order) and len(rows) == len(edge_rows)
    whole = [t for r in rows for t in struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))]
    asked = spark.createDataFrame([(p,) for p in [0, 5, 17, at - 1, at, -1]], "position long")
    assert {r.position: r.token for r in token_at(spark, path, asked).collect()} == {p: whole[p] if 0 <= p < at else None for p in [0, 5, 17, at - 1, at, -1]}


def test_store_of_nothing(spark, empty):
    path = scratch_path(spark, "store")
    write_tokens(empty, path, P.path(FILES[0]), 1)
    assert read_tokens(spark, path).count() == 0


def check_packing(pieces, rows, capacity):
    ids = defaultdict(list)
    for r, x in zip(rows, expected_ids(rows, FILES[1]), strict=True):
        ids[r[0]].append(x)
    sequences, covered = defaultdict(list), defaultdict(int)
    for p in pieces:
        own = list(struct.unpack(f"<{p.length}I", bytes(p.ids)))
        assert any(x[p.start : p.start + p.length] == own and len(x) == p.doc_tokens for x in ids[p.doc_id])
        sequences[p.sequence_id].append((p.offset, p.length))
        covered[p.doc_id] += p.length
    assert covered == {d: sum(map(len, x)) for d, x in ids.items()}
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding / sum(covered.values())


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_exact_and_tight(edge, edge_rows, capacity):
    pieces = pack(edge, P.path(FILES[1]), 1, capacity=capacity).collect()
    assert check_packing(pieces, edge_rows, capacity) < 0.02


def test_packing_digests_of_cut_pieces(make):
    rows = [(i, "word " * (i * 7 % 90), "en", "a") for i in range(60)]
    pieces = pack(make(rows), P.path(FILES[1]), 1, keep=lambda c: F.struct(c.alias("ids"), F.crc32(c).alias("crc")).alias("both")).collect()
    assert all(zlib.crc32(bytes(p.both.ids)) == p.both.crc and len(p.both.ids) == 4 * p.length for p in pieces)


def test_packing_of_nothing(empty):
    assert pack(empty, P.path(FILES[1]), 1).count() == 0


@given(st.integers(1, 2047))
def test_cuts_keep_all_ids_and_fit_their_class(n):
    pieces = cut_lengths(n)
    assert sum(length for _, length in pieces) == n
    assert all(0 <= 2048 - j * length <= 2048 / 128 for j, length in pieces)


def test_packing_encodes_small_groups(monkeypatch):
    """Pipeline of round 3: a worker held all texts of a batch, and the pieces of 1.5 million characters, as objects."""
    import pyarrow as pa

    from shelfsift.llm import packing

    seen = []

    class Counted:
        def encode(self, texts):
            seen.append(sum(map(len, texts)))
            return np.zeros(len(texts), np.uint32), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "encoder", lambda vocabulary: Counted())
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(["é" * 1000] * 1200)], names=["d", "t"])
    out = list(packing._cut_partition("any", 1, packing.CAPACITY, packing.SLACK)(iter([batch])))
    assert sum(seen) == 1_200_000 and max(seen) <= 401_000
    assert [d for b in out for d in b.column(3).to_pylist()][-1] == 1199
