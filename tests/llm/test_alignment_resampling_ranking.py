import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfsift.llm import alignment, quality_ranking, resampling
from shelfsift.llm.queries import vocabulary

# ---- op11 ---------------------------------------------------------------------------------------


def _runs(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _expected(rows, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, aim = Counter(), Counter()
    for _, text in rows:
        own.update(map(bucket, _runs(text)[1]))
    for text in target:
        aim.update(map(bucket, _runs(text)[1]))
    s, t = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, runs = _runs(text)
        weight = sum(gain[bucket(f)] for f in runs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(runs), weight, score, None, len(words)])
    fits = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(fits[: percent * len(fits) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def _resampled(docs, target, **options):
    found = resampling.resample(docs, target, carry=["doc_id"], **options)
    return sorted(map(tuple, found.select("doc.doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def _benchmark(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def test_resampling_is_the_brute_force_one(spark, make, edge_rows):
    rng = random.Random(3)
    words = ["Alpha", "beta9", "épée", "x", "日本", "gamma", "mu"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en", "a") for k in range(200, 320)]
    rows += edge_rows + [(k, "w" * 200 + " " + "v" * 5000 + " tail w w", "en", "a") for k in (900, 901)]
    target = ["Alpha beta9 x", "gamma gamma épée", None, "", "w" * 200 + " " + "v" * 5000]
    plain = [(r[0], r[1]) for r in rows]
    assert _resampled(make(rows), _benchmark(spark, target), percent=30) == _expected(plain, target, percent=30)
    assert _resampled(make(rows), _benchmark(spark, target), percent=100) == _expected(plain, target, percent=100)


def test_resampling_with_ties_and_repeated_rows(spark, make):
    """Rows alike in all that counts share the drawn places, also where ids are null."""
    text = " ".join(["alpha", "beta", "gamma"] * 10)
    rows = [(None, text, "en", "a")] * 30 + [(7, text, "en", "a")] * 30 + [(8, text + " more", "en", "a")] * 3
    for percent in (5, 40, 60):
        assert _resampled(make(rows), _benchmark(spark, ["alpha beta"]), percent=percent) == _expected([(r[0], r[1]) for r in rows], ["alpha beta"], percent=percent)


def test_resampling_of_empty_tables(spark, make, empty):
    assert _resampled(empty, _benchmark(spark, ["a b"])) == []
    rows = [(1, "one two three", "en", "a"), (2, None, "en", "a")]
    assert _resampled(make(rows), _benchmark(spark, [])) == _expected([(r[0], r[1]) for r in rows], [])


def test_all_columns_stay_under_doc(spark, edge):
    found = resampling.resample(edge.withColumns({"score": F.lit(1), "rank": F.lit("r"), "_row": F.lit(2)}), _benchmark(spark, ["a"]))
    assert set(edge.columns) <= set(found.schema["doc"].dataType.names) and found.count() == edge.count()


def test_checksums_combine():
    rng = np.random.default_rng(1)
    for a, b in ((0, 1), (3, 63), (5, 64), (2, 65), (7, 1000), (9, 100_003)):
        x, y = rng.bytes(a), rng.bytes(b)
        moved = resampling.moved(np.array([zlib.crc32(x)], np.uint32), np.array([b]))
        assert int(moved[0]) ^ zlib.crc32(y) == zlib.crc32(x + y)


@pytest.mark.parametrize("wanted", [1, 50, 499, 999, 1000])
def test_a_bracket_that_does_not_hold_is_widened(spark, wanted):
    """The share told to the sketch is far off, so its bracket has to be widened."""
    rows = spark.range(1000).select((F.col("id") % 700).alias("score"))
    found = resampling.bracket(rows, wanted, 0.2, accuracy=100)
    scores = sorted((k % 700 for k in range(1000)), reverse=True)
    above = [s for s in scores if found.high is not None and s > found.high]
    within = [s for s in scores if (found.high is None or s <= found.high) and (found.low is None or s >= found.low)]
    assert (len(above), len(within)) == (found.above, found.within)
    assert found.above < wanted <= found.above + found.within
    assert scores[wanted - 1] in within


def test_a_bracket_is_small_where_the_sketch_is_right(spark):
    found = resampling.bracket(spark.range(100_000).select(F.col("id").alias("score")), 5000, 0.05)
    assert found.rounds == 1 and found.within < 200


# ---- op12 ---------------------------------------------------------------------------------------

SPECIAL = ["a<|endoftext|>b", "<s> hi</s> <0x41>", "two  spaces   three", " lead", "tail ", "\n\tx\n\n y", "▁ block", "naïve café — 😀👍🏽", "日本語のテキスト", "\x00nul", "1234567890 12.5", "don't I'll", "   ", "é ﬁ ½"]


def _brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    spell = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in spell} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in spell)}
    facts, links = [], []
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False) if text else None
        b = b_model.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in t) for t in a.tokens] if a else []
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            facts.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = lambda parts: list(np.cumsum([len(p) for p in parts]))
        ea, eb = ends(bytes_a), ends(bytes_b)
        ga, gb, groups = [], [], []
        common, i, j = sorted(set(ea) & set(eb)), 0, 0
        for stop in common:
            ga, gb = [], []
            while i < len(ea) and ea[i] <= stop:
                ga.append(a.ids[i])
                i += 1
            while j < len(eb) and eb[j] <= stop:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        own = [(a.ids[x], b[y]) for x in range(len(ea)) for y in range(len(eb)) if max(ea[x] - len(bytes_a[x]), eb[y] - len(bytes_b[y])) < min(ea[x], eb[y])]
        facts.append((len(ea), len(eb), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = Counter(p for own in links for p in set(own))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(*f, sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own)) for f, own in zip(facts, links, strict=True)]


def _aligned(docs):
    found = alignment.cross_align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), carry=["doc_id"])
    return sorted(map(tuple, found.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=repr)


def test_alignment_is_the_brute_force_one(make, edge_rows):
    rows = [(r[0], r[1] if r[1] is None else r[1][:3000], "en", "a") for r in edge_rows] + [(500 + k, t, "en", "a") for k, t in enumerate(SPECIAL)]
    expected = sorted(((r[0], *x) for r, x in zip(rows, _brute([r[1] for r in rows]), strict=True)), key=repr)
    assert _aligned(make(rows)) == expected


def test_alignment_in_many_small_blocks(make, edge_rows, monkeypatch):
    """The same rows, whatever the size of blocks, slices and lists of pairs."""
    rows = [(k, t, "en", "a") for k, t in enumerate(SPECIAL * 3)] + [(900 + k, " ".join(["Größe", "naive", "tokenisation"] * k), "de", "a") for k in range(9)]
    blocks = []
    own = alignment.vocabularies(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    texts = [r[1] for r in rows]
    whole = alignment.align_texts(own, texts)
    for k, text in enumerate(texts):
        one = alignment.align_texts(own, [text])
        blocks.append(one.groups[0])
        own_pairs = dict(zip(whole.pair[whole.owner == k].tolist(), whole.times[whole.owner == k].tolist(), strict=True))
        assert own_pairs == dict(zip(one.pair.tolist(), one.times.tolist(), strict=True))
    assert blocks == whole.groups
    assert _aligned(make(rows).repartition(7)) == _aligned(make(rows).coalesce(1))


def test_a_long_text_is_aligned_whole(make, edge_rows):
    long = next(r for r in edge_rows if r[0] == 8)
    (row,) = _aligned(make([long]))
    found = _aligned(make([(1, long[1][: len(long[1]) // 2], "en", "a")]))
    assert row[1] > 1.9 * found[0][1] > 0 and row[4] == row[1] + row[2] - row[3]


def test_alignment_of_an_empty_table(empty):
    assert _aligned(empty) == []


def test_the_diagonal_is_followed_over_shifts():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randint(1, 120)
        cut = lambda p: np.array(sorted({k for k in range(1, total) if rng.random() < p} | {total}))  # noqa: B023,E731
        a, b = cut(rng.choice([0.1, 0.5, 0.95])), cut(rng.choice([0.1, 0.5, 0.95]))
        found = alignment.align(a, b)
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[found.group_a - 1].tolist() == common == b[found.group_b - 1].tolist()
        begin = lambda ends: np.concatenate([[0], ends[:-1]])
        over = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(begin(a)[i], begin(b)[j]) < min(a[i], b[j])}
        links = list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True))
        assert len(links) == len(over) and set(links) == over


# ---- op13 ---------------------------------------------------------------------------------------


def _auc(good, bad):
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def _labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        good = k % 4 != 0
        words = [rng.choice(["stone", "river", "walks", "slowly", "under", "bright", "morning", "and", "the"]) for _ in range(rng.randint(20, 120))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + rng.choice(["!!", "$$", "##"]) for w in words)
        rows.append((k, text, "en", "a", int(good)))
    return rows


def test_ranking_on_held_out_documents(spark, make):
    rows = _labelled(400, 1)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3], "doc_id bigint, quality int")
    model = quality_ranking.train(make([r[:4] for r in rows]), labels)
    found = {r[0]: r[1:] for r in quality_ranking.rank_quality(make([r[:4] for r in rows]), model).select("doc.doc_id", "score", "predicted").collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert _auc([found[r[0]][0] for r in held if r[4]], [found[r[0]][0] for r in held if not r[4]]) > 0.99
    assert np.mean([found[r[0]][1] == r[4] for r in held]) > 0.97


def test_the_weights_minimise_the_loss_of_the_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    better, worse = quality_ranking.preference_pairs(y)
    assert sorted(zip(better.tolist(), worse.tolist(), strict=True)) == sorted((i, j) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0))
    w = quality_ranking.fit_pairs(x, better, worse)

    def loss(v):
        return np.mean([math.log1p(math.exp(-(x[i] - x[j]) @ v)) for i, j in zip(better, worse, strict=True)]) + quality_ranking.RIDGE / 2 * v @ v

    for k in range(5):
        for step in (-1e-3, 1e-3):
            assert loss(w) <= loss(w + step * np.eye(5)[k]) + 1e-12


def test_every_document_has_a_turn_in_bounded_pairs():
    y = np.array([1] * 90 + [0] * 60)
    better, worse = quality_ranking.preference_pairs(y, most=600)
    pairs = list(zip(better.tolist(), worse.tolist(), strict=True))
    assert len(pairs) == len(set(pairs)) == 600 and set(better) == set(range(90)) and set(worse) == set(range(90, 150))


def test_the_threshold_leaves_the_share_of_bad_ones_below(spark):
    rng = np.random.default_rng(5)
    y = np.array([1] * 70 + [0] * 30)
    x = rng.normal(size=(100, quality_ranking.WIDTH)) + y[:, None]
    model = quality_ranking.fit(x, y)
    assert int((model.score(x) < 0.5).sum()) == 30


def test_ranking_of_odd_rows(spark, make, edge, edge_rows, empty):
    rows = _labelled(80, 2)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(None, 1), (3, None), (3, 7)], "doc_id bigint, quality int")
    model = quality_ranking.train(make([r[:4] for r in rows]), labels)
    found = quality_ranking.rank_quality(edge, model).select("doc.*", "score", "predicted").collect()
    assert len(found) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    blank = {r["score"] for r in found if r["text"] is None or not r["text"].strip()}
    assert len(blank) == 1
    by_text = defaultdict(set)
    for r in found:
        by_text[r["text"]].add(r["score"])
    assert all(len(v) == 1 for v in by_text.values())
    assert quality_ranking.rank_quality(empty, model).count() == 0


@pytest.mark.parametrize("labels, side", [([], 0.5), ([(0, 1), (1, 1)], 1), ([(0, 0), (1, 0)], 0)])
def test_ranking_without_both_labels(spark, make, labels, side):
    rows = [r[:4] for r in _labelled(4, 3)]
    model = quality_ranking.train(make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    scores = {round(r["score"], 3) for r in quality_ranking.rank_quality(make(rows), model).collect()}
    assert len(scores) == 1 and (scores == {0.5} if side == 0.5 else (min(scores) > 0.5) == bool(side))


def test_vocabulary_files_are_where_the_queries_look():
    assert vocabulary("piece_bpe_32k.model") == public_tokenizers.path("piece_bpe_32k.model")
