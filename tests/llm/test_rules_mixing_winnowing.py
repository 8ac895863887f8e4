"""Rule ledger, mixing and winnowing against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfsift.llm import mixing, quality_rules, winnowing
from shelfsift.llm.mixing import Target, mix, solve_exponent, source_tokens, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def rule_rows(edge_rows):
    return [*edge_rows, (200, "a b c a b c a b", "en", "a"), (201, "x\n\nx\n y\nx", "en", "a"), (202, "#| <b> &&&\r\n#|", "en", "a"), (203, "q q q q q", "en", "a"), (204, "LOUD " * 60, "en", "a")]


def test_ledger_equals_brute_force(make, rule_rows):
    entries = quality_rules.apply_policy(quality_rules.ledger(make(rule_rows)), "base", name="base")
    rows = entries.collect()
    key = lambda x: repr(x)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=key)
    assert got == sorted(((r[0], *measured(r[1])) for r in rule_rows), key=key)
    assert all(r.base == (r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words) for r in rows)


def test_ablations_equal_a_recount(make, rule_rows):
    entries = quality_rules.ledger(make(rule_rows))
    bits = [r.failed_bits & quality_rules.mask("v1") for r in entries.collect()]
    for row in quality_rules.ablations(entries).collect():
        bit = 1 << [r.name for r in quality_rules.RULES].index(row.rule)
        assert row.failing == sum(b & bit != 0 for b in bits)
        assert row.failing_alone == sum(b == bit for b in bits)
        assert row.kept == bits.count(0) and row.kept_without == sum(b & ~bit == 0 for b in bits)


def test_ledger_of_nothing(empty):
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.ablations(quality_rules.ledger(empty)).count() == 0


def fingerprint(spark, text):
    """By looking at every window; the hashes of word groups come from the engine."""
    words = re.findall(winnowing.PIECE, text)
    if not words:
        return ""
    groups = [words] if len(words) < winnowing.K else [words[i : i + winnowing.K] for i in range(len(words) - winnowing.K + 1)]
    rows = spark.createDataFrame([(i, g if len(g) == winnowing.K else [" ".join(g)]) for i, g in enumerate(groups)], "i int, g array<string>")
    one, all_ = F.xxhash64(F.col("g")[0]), F.xxhash64(*[F.try_element_at("g", F.lit(k + 1)) for k in range(winnowing.K)])
    hashes = [r.h for r in rows.select("i", F.when(F.size("g") == winnowing.K, all_).otherwise(one).alias("h")).orderBy("i").collect()]
    chosen = []
    for low in range(max(1, len(hashes) - winnowing.W + 1)):
        at = min(range(low, min(low + winnowing.W, len(hashes))), key=lambda p: (hashes[p], -p))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return " ".join(f"{p}:{hashes[p] & (2**64 - 1):x}" for p in chosen)


def test_winnowing_equals_brute_force(spark, make, edge_rows):
    rows = [r for r in edge_rows if r[0] not in (8, 12)] + [(50, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie", "en", "a")]
    got = winnowing.edited(winnowing.fingerprints(make(rows))).select("doc_id", "text", "edited_text", winnowing.as_text("own").alias("own"), winnowing.as_text("edited").alias("edited"), winnowing.likeness("own_hashes", "next_own_hashes").alias("near")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    follows = defaultdict(list)
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        text, cut = here[1] or "", len(here[1] or "") // 3
        follows[here[0]].append((text, text[: len(text) - cut] + (after[1] or "")[:cut]))
    assert sorted(((r.doc_id, r.text, r.edited_text) for r in got), key=repr) == sorted(((d, *x) for d, xs in follows.items() for x in xs), key=repr)
    for r in got[::4]:
        assert r.own == fingerprint(spark, r.text) and r.edited == fingerprint(spark, r.edited_text)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text].add(r.own)
        assert 0 <= r.near <= 1
        assert hashlib.sha256(r.edited_text.encode())  # every edited text is whole code points
    assert all(len(v) == 1 for v in by_text.values())


def test_shared_passages_share_a_hash(make):
    passage = " ".join(f"common{i}" for i in range(winnowing.K + winnowing.W - 1))
    rows = [(1, "one way to begin " + passage + " and one to end", "en", "a"), (2, "quite another start, " + passage, "en", "a")]
    found = {r.doc_id: set(r.own_hashes) for r in winnowing.fingerprints(make(rows)).collect()}
    assert found[1] & found[2]


def test_winnowing_of_one_and_of_nothing(make, empty):
    assert winnowing.edited(winnowing.fingerprints(empty)).count() == 0
    only = winnowing.fingerprints(make([(7, "alone here", "en", "a")])).first()
    assert only.next_text == "alone here"


@pytest.fixture(scope="module")
def sourced(make):
    return make([(i, "w " * (1 + i % 9), "en", "big" if i % 3 else f"s{i % 12}") for i in range(900)])


def test_weights_meet_the_target(sourced):
    tokens = word_count(F.col("text"))
    sources = source_tokens(sourced, "source", tokens)
    share = {r.source: r.tokens for r in sources.collect()}
    total = sum(share.values())
    t = solve_exponent(sources, Target(max_repeats=1.5))
    z = sum((n / total) ** t for n in share.values())
    assert max((n / total) ** (t - 1) / z for n in share.values()) == pytest.approx(1.5, rel=1e-6)
    entropy = lambda t: -sum(p / z * math.log2(p / z) for p in [(n / total) ** t for n in share.values()] for z in [sum((m / total) ** t for m in share.values())])
    wanted = (entropy(0) + entropy(1)) / 2
    assert entropy(solve_exponent(sources, Target(entropy=wanted))) == pytest.approx(wanted, rel=1e-6)
    assert solve_exponent(sources, Target(entropy=0.0)) == 1.0 and solve_exponent(sources, Target(entropy=99.0)) == 0.0


@pytest.mark.parametrize("target", [Target(max_repeats=1.5), Target(max_repeats=2.5, budget=2.0), Target(max_repeats=3.0, budget=None)])
def test_mixture_realises_the_weights(monkeypatch, sourced, target):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    monkeypatch.setattr(mixing, "CHUNK", 4)
    rows = mix(sourced, target, word_count(F.col("text")), output_block_tokens=500).collect()
    copies, spent, tokens = Counter(), Counter(), Counter()
    for r in sourced.collect():
        tokens[r.source] += len(r.text.split())
    for r in rows:
        copies[r.doc.doc_id, r.epoch] += 1
        spent[r.mix_source] += r.tokens
        assert r.epoch < r.repeats and r.doc.block == "x"
    assert max(copies.values()) == 1
    repeats = {r.mix_source: r.repeats for r in rows}
    for s, n in tokens.items():
        assert 0 <= spent[s] - math.floor(repeats[s] * n) < 10
        assert repeats[s] <= target.max_repeats + 1e-6
    whole = {d for (d, e) in copies if e == 0}
    if target.budget is None:
        assert len(whole) == 900 and min(repeats.values()) == 1
    # Each block of the output has the sources at their weights, up to a few documents.
    blocks = defaultdict(Counter)
    for r in rows:
        blocks[r.mix_block][r.mix_source] += r.tokens
    weight = {r.mix_source: r.weight for r in rows}
    for b in list(blocks)[:-1]:
        for s in weight:
            assert abs(blocks[b][s] - weight[s] * sum(blocks[b].values())) < 80


def test_mixing_edge_cases(edge, empty, edge_rows):
    rows = mix(edge, Target(max_repeats=2.0, budget=None), word_count(F.col("text"))).collect()
    assert len([r for r in rows if r.epoch == 0]) == len(edge_rows)
    assert mix(empty, Target(max_repeats=2.0), word_count(F.col("text"))).count() == 0
    with pytest.raises(ValueError):
        solve_exponent(source_tokens(edge, "source", word_count(F.col("text"))), Target())
