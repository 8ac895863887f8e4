"""Language models, language identification, toxicity and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfsift.llm import language, lm_scoring, toxicity
from shelfsift.llm.language import identify
from shelfsift.llm.lm_scoring import MU, ORDER, score
from shelfsift.llm.toxicity import grade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scored_by_hand(rows, learn, order=ORDER):
    """(n_tokens, n_known, N, base, score) of each row from plain counts of whole n-grams."""
    read = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")), None] for r in rows]
    c, grams, fronts = Counter(), Counter(), Counter()
    for words, own in zip(read, learn, strict=True):
        if own:
            c.update(words)
            line = ["<s>", *words]
            for k in range(2, order + 1):
                for i in range(k, len(line) + 1):
                    grams[tuple(line[i - k : i])] += 1
                    fronts[tuple(line[i - k : i - 1])] += 1
    n, v = sum(c.values()), len(c)
    once, twice = list(c.values()).count(1), list(c.values()).count(2)
    d = once / (once + 2 * twice) if once else 0.5

    def p(w, h):
        if h:
            return (grams[(*h, w)] + MU * p(w, h[1:])) / (fronts[h] + MU)
        x = (c[w] - d) / n if c[w] else (d * v / n if n else 1.0)
        return x if x > 0 else 0.5 / max(n, 1)

    out = []
    for words in read:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        line = ["<s>", *words]
        total = sum(math.log10(p(line[i], tuple(line[max(0, i - order + 1) : i]))) for i in range(1, len(line)))
        out.append((len(words), sum(c[w] > 0 for w in words), n, base, total))
    return out


@pytest.mark.parametrize(("block_bytes", "lane", "order"), [(1 << 20, 512, 3), (3000, 7, 3), (3000, 1, 4), (1 << 20, 50, 2)])
def test_scores_equal_plain_counts(monkeypatch, edge, edge_rows, block_bytes, lane, order):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    learn = [r[0] is not None and r[0] % 3 != 1 for r in edge_rows]
    scored = score(edge, F.col("doc_id") % 3 != 1, order=order).collect()
    got = sorted((repr((r.doc.doc_id, r.doc.text)), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored)
    want = sorted((repr((r[0], r[1])), *x) for r, x in zip(edge_rows, scored_by_hand(edge_rows, learn, order), strict=True))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)
    # Lanes, whatever their length, read what one lane reads.
    automaton, _ = _automaton([(r[1] or "").encode() for r in edge_rows], learn, order)
    assert automaton.read(lane) == pytest.approx(automaton.read(1 << 30), rel=1e-9)


def _automaton(texts, learn, order, cut=False):
    """Of one block, with its own counts; ``cut`` leaves the ends of texts out of what is read."""
    words, ends = lm_scoring.tokens_of(texts)
    learned = np.repeat(np.array(learn, bool), np.diff(ends, prepend=0))
    codes = lm_scoring.grams_of(words, ends, order)
    vocabulary = Counter(words[learned].tolist())
    totals = (sum(vocabulary.values()), len(vocabulary), *(list(vocabulary.values()).count(k) for k in (1, 2)))
    if cut:
        keep, ends = words != lm_scoring.END, ends - np.arange(1, len(ends) + 1)
        kept = [x[keep] for x in codes]
    else:
        kept = codes
    counts = [np.array([Counter(x[learned].tolist())[g] for g in np.unique(y).tolist()]) for x, y in zip(codes, kept, strict=True)]
    return lm_scoring.BackoffAutomaton(kept, counts, ends, totals, float(sum(learn))), vocabulary


def test_probabilities_of_a_state_add_up():
    """Over all known words, the end and the unknown word, from states of every length."""
    trained = ["a b c a b d", "b c c a", "a b c d", "d d a b"]
    for front in ("", "a", "a b", "b c", "c z", "d a b"):
        probes = [f"{front} {w}" for w in ("a", "b", "c", "d", "zz")]
        texts = [t.encode() for t in [*trained, *probes, front]]
        log_p = _automaton(texts, [True] * 4 + [False] * 6, 3, cut=True)[0].read()
        following = 10 ** (log_p[4:9] - log_p[9])
        closed = _automaton(texts, [True] * 4 + [False] * 6, 3)[0].read()
        assert following.sum() + 10 ** (closed[9] - log_p[9]) == pytest.approx(1.0)


def test_copies_of_learned_texts_score_apart(make):
    """A held-out text whose runs of three words were learned scores above one of the same words."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    rows = [(i, t, "en", "a") for i, t in enumerate([*texts, texts[0], " ".join(shuffled)])]
    got = {r.doc.doc_id: r.score for r in score(make(rows), F.col("doc_id") < 200).collect()}
    assert got[200] > got[201] and got[200] == pytest.approx(got[0], rel=1e-9)


def test_scores_without_training_rows_and_of_nothing(edge, empty):
    assert {(r.train_tokens, r.n_known, r.score) for r in score(edge, F.lit(False)).collect()} == {(0, 0, 0.0)}
    assert score(empty, F.lit(True)).count() == 0


LETTERS = {"aa": "abcde", "bb": "bdfgz", "cc": "éèàabx"}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def models():
    rng = random.Random(8)
    return language.fit({lang: [invented(rng, lang, 80) for _ in range(30)] for lang in LETTERS})


def test_languages_of_held_out_texts(make, models):
    rng = random.Random(9)
    rows = [(i, invented(rng, lang, 30), lang, "a") for i, lang in enumerate(list(LETTERS) * 20)]
    got = identify(make(rows), models).collect()
    assert sum(r.lang_pred == r.doc.lang for r in got) >= 59
    assert all(0 <= r.score <= 1 and not r.rejected for r in got)


def test_foreign_text_is_rejected_but_named(make, models):
    row = identify(make([(1, "ЖЩЮЯ ЖЩЮЯЖ ФЫВА ОЛДЖ ЭЮЯ", None, None)]), models).first()
    assert row.rejected and row.lang_pred in LETTERS


def test_language_edge_cases(edge, empty, edge_rows, models):
    rows = {repr(r.doc.text): r for r in identify(edge, models).collect()}
    for text in {r[1] for r in edge_rows}:
        undetermined = text is None or not any(c.isalpha() for c in text)
        assert (rows[repr(text)].lang_pred == "und") == undetermined
    assert identify(empty, models).count() == 0
    nothing = language.fit({})
    assert {r.lang_pred for r in identify(edge, nothing).collect()} == {"und"}


def test_training_takes_only_known_rows(make, empty):
    rng = random.Random(3)
    rows = [(i, invented(rng, lang, 20), lang if i % 2 else None, "a") for i, lang in enumerate(["aa", "bb"] * 10)]
    trained = language.train(make(rows + [(99, None, "aa", "a"), (98, "12 34", "dd", "a")]))
    assert trained.languages == ["bb"]
    assert language.train(empty).languages == []


def test_long_documents_and_many_languages_leave_no_language_out(make, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_CHARS", 1600)
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2, raising=False)
    words = {"l1": "aba caba dab ", "l2": "ono pomo rop ", "l3": "ulu tuku sul ", "l4": "ivi kiri zif "}
    # l1: all longer than the bound; l2: one of them, which also begins without a letter.
    rows = [(k, words["l1"] * 400, "l1", "a") for k in range(3)] + [(10, "1 2 3 - " * 400 + words["l2"] * 400, "l2", "a")]
    rows += [(20 + k, words["l3"] * 5 + str(k), "l3", "a") for k in range(4)] + [(30, words["l4"], "l4", "a")]
    models = language.train(make(rows))
    assert models.languages == ["l1", "l2", "l3", "l4"]
    texts = make([(k, words[x] * 3, None, None) for k, x in enumerate(words)])
    assert {r.doc.doc_id: r.lang_pred for r in identify(texts, models).collect()} == dict(enumerate(words))
    assert [language.sample_chars(k) * k**2 <= language.CELLS for k in (17, 256, 1000)] == [True] * 3


def test_models_are_distributions(models):
    """After any context the symbols seen in training leave the rest of one to unseen ones."""
    alphabet = np.unique(np.concatenate([language.symbols(x) for x in LETTERS.values()]))
    context = language.symbols("abd")[1:3]
    grams = [np.concatenate([context[-2:], context[-1:], [s]]).astype(np.uint64) for s in alphabet]
    for g in grams:
        bits, which = models.log_probabilities(g)
        assert (bits > 0).all()
    total = np.zeros(3)
    for s in alphabet:
        codes = np.array([context[0], context[1], context[1], s], np.uint64)
        bits, which = models.log_probabilities(codes)
        total += 2.0 ** -bits[which[-1]]
    assert (total <= 1 + 1e-9).all() and (total > 0.3).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**31))
def test_ordinal_fit_finds_the_maximum(seed):
    rng = np.random.default_rng(seed)
    x, g = rng.random((60, 3)), rng.integers(0, 3, 60)
    w, t = toxicity.fit_ordinal(x, g, 3, ridge=0.0)

    def likelihood(w, t):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - t[None, :])))
        full = np.concatenate([np.ones((60, 1)), p, np.zeros((60, 1))], axis=1)
        return np.log(np.maximum(full[np.arange(60), g] - full[np.arange(60), g + 1], 1e-12)).mean()

    best = likelihood(w, t)
    assert list(t) == sorted(t)
    for i in range(3):
        for step in (0.05, -0.05):
            assert likelihood(w + step * np.eye(3)[i], t) <= best + 1e-6
    for i in range(2):
        for step in (0.05, -0.05):
            assert likelihood(w, t + step * np.eye(2)[i]) <= best + 1e-6


@pytest.fixture(scope="module")
def judged(spark, make):
    rng = random.Random(4)
    clean = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "Nastygram", "nastyfoo"]))
        rows.append((i, " ".join(words), "en", "a"))
        if i % 3:
            labels.append((i, int(toxic), None))
    labels += [(10**6, 1, None), (None, 1, None), (1, None, None)]
    return make(rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxic_documents_are_found(judged):
    docs, labels = judged
    model = toxicity.train(docs, labels)
    rows = grade(docs, model).collect()
    assert all(r.toxic == (r.doc.doc_id % 7 == 0) for r in rows)
    assert all(0 <= r.severity <= 2 and r.severity == pytest.approx(model.severity(r.doc.text)) for r in rows)
    assert {r.grade for r in rows} >= {0, 2}


def test_toxicity_edge_cases(spark, edge, empty, edge_rows, judged):
    docs, labels = judged
    model = toxicity.train(docs, labels)
    rows = grade(edge, model).collect()
    assert len(rows) == len(edge_rows) and not any(r.toxic for r in rows)
    assert grade(empty, model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert not any(r.toxic for r in grade(docs, nothing).collect())


def test_pipeline_stages(spark, edge, empty, edge_rows, judged, tmp_path, monkeypatch):
    import corpus_pipeline
    from shelfsift.llm.common import written

    docs, labels = judged
    labels.drop("text").write.parquet(str(tmp_path / "labels.parquet"))
    planted = [(1000, "vile stuff and word1 word2", "en", "a"), (1001, "quite clean word3 words, all of them here", "en", "b")]
    first = docs.filter("doc_id > 200").unionByName(edge).unionByName(spark.createDataFrame([(*p, len(p[1]), "x", 1, "y", None, "z", "s") for p in planted], docs.schema))
    kept = {}
    rows = first
    for name, stage in corpus_pipeline.STAGES:
        rows = written(stage(spark, rows, str(tmp_path)), "stage")
        if name != "packing":
            assert rows.columns == first.columns
            kept[name] = {r.doc_id for r in rows.collect()}
    assert 1000 not in kept["toxicity"] and 1001 in kept["source_mixing"]
    assert kept["ngram_jaccard_join"] & {5, 6} == {5} and len(kept["ngram_jaccard_join"] & set(range(100, 106))) == 1
    assert kept["source_mixing"] == kept["suffix_array_dedup"]
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    rows = empty
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
    assert rows.count() == 0


def test_pipeline_removes_copies_of_four_fifths(spark, make):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    # 17 words in a row are others: 175 of 217 five-word shingles are common (0.806), 177 of 217 four-word ones (0.816).
    copy = words[:90] + [f"x{k}" for k in range(17)] + words[107:]
    # With 19 words: 173 of 219 (0.79).
    other = [f"v{k}" for k in range(200)]
    apart = other[:90] + [f"y{k}" for k in range(19)] + other[109:]
    docs = make([(k, " ".join(w), "en", "a") for k, w in enumerate((words, copy, other, apart))])
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == {0, 2, 3}


def test_pipeline_decides_row_by_row(spark, make):
    """Rows with one id, or with none, are judged by their own texts; of equal rows one stays."""
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "zz")
    docs = make([
        (1, base, "en", "a"), (7, near, "en", "a"), (7, "another text with the same id", "en", "a"), (None, near, "en", "b"), (None, "no id and no twin at all", "en", "b"),
        (None, None, None, None), (3, "", "en", "b"), (1, base, "en", "a"), (None, "two rows without ids that are alike", "en", "b"), (None, "two rows without ids that are alike", "en", "b"),
    ])
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, base), (7, "another text with the same id"), (None, "no id and no twin at all"), (None, None), (3, ""), (None, "two rows without ids that are alike")], key=repr)


def test_pipeline_cuts_between_characters(spark, make):
    """Characters that a cut would split go, genuine replacement characters stay."""
    import corpus_pipeline

    cases = [("broken \ufffd sign é日本 tail \ufffd end", [(9, 10)]), ("aé b日c", [(2, 3), (6, 7)]), ("é", [(0, 1)]), ("éè", [(1, 3)]), ("plain text", [(0, 3), (5, 10)]), ("😀x😀", [(2, 6)]), ("untouched é", [])]
    for text, spans in cases:
        raw = text.encode()
        pieces = zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(raw)], strict=True)
        row = spark.createDataFrame([(text, [s for s, _ in spans], [e for _, e in spans])], "text string, a array<bigint>, b array<bigint>")
        assert row.select(corpus_pipeline.kept_text(F.col("text"), F.col("a"), F.col("b"))).first()[0] == "".join(raw[s:e].decode("utf-8", "ignore") for s, e in pieces)
    passage = "ein Satz, der mit ö endet und über fünfzig Bytes lang ist: jä"
    docs = make([(1, passage + "é", "de", "a"), (2, "\ufffd vorn " + passage + "è hinten \ufffd", "de", "a")])
    texts = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    # The two letters behind the passage share their first byte, so half of the second one is repeated and its other half goes with it.
    assert texts == {1: passage + "é", 2: "\ufffd vorn  hinten \ufffd"}
