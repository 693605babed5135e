import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import hmm
from lodestrata.llm.hmm import Classes, Hmm, score_documents

from .brute import LOWER, words


@pytest.mark.parametrize("piece", [2, 4096])
def test_forward_and_expected_counts_match_enumeration(monkeypatch, piece):
    monkeypatch.setattr(hmm, "PIECE", piece)
    rng = np.random.default_rng(3)
    model = Hmm.random(3, 4)
    first = np.array([0, 1, 4, 9])
    tokens = rng.integers(0, 5, 9).astype(np.int32)
    start, move, emit, total = model.expected(tokens, first)
    logs = model.forward(tokens, first)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    for i in range(3):
        own = tokens[first[i] : first[i + 1]]
        paths = {}
        for path in np.ndindex(*([3] * len(own))):
            p = model.start[path[0]] * model.emit[own[0], path[0]]
            for a, b, o in zip(path, path[1:], own[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            paths[path] = p
        whole = sum(paths.values())
        assert logs[i] == pytest.approx(math.log(whole))
        for path, p in paths.items():
            want[0][path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                want[1][a, b] += p / whole
            for s, o in zip(path, own):
                want[2][o, s] += p / whole
    for got, expected in zip((start, move, emit), want):
        assert np.allclose(got, expected)
    assert total == pytest.approx(logs.sum())


def documents():
    rng = random.Random(4)
    languages = [[f"{p}{i}" for i in range(60)] for p in "ab"]
    rows = [(i, " ".join(rng.choice(languages[i % 2]).upper() for _ in range(rng.randrange(1, 80)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (None, "a1 b1 zzz"), (3, rows[3][1])]


@pytest.mark.parametrize("head", [0, 1000])
def test_scores(spark, head):
    rows = documents()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int").repartition(3)
    got = score_documents(docs, F.col("doc_id") % 7 == 2, own_classes=40, shared_classes=64, states=2, head_words=head).collect()
    assert len(got) == len(rows)
    counts = Counter()
    tokens = lambda t: [*words((t or "").translate(LOWER)), None]
    for d, t in rows:
        if d is None or d % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    held = [0.0, 0.0]
    for r in got:
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.train_tokens) == (len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.held_out == (r.doc_id is not None and r.doc_id % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        if r.held_out:
            held[0] += r.base_score
            held[1] += r.score
    assert held[1] > held[0]  # states tell the two languages apart


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = score_documents(docs, F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert score_documents(docs.limit(0), F.lit(True)).collect() == []


def test_long_texts_in_pieces_and_single_precision(monkeypatch):
    rng = np.random.default_rng(5)
    model = Hmm.random(4, 30)
    first = np.concatenate([[0], np.cumsum(rng.integers(1, 3000, 40))])
    tokens = rng.integers(0, 31, first[-1]).astype(np.int32)
    whole, logs = model.expected(tokens, first), model.forward(tokens, first)
    monkeypatch.setattr(hmm, "PIECE", 64)
    for kind, near in ((np.float64, 1e-9), (np.float32, 1e-4)):
        recursion = hmm.Recursion(model, kind)
        assert np.allclose(recursion.forward(tokens, first), logs, rtol=near)
        for got, want in zip(recursion.expected(tokens, first), whole):
            assert np.allclose(got, want, rtol=near, atol=1e-2 if near > 1e-6 else 1e-9)


def test_still_texts_keep_one_state():
    model, first = Hmm.random(2, 3), np.array([0, 2, 3])
    tokens = np.array([0, 1, 3], dtype=np.int32)
    start, _, emit, total = hmm.Recursion(model).still(tokens, first)
    p = np.array([[model.start[s] * np.prod(model.emit[tokens[a:b], s]) for s in range(2)] for a, b in ((0, 2), (2, 3))])
    share = p / p.sum(axis=1, keepdims=True)
    assert total == pytest.approx(np.log(p.sum(axis=1)).sum())
    assert np.allclose(start, share.sum(axis=0))
    assert np.allclose(emit, [share[0], share[0], [0, 0], share[1]])


@pytest.mark.parametrize("head", [0, 1000])
def test_scores_are_those_of_a_model_over_words(spark, monkeypatch, head):
    """The score of each text, against a plain recursion over words with the fitted states and counts."""
    fitted = {}
    plain = hmm.fit

    def fit(texts, states, classes, settled):
        fitted["model"] = plain(texts, states, classes, settled)
        return fitted["model"]

    monkeypatch.setattr(hmm, "fit", fit)
    monkeypatch.setattr(hmm, "PIECE", 16)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = score_documents(docs, F.col("doc_id") % 7 == 2, own_classes=40, shared_classes=8, states=3, head_words=head).collect()
    model, counts = fitted["model"], Counter()
    tokens = lambda t: words((t or "").translate(LOWER))
    for d, t in rows:
        if d is None or d % 7 != 2:
            counts.update(tokens(t))
    every = sorted(set(counts) | {w for _, t in rows for w in tokens(t)})
    hashes = dict(zip(every, next(hmm.word_hashes(pa.array([" ".join(every)])))[0]))
    known = sorted(((-c, int(hashes[w])) for w, c in counts.items()))
    own = Classes(np.array([h for _, h in known[: 40 if head else 0]], dtype=np.uint64), 8)
    place = {w: int(own.of(np.array([h], dtype=np.uint64))[0]) for w, h in hashes.items()}
    room = Counter()
    for w, c in counts.items():
        room[place[w]] += c + 1
    texts = dict(rows)
    for r in got:
        alpha, log = None, 0.0
        for w in [*tokens(texts[r.doc_id]), None]:
            if w is None:
                emitted = model.emit[-1]
            elif place[w] < len(own.own):
                emitted = model.emit[place[w]]
            else:
                emitted = model.emit[place[w]] * (counts[w] + 1) / (room[place[w]] + 1)
            alpha = (model.start if alpha is None else alpha @ model.move) * emitted
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert r.score == pytest.approx(log)


def test_classes():
    words_, shared = np.array([1 << 63, 5, 5 + (1 << 20), (1 << 64) - 1], dtype=np.uint64), 4
    classes = Classes(words_, shared)
    # The second and the third word meet in a slot; the second, which is more frequent, has it.
    assert len(classes) == 3 + 4 + 1
    assert classes.of(np.array([1 << 63, 5, (1 << 64) - 1, 5 + (1 << 20), 6 + (3 << 20), hmm.END], dtype=np.uint64)).tolist() == [0, 1, 2, 3 + 1, 3 + 3, 7]


def test_the_fit_over_all_texts_settles(spark):
    rows = [(t,) for d, t in documents() if d is not None and d < 500]
    classes = Classes(np.zeros(0, dtype=np.uint64), 64)
    model = hmm.fit(hmm.coded(spark.createDataFrame(rows, "text string").repartition(3), classes), 4, len(classes))
    hashes, first = next(hmm.word_hashes(pa.array([t for t, in rows])))
    tokens = classes.of(hashes)
    *counts, reached = model.expected(tokens, first)
    assert Hmm.from_counts(*counts).forward(tokens, first).sum() - reached < 1e-4 * abs(reached)
