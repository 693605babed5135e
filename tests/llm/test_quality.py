import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestrata.llm.quality import FEATURES, MONOTONE, SYMBOLS, fit, fit_trees, judge, quality_rules, statistics
from lodestrata.llm.textblock import blocks

from .brute import WORD, words


def brute(text):
    text = text or ""
    w = words(text)
    counts, marked, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if counts[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(text.count(s) for s in SYMBOLS), dup, len(marked)]


def texts(n=150):
    rng = random.Random(2)
    made = ["".join(rng.choice(["ab ", "c ", "é", "\n", "#", " ", "Ab ", "\x0b", "the end\n", " x"]) for _ in range(rng.randrange(160))) for _ in range(n)]
    return [*made, None, "", "\n \n", "a b a b a b", "x\nx\n\nx ", "w " * 3000]


def test_statistics_match_brute_force():
    for size in (100, 1 << 20):
        got = np.concatenate([statistics(b)[0] for _, _, b in blocks(pa.array(texts()), size)])
        assert got.tolist() == [brute(t) for t in texts()]


def labelled(n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("" if good else rng.choice(["", "###", "%%%"])) for _ in range(rng.randrange(60, 120))]
        rows.append((i, " ".join(w), int(good)))
    return rows


def test_held_out_accuracy_and_rows(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(d, t, "c") for d, t, _ in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(d, g) for d, _, g in rows[:300]] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality_rules(docs, labels)
    found = {r.doc_id: r for r in out.collect()}
    right = sum(found[d].kept == bool(g) for d, _, g in rows[300:])
    assert right >= 0.97 * 300
    for d, t, _ in rows:
        assert [found[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute(t)
    trees = fit(docs, labels)
    kept = judge(docs, trees, only_kept=True)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if r.kept}
    assert trees.margin(np.zeros((3, len(FEATURES)))).tolist() == fit(docs.repartition(5), labels).margin(np.zeros((3, len(FEATURES)))).tolist()


def test_base_rules_nulls_and_one_sided_labels(spark):
    rows = [(1, None), (2, "w " * 49), (3, " ".join(f"w{i}" for i in range(50))), (4, "a b c " * 30), (3, " ".join(f"w{i}" for i in range(50))), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert fit(docs, labels) is None and fit(docs, labels.limit(0)) is None
    got = sorted((r.doc_id or -1, r.base_failed, r.kept) for r in quality_rules(docs, labels).collect())
    assert got == [(-1, True, False), (1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, True, False)]
    assert quality_rules(docs.limit(0), labels).collect() == []


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(FEATURES)))
    y = (x[:, 2] + x[:, 3] + 0.5 * rng.normal(size=2000) < 1 + np.sin(6 * x[:, 2]) / 2).astype(float)
    trees = fit_trees(x, y)
    base = rng.random((100, len(FEATURES)))
    for j, sign in enumerate(MONOTONE):
        steps = []
        for v in np.linspace(-0.1, 1.1, 60):
            moved = base.copy()
            moved[:, j] = v
            steps.append(trees.margin(moved))
        if sign:
            assert (sign * np.diff(steps, axis=0) >= -1e-12).all()
