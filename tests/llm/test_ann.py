import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ann
from lodestrata.llm.ann import fit_lists, nearest, nearest_in_chunk


def brute(ids, x, queries, k=5):
    n = np.linalg.norm(x, axis=1)
    out = {}
    for i in queries:
        score = (x * x[i]).sum(axis=1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    out = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[4000:5000] = x[50]  # many copies of a query
    ids = rng.permutation(6000)
    got = run(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)])
    want = brute(ids, x.astype(np.float64), np.flatnonzero(ids % 50 == 0))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {q: dict(w) for q, w in want.items()}
    for q, found in got.items():
        assert len(found) == 5
        for i, score in found:
            assert exact[q].get(i, score) == score
    copied = next(q for q in want if want[q][0][1] > 0.999999)
    assert [i for i, _ in got[copied]] == [i for i, _ in want[copied]]


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_with_many_blocks_of_queries(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 16)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 24))
    if kind == "clustered":
        x = 0.3 * x + rng.normal(size=(40, 24))[rng.integers(40, size=5000)]
    x = x.astype(np.float32)
    ids = np.arange(5000)
    got = run(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)])
    want = brute(ids, x.astype(np.float64), np.flatnonzero(ids % 50 == 0))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    lists = fit_lists(x.astype(np.float64), 5000, 5)
    assert len(lists.centres) == ann.wanted_lists(5000)
    if kind == "clustered":
        assert lists.probes <= len(lists.centres) // 3  # lists prune where vectors cluster


def test_lists_and_sample_grow_with_the_table():
    assert [ann.wanted_lists(n) for n in (1, 10_000, 10**8, 10**10)] == [1, 50, 5000, 50_000]
    assert ann.sample_size(10**5, 64) == ann.SAMPLE and ann.sample_size(10**8, 64) == 160_000
    assert ann.sample_size(10**12, 768) * 768 * 4 <= ann.SAMPLE_BYTES


def test_very_large_and_very_small_vectors_take_part(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3.0, 4.0]), (50, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert got[0, 1] == pytest.approx(3 / 10**0.5) and got[0, 2] == pytest.approx(7 / 50**0.5) and got[0, 50] == pytest.approx(2**-0.5)
    assert got[50, 1] == pytest.approx(5**-0.5) and len(got) == 6


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [2.0, 2.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0], 0), (None, [1.0, 0.0], 0), (50, [0.0, 0.0], 0), (1, [1.0, 1.0], 0)]
    got = run(spark, rows)
    assert list(got) == [0] and [i for i, _ in got[0]] == [1, 2]
    assert got[0][0][1] == pytest.approx(2**-0.5)
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0], 0)]) == {}


def test_candidates_are_abandoned_early():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    lists, tally = fit_lists(x, 4000, 5), {}
    ids = np.arange(4000)
    q, i, _ = nearest_in_chunk(lists, ids, x, ids[:40], x[:40] + 0.3 * rng.normal(size=(40, 64)), 5, tally)
    assert tally["values"] < 0.8 * 40 * (4000 - 256) * 64
