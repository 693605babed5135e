import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.mixing import MAX_EPOCHS, SHARE, WEIGHTS, mix_sources, mixed_rows, targets

from .brute import words


def brute_targets(sizes):
    """{source: size} -> {source: target}, by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    target, rest, open_ = {}, SHARE * sum(sizes.values()), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= MAX_EPOCHS * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: MAX_EPOCHS * sizes[s] for s in full}
        rest -= sum(MAX_EPOCHS * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{chr(97 + i)}": rng.choice([0, 1, 10, 1000, 10**6]) for i in range(rng.randrange(1, 9))} | {None: 50, "é": 7}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None])
        text = None if i % 97 == 0 else " ".join(["w"] * rng.randrange(0, 60)) + ("\n###" if i % 5 == 0 else "")
        rows.append((i, text, source, 1))
    rows += [(None, "x y z", "a", 1), (5, rows[5][1], rows[5][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    first = mix_sources(docs.drop("size")).collect()
    assert sorted(map(str, first)) == sorted(map(str, mix_sources(docs.drop("size").repartition(7)).collect()))
    assert len(first) == len(rows)
    sizes, taken = {}, {}
    for r in first:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r["size"]
    assert sum(sizes.values()) == sum(len(words(t)) for _, t, _, _ in rows)
    want = brute_targets(sizes)
    for r in first:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r["size"] for r in first if r["size"])


def test_repeated_rows_meet_the_target(spark):
    rows = [(i, "a b c d e f g h i", "s") for i in range(1000)] + [(5000, "a b c d e f g h i", "s")] * 1000 + [(i, "w " * 9, "t") for i in range(6000, 6400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for source, size in (("s", 18000), ("t", 3600)):
        found = mix_sources(docs).where(F.col("source") == source).agg(F.sum("taken"), F.max("target"), F.max("source_size"), F.count("*")).first()
        assert found[2] == size and abs(found[0] - found[1]) <= 5
    assert mixed_rows(docs).count() == mix_sources(docs).agg(F.sum(F.col("taken") / 9)).first()[0]
    equal = spark.createDataFrame([(1, "x y", "s")] * 101 + [(2, "z", "t")] * 500, "doc_id long, text string, source string").repartition(5)
    taken = {r.source: (r.a, r.b) for r in mix_sources(equal).groupBy("source").agg(F.sum("taken").alias("a"), F.max("target").alias("b")).collect()}
    assert all(abs(a - b) <= 1 for a, b in taken.values())


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x y", "s", 9, "d"), (2, "z", "t", 8, "e")], "doc_id long, text string, source string, `Size` int, `a.b` string")
    got = mix_sources(docs)
    assert got.columns == ["doc_id", "source", "a.b", "size", "source_size", "target", "epochs", "selected", "taken"]
    assert {r["a.b"]: r["size"] for r in got.collect()} == {"d": 2, "e": 1}
    assert mixed_rows(docs).columns == docs.columns


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).collect() == [] and mixed_rows(empty).collect() == []
