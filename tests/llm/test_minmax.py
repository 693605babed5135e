import random

from lodestrata.llm import minmax, shared
from lodestrata.llm.graph import connected_components

from .brute import near_duplicates


def check(spark, docs, extra=""):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n string").repartition(3)
    rows = minmax.near_duplicates(df).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(docs)
    assert got == near_duplicates(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_copies_and_edges(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(1000 + i, t) for i, t in enumerate([None, "", " \n\t", "one", "One", "one two", "two one", "a b c d", "a b c d e", "a b c d e f"])]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # a chain: each differs a little from the one before
        docs.append((i, " ".join(base)))
        for _ in range(rng.choice([1, 2, 3, 6])):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
    docs += [(200 + i, docs[12][1].upper()) for i in range(5)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs += [(300 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(60)]
    docs.append((400, " ".join(rng.choice(vocabulary) for _ in range(5000))))
    check(spark, docs)
    monkeypatch.setattr(minmax, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minmax, "BROADCAST_IDS", 0)
    monkeypatch.setattr(minmax, "CHUNK_PAIRS", 3)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.01)
    check(spark, docs)


def test_empty_table_and_null_ids(spark):
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = minmax.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (3, 3, True)]


def test_stage_keeps_columns_whatever_their_names(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, text, 6, "y"), (None, text, 7, "z")], "doc_id long, text string, gone_id int, `gone.id` string")
    kept = minmax.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.gone_id for r in kept.collect()) == [5, 7]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (9, 8)]
    got = dict(connected_components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
