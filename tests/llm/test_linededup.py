import random
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import linededup, textblock
from lodestrata.llm.cuckoo import CuckooFilter, FilterFull
from lodestrata.llm.linededup import LineIndex, dedup_lines

from .brute import LOWER

WHITE = " \t\n\x0b\x0c\r"


def brute(docs):
    """{id: text} -> {id: (kept text, lines, dropped)}"""
    holders = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or d == max(holders[key(x)])]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    common = ["Licensed under the Ünïted terms", "é" * 20, "é" * 19, "x" * 19 + " ", "All rights reserved, everywhere", "short"]
    docs = {}
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(common) if rng.random() < 0.6 else f"line {rng.randrange(10**9)} of its own, long enough"
            lines.append(rng.choice(["", " ", "\t\r", "\x0b"]) + rng.choice([line, line.upper() if line.isascii() else line]) + rng.choice(["", "  ", "\x0c"]))
        docs[i * 3] = "\n".join(lines)
    return docs | {1: None, 2: "", 4: "\n\n", 5: "All rights reserved, everywhere\n" * 2000}


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 7) for d, t in docs.items()], "doc_id long, text string, N_LINES int").repartition(3)


def got(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", broadcast)
    docs = corpus()
    assert got(dedup_lines(frame(spark, docs))) == brute(docs)


def test_insertions_and_deletions_are_reversible(spark):
    docs = corpus()
    ids = sorted(docs)
    index = LineIndex(spark, shard_keys=2)
    first, second = ({d: docs[d] for d in part} for part in (ids[::2], ids[1::2]))
    index.insert(frame(spark, first))
    assert got(index.apply(frame(spark, first))) == brute(first)
    index.insert(frame(spark, second))
    assert got(index.apply(frame(spark, docs))) == brute(docs)
    index.delete(frame(spark, second).select("doc_id"))
    assert got(index.apply(frame(spark, first))) == brute(first)
    index.delete(spark.createDataFrame([(10**6,)], "doc_id long"))
    assert got(index.apply(frame(spark, first))) == brute(first)


def test_null_ids_and_empty_tables(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(None, line), (1, line), (2, line), (None, None)], "doc_id long, text string")
    assert sorted((r.text, r.n_dropped) for r in dedup_lines(df).collect()) == [("", 0)] + [(line, 0)] * 3
    assert dedup_lines(df.limit(0)).collect() == []


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64))
    inside, outside = keys[:3000], keys[3000:]
    made = CuckooFilter.for_keys(len(inside))
    made.insert(inside)
    assert made.contains(inside).all() and len(made) == 3000
    assert made.contains(outside).mean() < 0.01
    made.delete(inside[:1500])
    assert len(made) == 1500 and made.contains(inside[1500:]).all() and made.contains(inside[:1500]).mean() < 0.01
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert (again.table == made.table).all()
    with pytest.raises(FilterFull):
        CuckooFilter.for_keys(8).insert(keys[:100])
    with pytest.raises(KeyError):
        CuckooFilter.for_keys(8).delete(keys[:1])


def test_filters_too_large_to_broadcast_are_probed_by_shard(spark, monkeypatch):
    docs = {i: "\n".join([f"a line of its own, number {i}", "a line that stands everywhere"] + [f"a line that repeats, number {(i + k) % 40}" for k in range(4)]) for i in range(120)}
    index = LineIndex(spark, shard_keys=4)
    index.insert(frame(spark, docs))
    whole = sorted(map(tuple, index._probed().collect()))
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linededup, "CHUNK_REFS", 16)
    assert index.shards == 16
    passed = sorted(map(tuple, index._probed().collect()))
    assert passed == whole and 600 <= len(passed) < 620
    assert got(index.apply(frame(spark, docs))) == brute(docs)


def test_rows_that_share_an_id_are_one_document(spark):
    line, other = "a line that is long enough", "another line that is long enough"
    rows = [(1, line), (1, line), (1, f"{line}\n{other}"), (2, line), (2, other), (3, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.text, r.n_dropped) for r in dedup_lines(df).collect())
    # `line` stands in two documents, `other` in three.
    assert found == [(1, line, 0), (1, line, 0), (1, line, 1), (2, "", 1), (2, line, 0), (3, other, 0)]


def test_an_insertion_may_come_again(spark):
    docs = corpus()
    index = LineIndex(spark)
    index.insert(frame(spark, docs))
    before = sorted(map(tuple, index.counts.collect()))
    index.insert(frame(spark, {d: docs[d] for d in sorted(docs)[::2]}))
    index.insert(frame(spark, docs))
    assert sorted(map(tuple, index.counts.collect())) == before
    assert got(index.apply(frame(spark, docs))) == brute(docs)


def test_own_columns_only(spark):
    df = spark.createDataFrame([(1, "x", 77, 5, "d")], "doc_id long, text string, n_lines int, N_DROPPED int, `a.b` string")
    kept = dedup_lines(df, counts=False)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "x", 77, 5, "d")]


def test_long_texts_are_hashed_in_strips(monkeypatch):
    rng = random.Random(2)
    raw = " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 30))) for _ in range(5000)).encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    one, many = (textblock.TextBlock(data, np.array([0, len(data)])) for _ in range(2))
    starts, ends, _ = one.word_bounds()
    whole = [one.span_hashes(starts, ends, which) for which in (0, 1)]
    monkeypatch.setattr(textblock, "_STRIP", 1024)
    monkeypatch.setattr(textblock, "_powers", {})
    for which in (0, 1):
        assert (many.span_hashes(starts, ends, which) == whole[which]).all()
