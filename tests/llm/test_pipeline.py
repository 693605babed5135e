import random

import corpus_pipeline
import pytest
from lodestrata.llm.queries import ORACLES, QUERIES

from .brute import near_duplicates
from .test_linededup import brute as brute_lines
from .test_quality import brute as brute_statistics


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = "This line stands in many documents, again and again"
    rows = []
    for i in range(90):
        text = f"{prose(60)}\n{shared}\n{prose(20)}" if i % 3 else prose(80)
        if i % 5 == 0:
            text = " ".join(w + "###" for w in text.split(" "))
        rows.append((i, text, "en", f"s{i % 4}" if i % 7 else None))
    rows += [(200 + i, rows[1][1], "en", "s1") for i in range(5)] + [(300, None, "en", "s0"), (301, "", None, None), (302, "few words", "en", "s2")]
    return rows


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus(random.Random(3))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, a, s, len(t) if t else None) for d, t, a, s in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d % 5 != 0)) for d, *_ in rows if d < 90], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "mix sources", "byte bpe"]

    good = stages["quality rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    for d, t, *_ in rows:
        n, _, symbols, _, repeated = brute_statistics(t)
        assert (d in kept) == (n >= 50 and 2 * repeated <= n and not symbols)

    lines = stages["line dedup"](spark, good, str(tmp_path))
    assert lines.columns == docs.columns
    after = {r.doc_id: r.text for r in lines.collect()}
    assert after == {d: t for d, (t, _, _) in brute_lines(kept).items()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages["near dedup"](spark, lines, str(tmp_path))
    left = {r.doc_id for r in near.collect()}
    assert left == {d for d, (_, c) in near_duplicates(after.items()).items() if c == d}

    mixed = stages["mix sources"](spark, near, str(tmp_path))
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect()]
    assert set(ids) <= left and max(map(ids.count, ids)) <= 2

    encoded = stages["byte bpe"](spark, mixed, str(tmp_path))
    assert sorted(r.doc_id for r in encoded.collect()) == sorted(ids)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in encoded.collect())


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.collect() == []


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["n_lines", "n_dropped", "gone_id", "size", "target", "row", "key", "c0", "id", "a.b", "score", "kept", "n_words"]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 5, *range(100, 100 + len(names))) for i in range(4)]
    rows += [rows[0], (None, rows[1][1], *rows[1][2:]), (7, None, *rows[1][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        found = docs.collect()
        assert {r[5:] for r in found} == {tuple(range(100, 100 + len(names)))}, name
        assert {0, 2, 3} <= {r.doc_id for r in found} or name == "mix sources"
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == len(found)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op2_url_filter", "op9_token_counts"])
def test_queries_run_over_whole_tables(spark, name):
    table = "pages" if name.startswith("op2") else "documents"
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == rows
