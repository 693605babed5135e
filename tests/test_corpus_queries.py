import re
from collections import Counter

import duckdb
import pytest

from lodestrata.operators.overlap import overlap_pairs
from lodestrata.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_good_document_is_accepted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and r.toxic == 0}
    leaves = Counter(f"{r.lang}/{r.source}" for r in docs if r.doc_id in good)
    total = 1 + len({r.lang for r in docs}) + len({(r.lang, r.source) for r in docs})
    assert {r.taxonomy_node_id for r in QUERIES["covered_nodes"](spark, SF).collect()} == set(leaves)
    found = QUERIES["coverage_metrics"](spark, SF).first()
    assert (found.eligible_nodes, found.covered_nodes) == (total, len(leaves))
    assert found.node_coverage_ratio == pytest.approx(len(leaves) / total, abs=1e-9)


def tokens(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def brute_pairs(docs, items):
    return {(d, i): round(len(a & b) / min(len(a), len(b)), 9) for d, a in docs.items() for i, b in items.items() if a & b}


def test_every_document_meets_every_item(spark):
    read = lambda name, key: {r[key]: tokens(r.text) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}
    rows = QUERIES["token_overlap_pairs"](spark, SF).collect()
    assert {(r.doc_id, r.item_id): r.overlap for r in rows} == brute_pairs(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)


@pytest.mark.parametrize("pass_tokens", [5, 10_000])
def test_items_of_any_number_and_in_passes(spark, pass_tokens):
    docs = {d: {f"t{(d * k) % 17}" for k in range(d % 6)} for d in range(30)}
    items = {i: {f"t{(i + k) % 23}" for k in range(i % 4)} for i in range(90)}
    table = lambda sets, key: spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], f"{key} long, tokens array<string>")
    rows = overlap_pairs(table(docs, "doc_id"), table(items, "item_id"), "doc_id", "item_id", pass_tokens).collect()
    assert {(r.doc_id, r.item_id): round(r.overlap, 9) for r in rows} == brute_pairs(docs, items)


def test_pairs_are_not_gathered_for_counting(spark):
    table = lambda key: spark.createDataFrame([(i, ["a", "b"]) for i in range(50)], f"{key} long, tokens array<string>")
    plan = overlap_pairs(table("doc_id"), table("item_id"), "doc_id", "item_id")._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Repartition" not in plan


@pytest.mark.parametrize("name", ["complexity_metrics", "complexity_shift_by_segment"])
def test_texts_without_tokens_are_hard_by_their_place(spark, tmp_path, name):
    texts = ["ññ ñ", "some words", "!!", "", "other words", "more", None, "last"]
    rows = [(i, text, "de" if re.search("[a-z]", text or "") else "fr", f"src{i // 2 % 2}") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
