import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import complexify as cx
from lodestrata.operators import critics as cr
from lodestrata.operators import diversify as dv
from lodestrata.operators import taxonomy as tx
from lodestrata.streaming.adjudication import adjudicate_stream, write_decisions


def nodes_of(spark, objective, **settings):
    return tx.expand_taxonomy(spark.createDataFrame([(objective,)], "objective string"), **settings)


def test_taxonomy_is_a_tree_in_breadth_first_order(spark):
    nodes = nodes_of(spark, "financial compliance automation")
    rows = nodes.orderBy("ord").collect()
    assert [r.depth for r in rows] == [0, 1, 1, 2, 2, 2, 2] and [r.ord for r in rows] == list(range(7))
    assert tx.edges(nodes).count() == 6
    assert tx.integrity(nodes).first().is_tree
    assert rows[1].label == "financial compliance automation root financial fundamentals"
    assert [r.label.split()[-2] for r in rows[3:]] == ["compliance"] * 4


@pytest.mark.parametrize(("depth", "branching", "n"), [(0, 2, 1), (2, 0, 3), (2, 1, 3), (2, 9, 7), (3, 2, 15)])
def test_taxonomy_sizes(spark, depth, branching, n):
    assert nodes_of(spark, "Medical, triage!", max_depth=depth, branching_factor=branching).count() == n


def test_empty_objective_and_golden_root(spark):
    assert nodes_of(spark, " ").where("depth = 0").first().domain_namespace == "domain"
    assert nodes_of(spark, "pilot-domain").where("depth = 0").first().taxonomy_node_id == "tax-9f7348228a8e"


def test_broken_trees_are_seen(spark):
    nodes = nodes_of(spark, "x y")
    assert not tx.integrity(nodes.where("ord <> 1")).first().is_tree
    assert not tx.integrity(nodes.union(nodes.where("ord = 2"))).first().is_tree


def overlap(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def sequential(rows, threshold):
    kept, ids = {}, set()
    for g, i, text in sorted(rows):
        tokens = set(re.findall("[a-z0-9]+", (text or "").lower()))
        if not any(overlap(tokens, k) >= threshold for k in kept.setdefault(g, [])):
            kept[g].append(tokens)
            ids.add(i)
    return ids


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_both_greedy_filters_match_a_sequential_one(spark, threshold):
    rng = random.Random(int(threshold * 10))
    rows = [(f"g{rng.randrange(3)}", i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    rows += [("g0", 200, None), ("g0", 201, "!!"), ("g1", 202, "a b c"), ("g1", 203, "a b c")]
    df = spark.createDataFrame(rows, "g string, i long, text string").repartition(3)
    want = sequential(rows, threshold)
    for mark in (dv.mark_kept_by_fold, dv.mark_kept_by_pairs):
        got = mark(df, ["g"], "i", threshold=threshold)
        assert got.columns == ["g", "i", "text", "kept"] or set(got.columns) == {"g", "i", "text", "kept"}
        assert {r.i for r in got.where("kept").collect()} == want
        assert got.count() == len(rows)


def test_copies_and_null_groups_keep_their_first_row(spark):
    rows = [(None if i % 2 else "g", i, "one text of many copies" if i < 300 else "one text of many more copies") for i in range(400)]
    got = dv.mark_kept_by_pairs(spark.createDataFrame(rows, "g string, i long, text string").repartition(4), ["g"], "i")
    assert {r.i for r in got.where("kept").collect()} == {0, 1}
    assert got.count() == len(rows)


def test_blocks_give_the_rows_of_a_sequential_filter_and_few_pairs(spark, monkeypatch):
    written = []

    def counted(df, label, write=dv.materialize):
        out = write(df, label)
        if label == "conflicts":
            written.append(out.count())
        return out

    monkeypatch.setattr(dv, "materialize", counted)
    rng = random.Random(5)
    rows = [(f"g{i % 5 // 3}", i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 40)))) for i in range(300)]
    rows += [("g0", i, f"short words t{i}x t{i}y") for i in range(300, 500, 3)] + [("g0", i, "short words " + " ".join(f"t{i - 1}x t{i - 1}y u{j}" for j in range(9))) for i in range(301, 500, 3)]
    rows += [("g0", i, "the same") for i in range(600, 640)] + [("g0", i, f"the same here {i} {i}b {i}c") for i in range(640, 680)]
    df = spark.createDataFrame(rows, "g string, i long, text string").repartition(3)
    got = dv.mark_kept_by_pairs(df, ["g"], "i", block_tokens=500)
    assert {r.i for r in got.where("kept").collect()} == sequential(rows, 0.8)
    assert len(written) > 5 and max(written) < 1000


def test_pairs_beyond_the_drivers_share_are_settled_the_same(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    df = spark.createDataFrame(pairs, "earlier int, later int")
    want = dv._kept_places(df, 40)
    kept = []
    for i in range(40):
        kept.append(not any(kept[a] for a, b in pairs if b == i))
    assert want.tolist() == kept == dv._kept_places(df, 40, most=0).tolist()


def test_low_diversity_and_lineage(spark):
    marked = dv.diversify(nodes_of(spark, "customer-support"), threshold=0.75)
    assert dv.rejections(marked).where("reason = 'low_diversity'").count() == 14
    r = dv.instantiations(marked).first()
    assert r.lineage.asDict() == {"taxonomy_node_id": r.taxonomy_node_id, "meta_prompt_id": r.meta_prompt_id, "instantiation_id": r.instantiation_id}
    assert dv.candidates(nodes_of(spark, "x"), 0).count() == 0


def samples(spark, n):
    return spark.createDataFrame([(f"inst-{i}", f"tax-{i}", f"mp-{i}", i, f"sentence number {i} about things") for i in range(n)], "instantiation_id string, taxonomy_node_id string, meta_prompt_id string, ord long, text string")


@pytest.mark.parametrize(("n", "fraction", "chosen"), [(4, 0.5, 2), (5, 0.5, 2), (7, 0.5, 4), (3, 0.5, 2), (4, 0, 0), (4, 1, 4), (0, 0.5, 0)])
def test_fraction_is_rounded_half_to_even(spark, n, fraction, chosen):
    out = cx.complexify(samples(spark, n).repartition(3), ["ord"], fraction)
    assert sorted(r.ord for r in out.where("is_complexified").collect()) == list(range(chosen))
    assert out.count() == n


def test_positions_over_many_partitions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r.k for r in cx.with_position(df, ["k"]).orderBy("pos").collect()]
    assert got == sorted(got)
    assert [r.pos for r in cx.with_position(df, ["k"]).orderBy("k").collect()] == list(range(1000))


def test_semantic_failures(spark):
    out = cx.complexify(samples(spark, 1), ["ord"], 1.0, 0.6, "semantic_drift_probe")
    assert out.first().complexity_source == "fallback_original_due_to_semantic_failure"
    assert cx.semantic_failures(out).first().reason == "semantic_preservation_failed"
    empty = samples(spark, 1).withColumn("text", F.lit("!!"))
    assert cx.semantic_failures(cx.complexify(empty, ["ord"], 1.0)).count() == 1
    assert cx.semantic_failures(cx.complexify(samples(spark, 2), ["ord"], 1.0, 1.5)).count() == 2
    for bad in ({"fraction": 1.5}, {"strategy": "no such"}):
        with pytest.raises(ValueError):
            cx.complexify(samples(spark, 1), ["ord"], **bad)


def vote(text, critic):
    return hashlib.sha1(f"{critic}::{text}".encode()).digest()[0] % 2 == 0


def judge(text, tries):
    a, b = vote(text, "critic_a"), vote(text, "critic_b")
    if a == b:
        return ("both_accept" if a else "both_reject"), 0
    for k in range(1, tries + 1):
        text += f" [regen-{k}]"
        if vote(text, "critic_a") and vote(text, "critic_b"):
            return "regeneration_consensus_accept", k
    return "policy_regenerate_exhausted", tries


@pytest.mark.parametrize("tries", [0, 1, 3])
def test_regeneration_matches_a_sequential_model(spark, tries):
    texts = [f"text {i}" for i in range(300)] + ["", "abc"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "instantiation_id string, text string")
    judged = cr.adjudicate(df, cr.Policy("regenerate", tries))
    for r in judged.collect():
        assert (r.final_reason, r.regeneration_count) == judge(r.text, tries)
        assert r.quality_status == ("accepted" if "accept" in r.final_reason else "rejected")
    assert cr.regeneration_log(judged).count() == sum(judge(t, tries)[1] for t in texts)
    assert cr.decisions(judged).where("taxonomy_node_id = 'unknown-node'").count() == len(texts)
    assert cr.accepted_samples(judged).count() + cr.rejection_log(judged).count() == len(texts)


def test_policies(spark):
    with pytest.raises(ValueError):
        cr.Policy("maybe")
    with pytest.raises(ValueError):
        cr.Policy.parse({"max_regenerations_per_sample": -1})
    assert cr.Policy.parse(None) == cr.Policy("reject", 1)
    df = spark.createDataFrame([(str(i), f"t{i}") for i in range(100)], "instantiation_id string, text string")
    again = cr.adjudicate(df, cr.Policy("reject", 2, regenerate_both_reject=True))
    assert again.where("final_reason = 'regeneration_consensus_accept' AND NOT disagreement").count() > 0
    half = cr.within_budget(cr.adjudicate(df, cr.Policy("accept")), 0.0)
    assert half.where("disagreement AND quality_status = 'accepted'").count() == 0
    own = cr.adjudicate(df, critic_a=lambda t: F.lit("accept"), critic_b=lambda t: F.lit("accept"))
    assert own.where("quality_status = 'accepted'").count() == 100


def test_streaming_gives_the_same_decisions(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"t{i}") for i in range(50)], "instantiation_id string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_decisions(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, adjudicate_stream(df).collect()))
