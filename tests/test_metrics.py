import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import datasets as ds
from lodestrata.operators import elo
from lodestrata.operators import metrics as mt


def gini(values):
    values, n, s = sorted(values), len(values), sum(values)
    if not n or not s:
        return 0.0
    return 2 * sum(i * v for i, v in enumerate(values, 1)) / (n * s) - (n + 1) / n


def test_coverage(spark):
    nodes = spark.createDataFrame([("root", 0), ("a", 1), ("b", 1)], "taxonomy_node_id string, depth int")
    accepted = spark.createDataFrame([("root",), ("a",), ("a",), ("elsewhere",)], "taxonomy_node_id string")
    r = mt.coverage(nodes, accepted).first()
    assert (r.eligible_nodes, r.covered_nodes, r.node_coverage_ratio) == (3, 2, 2 / 3)
    assert r.depth_coverage_profile == {"0": 1.0, "1": 0.5} and r.min_depth_coverage == 0.5
    assert r.coverage_balance == pytest.approx(1 - gini([1, 2, 0]))
    assert mt.coverage(nodes, accepted.limit(0)).first().coverage_balance == 1.0


def test_gini(spark):
    rng = random.Random(2)
    groups = {g: [rng.choice([0, 0, 1, 2, 5, 40]) for _ in range(rng.randrange(1, 30))] for g in range(60)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, cnt long")
    for r in mt.gini(df, "g").collect():
        assert r.gini == pytest.approx(gini(groups[r.g]), abs=1e-12)


def test_complexity(spark):
    run = spark.createDataFrame([(0.6, True), (0.8, False), (0.9, True)], "score double, is_successful boolean")
    base = spark.createDataFrame([(0.3,), (0.4,), (0.5,)], "score double")
    r = mt.complexity(run, base).first()
    assert r.complexity_shift == pytest.approx(0.4) and r.complexification_precision == 2 / 3 and r.complexification_pairs_evaluated == 3
    assert r.calibrated_score_distribution.p25 == pytest.approx(0.7)
    r = mt.complexity(run, base.limit(0)).first()
    assert r.complexity_shift == 0.0
    r = mt.complexity(run.limit(0), base).first()
    assert r is None or r.complexity_shift == 0.0


def test_gates_and_notes(spark):
    values = {"node_coverage_ratio": 0.81, "min_depth_coverage": 0.65, "complexification_precision": 0.72, "critic_agreement": 0.77, "acceptance_rate": 0.52, "regen_burden": 0.95}
    rows = [{"run": "good", **values}, {"run": "bad", **values, "critic_agreement": 0.5}, {"run": "open", **values, "acceptance_rate": None}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "run string, " + ", ".join(f"{k} double" for k in values))
    gates = mt.gates(df, ["run"])
    assert gates.count() == 18
    assert dict(mt.overall(gates, ["run"]).collect()) == {"good": "pass", "bad": "fail", "open": "todo"}
    notes = {r.run: r.note for r in mt.failure_notes(gates, ["run"]).collect()}
    assert notes == {"good": mt.NO_FAILURE, "open": mt.NO_FAILURE, "bad": "Failed threshold: quality.critic_agreement (0.5 >= 0.75)."}


def test_quality_and_its_stub(spark):
    judged = spark.createDataFrame([("accepted", False, 0), ("rejected", True, 2), ("rejected", False, 0)], "quality_status string, disagreement boolean, regeneration_count int")
    r = mt.quality(judged).first()
    assert (r.acceptance_rate, r.critic_agreement, r.disagreement_rate, r.regen_burden) == (1 / 3, 2 / 3, 1 / 3, 2.0)
    r = mt.quality(judged.limit(0)).first()
    assert (r.acceptance_rate, r.regen_burden) == (0.0, 0.0)
    stub = mt.quality_stub(spark).first()
    assert stub.acceptance_rate is None and stub.requires_issue_5_outputs and len(stub.todo_after_issue_5) == 3


def test_elo_moves_points_between_samples(spark):
    games = spark.createDataFrame([("p", i, "a", "b") for i in range(6)] + [("q", 1, "x", "y")], "pool string, seq int, winner string, loser string")
    got = {(r.pool, r.sample): r for r in elo.ratings(games).collect()}
    assert got["q", "x"].rating == 1016 and got["q", "y"].rating == 984 and not got["q", "x"].calibrated
    assert got["p", "a"].rating + got["p", "b"].rating == pytest.approx(2000) and got["p", "a"].calibrated


def test_reruns_and_splits(spark):
    a = spark.range(100).select(F.col("id").cast("string").alias("instantiation_id"))
    delta = lambda x: spark.createDataFrame([(x,)], "delta double")
    assert mt.classify_rerun(a, a, delta(1.0)).first().classification == "exact"
    assert mt.classify_rerun(a, a.limit(99), delta(0.001)).first().classification == "drift"
    assert mt.classify_rerun(a, a.limit(99), delta(-0.5)).first().classification == "mismatch"
    split = ds.with_split(a)
    assert 0 < split.where("split = 'evaluation'").count() < 30


def test_hypotheses(spark):
    columns = "preset_id string, node_coverage_ratio double, min_depth_coverage double, median_complexity double, critic_agreement double, acceptance_rate double, regen_burden double"
    rows = [("B0", 0.9, 0.7, 0.9, 0.8, 0.6, 0.0), ("A1", 0.5, 0.7, 0.9, 0.8, 0.6, 0.0), ("A2", 0.9, 0.7, 0.9, 0.8, 0.6, 0.0), ("A3", 0.9, 0.7, 0.45, 0.8, 0.6, 0.0), ("A4", 0.9, 0.7, 0.9, 0.5, 0.6, 0.0)]
    got = {r.hypothesis: r.accepted for r in mt.hypotheses(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"H1": False, "H2": None, "H3": True, "H4": True}
