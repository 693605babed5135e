import json
import subprocess
import sys
from pathlib import Path

import pytest

from lodestrata.operators import critics as cr
from lodestrata.operators import datasets as ds
from lodestrata.plans import presets, runner, validate
from lodestrata.sources import documents, schemas

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("matrix")
    return top, runner.execute_matrix(spark, top / "runs", top / "reports", "branch", "hash")


def test_matrix_has_the_golden_values(matrix):
    _, found = matrix
    tables = found["comparison_tables"]
    assert tables == json.loads(Path(found["comparison_tables_path"]).read_text())
    assert [r["preset_id"] for r in tables["coverage_comparison"]] == ["B0", "A1", "A4"]
    for r in tables["coverage_comparison"]:
        assert (r["node_coverage_ratio"], r["coverage_balance"]) == (0.14285714285714285, pytest.approx(0.1428571428571428, abs=1e-15))
    for r in tables["complexity_comparison"]:
        assert (r["complexity_shift"], r["complexification_precision"]) == (0.0, 0.0)
    agreement = [r["critic_agreement"] for r in tables["quality_comparison"]]
    assert agreement == pytest.approx([0.42857142857142855, 0.42857142857142855, 0.17857142857142855], abs=1e-15)
    assert {r["acceptance_rate"] for r in tables["quality_comparison"]} == {0.14285714285714285}
    assert {r["overall_status"] for r in tables["gate_comparison"]} == {"fail"}
    b0 = found["run_reports"]["B0"]
    assert b0["coverage"]["depth_coverage_profile"] == {"0": 0.0, "1": 0.0, "2": 0.25}
    assert b0["complexity"]["calibrated_score_distribution"] == {"p25": 0.45, "p50": 0.45, "p75": 0.45}
    assert b0["quality"]["disagreement_rate"] == 0.5714285714285714
    assert b0["protocol"]["artifact_schema_version"] == "v1"
    assert any(n.startswith("Failed threshold") for n in b0["failure_analysis"])
    report = json.loads(Path(b0["artifacts"]["gate_report"]).read_text())
    assert report["gate_decision"]["overall_status"] == "fail" and report["notes"] == b0["failure_analysis"]


def test_run_documents_have_the_golden_rows(spark, matrix):
    top, found = matrix
    run = top / "runs" / found["run_reports"]["B0"]["run_identity"]["run_id"]
    read = lambda name: json.loads((run / name).read_text())
    nodes = read("10_taxonomy/taxonomy_nodes.json")
    assert nodes[0]["taxonomy_node_id"] == "tax-9f7348228a8e" and nodes[0]["parent_taxonomy_node_id"] is None and len(nodes) == 7
    graph = read("10_taxonomy/taxonomy_graph.json")
    assert len(graph["edges"]) == 6 and graph["generation_policy"]["merge_filter_strategy"] == "normalize+deduplicate+parent-filter"
    kept = read("20_local_diversification/instantiations.json")
    assert (len(kept), kept[0]["instantiation_id"], kept[0]["meta_prompt_id"]) == (7, "inst-ab14ade2f9e4", "mp-5e9181892c2b")
    assert len(read("20_local_diversification/rejections.json")) == 14
    assert [r["is_complexified"] for r in read("30_complexification/samples.json")] == [True] * 4 + [False] * 3
    assert read("30_complexification/semantic_preservation_failures.json") == []
    decisions = read("40_dual_critic_quality/critic_decisions.json")
    assert ["".join(d[f"critic_{c}_decision"][0].upper() for c in "ab") for d in decisions] == ["RA", "RR", "RA", "RR", "AA", "AR", "AR"]
    assert [d["instantiation_id"] for d in decisions if d["quality_status"] == "accepted"] == ["inst-b6350a55bb7a"]
    back = documents.read_json_array(spark, str(run / "40_dual_critic_quality/critic_decisions.json"), schemas.DECISION)
    assert back.count() == 7 and back.where("quality_status = 'accepted'").count() == 1
    assert documents.read_json_array(spark, str(run / "40_dual_critic_quality/regenerations.json"), schemas.REGENERATION).count() == 0
    # A run lacks folders that a published run must have, and names one of them differently.
    assert [i.rsplit(" ", 1)[1] for i in validate.check_folders(run)["issues"]] == ["00_spec", "40_dual_critic", "50_curated_dataset", "60_evaluation", "70_diagnostics"]


def test_run_with_drift_probe_and_regeneration(spark, tmp_path):
    settings = runner.Settings(max_depth=1, branching_factor=1, fraction=1.0, strategy="semantic_drift_probe", policy=cr.Policy("regenerate", 2))
    run = runner.run_pipeline(spark, 1, {"generator": "g"}, "payments disputes", tmp_path, settings)
    stage = run.stage_outputs["stage_3_complexification"]
    assert stage["semantic_preservation_failure_count"] == 2 and stage["complexified_count"] == 0
    assert list(run.stage_outputs) == list(runner.STAGE_NAMES)
    assert run.stage_outputs["stage_0_domain_run_spec"]["status"] == "placeholder"
    critics = run.stage_outputs["stage_4_dual_critic_quality_verification"]
    assert critics["agreements"] + critics["disagreements"] == critics["reviewed_samples"] == 2
    rows = ds.canonical_rows(run.tables["samples"], run.tables["judged"], run.manifest)
    assert len(rows.columns) == 14 and rows.count() == 2


def test_switches_turn_stages_off(spark):
    for preset_id, check in {"A1": lambda r: r.tables["nodes"].count() == 1, "A3": lambda r: r.tables["samples"].where("is_complexified").count() == 0, "A4": lambda r: r.tables["judged"].where("disagreement").count() == 0, "A5": lambda r: r.tables["judged"].where("disagreement AND quality_status = 'rejected'").count() == 0}.items():
        request = presets.run_request(preset_id)
        run = runner.plan(spark, request["domain_objective"], runner.Settings(switches=request["pipeline_config"]), request["seed"], request["model_ids"])
        assert check(run), preset_id


def test_stage_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "b")], schemas.TAXONOMY_EDGE)
    for run in ("r1", "r2"):
        documents.write_stage(df, str(tmp_path), "edges", run)
    assert documents.read_stage(spark, str(tmp_path), "edges", schemas.TAXONOMY_EDGE).where("run_id = 'r2'").count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        documents.write_stage(df, str(tmp_path), "edges", "r1")


def test_presets():
    assert presets.check_presets() == {"ok": True, "issues": [], "missing_fields": {}, "non_comparable_fields": []}
    broken = {p: presets.preset(p) for p in presets.PRESET_IDS}
    broken["A1"]["seed"] = 8
    del broken["A4"]["run_label"]
    checked = presets.check_presets(broken)
    assert checked["non_comparable_fields"] == ["seed"] and checked["missing_fields"] == {"A4": ["run_label"]} and not checked["ok"]
    with pytest.raises(ValueError):
        presets.preset("Z9")
    request = presets.run_request("A4")
    assert request["pipeline_config"]["single_critic_mode"] == "critic_a" and set(request["manifest_metadata"]) == set(presets.METADATA_FIELDS)


MANIFEST = {
    "run_id": "r", "created_at_utc": "t", "owner": "o", "branch": "b", "commit_hash": "c", "artifact_schema_version": "v1", "domain_objective": "d",
    "seed": 1, "model_ids": {"g": "m"}, "pipeline_config": {}, "protocol_version": "p", "baseline_or_ablation_tag": "B0",
}


def test_manifests():
    assert validate.check_manifest(MANIFEST)["ok"]
    assert validate.check_manifest({k: v for k, v in MANIFEST.items() if k != "owner"})["issues"] == ["missing required field: owner"]
    assert validate.check_manifest(MANIFEST | {"seed": True})["ok"]
    issues = validate.check_manifest(MANIFEST | {"run_id": " ", "seed": "1", "model_ids": {"g": ""}, "pipeline_config": [], "protocol_version": None})["issues"]
    assert len(issues) == 5 and "field model_ids must map to non-empty string identifiers" in issues
    validate.require_manifest(MANIFEST)
    for bad in ({"seed": "1"}, {"run_id": ""}, {"model_ids": {}}, {"protocol_version": " "}):
        with pytest.raises(ValueError):
            validate.require_manifest(MANIFEST | bad)
    with pytest.raises(ValueError, match="Missing required manifest field: seed"):
        validate.require_manifest({"run_id": "r"})


def test_folders(tmp_path):
    for name in validate.STAGE_FOLDERS:
        (tmp_path / name).mkdir()
    assert validate.check_folders(tmp_path)["ok"]
    (tmp_path / "60_evaluation").rmdir()
    assert validate.check_folders(tmp_path)["issues"] == ["missing required artifact stage directory: 60_evaluation"]
    assert not validate.check_folders(tmp_path / "no")["ok"]


def test_registry_works_without_the_training_data_package(tmp_path):
    for name in ("__spark_entry__.py", "lodestrata"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "lodestrata"
    package.mkdir()
    for part in (ROOT / "lodestrata").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (package / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'acceptance_by_lang' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
