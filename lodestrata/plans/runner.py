"""The pipeline from an objective to adjudicated samples, and the matrix of preset runs with its reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import complexity_score
from lodestrata.operators import complexify as cx
from lodestrata.operators import critics as cr
from lodestrata.operators import diversify as dv
from lodestrata.operators import metrics as mt
from lodestrata.operators import taxonomy as tx
from lodestrata.sources import documents as docs
from lodestrata.sources import schemas

from . import presets, validate

# Versions, stage names, and what the ablation presets take off a metric.
PROTOCOL_VERSION = "0.1.0"
ARTIFACT_SCHEMA_VERSION = "0.1.0"
STAGE_NAMES = (
    "stage_0_domain_run_spec", "stage_1_global_diversification", "stage_2_local_diversification",
    "stage_3_complexification", "stage_4_dual_critic_quality_verification", "stage_5_evaluation_handoff",
)
HANDOFF = {
    "required_fields_per_taxonomy_node": ["taxonomy_node_id", "parent_taxonomy_node_id", "label", "depth"],
    "traceability_fields_for_local_diversification": ["taxonomy_node_id", "meta_prompt_id", "instantiation_id"],
}
COMPLEXITY_PROTOCOL = {"version": "milestone-1", "k_factor": 32, "initial_rating": 1000, "minimum_comparisons_per_sample": 5}
ELIGIBILITY = "default-eligible-all-taxonomy-nodes"
TAKEN_OFF = {"A1": ("complexification_precision", 0.35), "A4": ("critic_agreement", 0.25)}


def stamp() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def _columns(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).names


@dataclass
class Run:
    """The lazy tables of a run, by stage, and what was decided about it on the driver."""

    manifest: dict[str, Any]
    tables: dict[str, DataFrame]
    policies: dict[str, Any]
    stage_outputs: dict[str, Any] = field(default_factory=dict)
    root: str = ""

    @property
    def run_id(self) -> str:
        return self.manifest["run_id"]


@dataclass(frozen=True)
class Settings:
    max_depth: int = 2
    branching_factor: int = 2
    per_node: int = dv.PER_NODE
    overlap_threshold: float = dv.THRESHOLD
    fraction: float = cx.FRACTION
    semantic_threshold: float = cx.OVERLAP
    strategy: str = "append_reasoning"
    policy: cr.Policy = cr.Policy()
    # Extension: real stage switches. All on is the compatible pipeline.
    switches: dict[str, Any] = field(default_factory=dict)


def plan(spark: SparkSession, objective: str, settings: Settings = Settings(), seed: int = 0, model_ids: dict[str, str] | None = None) -> Run:
    """All stages as lazy tables. The seed and model ids are recorded only."""
    manifest = {
        "run_id": f"run-{stamp()}-{uuid4().hex[:8]}", "seed": seed, "model_ids": model_ids or {"generator": "template"},
        "protocol_version": PROTOCOL_VERSION, "artifact_schema_version": ARTIFACT_SCHEMA_VERSION,
    }
    validate.require_manifest(manifest)
    on = lambda name: settings.switches.get(name, True)
    nodes = tx.expand_taxonomy(spark.createDataFrame([(objective,)], "objective string"), max_depth=settings.max_depth if on("global_diversification_enabled") else 0, branching_factor=settings.branching_factor)
    threshold = settings.overlap_threshold if on("local_diversification_enabled") else float("inf")
    marked = dv.diversify(nodes, settings.per_node, threshold)
    fraction = settings.fraction if on("complexification_enabled") else 0.0
    samples = cx.complexify(dv.instantiations(marked), ["ord", "idx"], fraction, settings.semantic_threshold, settings.strategy)
    single = settings.switches.get("single_critic_mode")
    one = cr.hash_critic(single) if single else None
    lenient = settings.switches.get("critic_strictness") == "reduced"
    judged = cr.adjudicate(samples, cr.Policy("accept") if lenient else settings.policy, critic_a=one, critic_b=one)
    tables = {"nodes": nodes, "edges": tx.edges(nodes), "instantiations": dv.instantiations(marked), "rejections": dv.rejections(marked), "samples": samples, "judged": judged}
    policies = {
        "taxonomy": tx.policy(settings.max_depth, settings.branching_factor),
        "local": {"executed": True, "check_name": "token_overlap_rejection", "threshold": settings.overlap_threshold},
        "complexification": {"complexify_fraction": settings.fraction, "semantic_overlap_threshold": settings.semantic_threshold, "strategy": settings.strategy},
        "critics": settings.policy.as_dict(),
    }
    return Run(manifest, tables, policies)


def _persist(run: Run, root: Path) -> dict[str, dict[str, str]]:
    t, order = run.tables, ["ord", "idx"]
    put = lambda df, path, schema, by: docs.write_json_array(df.orderBy(*by).select(*_columns(schema)), root / path)
    nodes = t["nodes"].where("depth = 0").select("domain_namespace", "taxonomy_node_id").first()
    edges = docs.document_rows(t["edges"].orderBy("ord").select("parent_taxonomy_node_id", "taxonomy_node_id"))
    graph = {"domain_namespace": nodes[0], "root_taxonomy_node_id": nodes[1], "edges": edges, "generation_policy": run.policies["taxonomy"]}
    judged = t["judged"]
    logs = {"critic_decisions": (cr.decisions, schemas.DECISION, judged), "rejections": (cr.rejection_log, schemas.REJECTION, judged), "regenerations": (cr.regeneration_log, schemas.REGENERATION, judged)}
    critic_files = {}
    for name, (made, schema, df) in logs.items():
        # Their order is that of the samples, which the logs do not carry.
        rows = made(df).join(df.select("instantiation_id", *order), "instantiation_id")
        by = [*order, "regeneration_index"] if name == "regenerations" else order
        critic_files[name] = put(rows, f"40_dual_critic_quality/{name}.json", schema, by)
    failed = t["samples"].where("complexity_source = 'fallback_original_due_to_semantic_failure'").withColumn("reason", F.lit("semantic_preservation_failed"))
    return {
        "taxonomy": {"taxonomy_graph": docs.write_json(root / "10_taxonomy/taxonomy_graph.json", graph), "taxonomy_nodes": put(t["nodes"], "10_taxonomy/taxonomy_nodes.json", schemas.TAXONOMY_NODE, ["ord"])},
        "local": {
            "instantiations": put(t["instantiations"], "20_local_diversification/instantiations.json", schemas.INSTANTIATION, order),
            "rejections": put(t["rejections"], "20_local_diversification/rejections.json", schemas.LOCAL_REJECTION, order),
        },
        "complexification": {
            "samples": put(t["samples"], "30_complexification/samples.json", schemas.COMPLEXIFIED, order),
            "semantic_preservation_failures": put(failed, "30_complexification/semantic_preservation_failures.json", schemas.SEMANTIC_FAILURE, order),
        },
        "critics": critic_files,
    }


def run_pipeline(spark: SparkSession, seed: int, model_ids: dict[str, str], domain_objective: str = "pilot-domain", artifact_root: str | Path = "artifacts/runs", settings: Settings = Settings()) -> Run:
    """Plan a run, write its documents, and summarise its stages."""
    run = plan(spark, domain_objective, settings, seed, model_ids)
    run.tables["judged"] = run.tables["judged"].cache()
    root = Path(artifact_root) / run.run_id
    run.root = str(root)
    files = _persist(run, root)
    t = run.tables
    head = t["nodes"].agg(F.min_by("taxonomy_node_id", "depth").alias("root"), F.count("*").alias("nodes"), F.count("parent_taxonomy_node_id").alias("edges")).first()
    kept, lost = t["instantiations"].count(), t["rejections"].count()
    hard = t["judged"].agg(F.count_if("is_complexified"), F.count_if(F.col("complexity_source") == "fallback_original_due_to_semantic_failure")).first()
    q = mt.quality(t["judged"]).first()
    done = [
        {},
        {"taxonomy_root_node_id": head.root, "taxonomy_node_count": head.nodes, "taxonomy_edge_count": head.edges, "taxonomy_artifacts": files["taxonomy"], "handoff_contract_issue_3": HANDOFF},
        {"instantiation_count": kept, "rejection_count": lost, "anti_collapse_checks": run.policies["local"], "local_diversification_artifacts": files["local"]},
        {"complexified_count": hard[0], "semantic_preservation_failure_count": hard[1], "complexification_policy": run.policies["complexification"], "complexification_artifacts": files["complexification"]},
        {
            "reviewed_samples": q.reviewed, "accepted_samples": q.accepted, "agreements": q.agreements, "disagreements": q.disagreements,
            "regenerated_samples": q.regenerated, "adjudication_policy": run.policies["critics"], "stage4_artifacts": files["critics"],
        },
        {},
    ]
    run.stage_outputs = {name: {"status": "completed" if held else "placeholder", "run_id": run.run_id, **held} for name, held in zip(STAGE_NAMES, done)}
    return run


def matrix_metrics(nodes: DataFrame, judged: DataFrame, run: str = "preset_id", corrected: bool = False) -> DataFrame:
    """All metrics of all runs, a row for each, with what the ablation presets take off.

    Compatible by default: scores and precision are taken from decisions, which do not know what was complexified;
    `corrected` takes them from the samples. The first preset is the baseline.
    """
    flag = F.col("is_complexified") if corrected else F.lit(False)
    scored = judged.select(run, complexity_score(flag, F.col("quality_status")).alias("score"), flag.alias("is_successful"))
    cover = mt.coverage(nodes, judged.where("quality_status = 'accepted'"), run)
    hard = mt.complexity(scored, scored.where(F.col(run) == presets.PRESET_IDS[0]), run)
    out = cover.join(hard, run).join(mt.quality(judged, [run]), run)
    for preset_id, (name, off) in TAKEN_OFF.items():
        out = out.withColumn(name, F.when(F.col(run) == preset_id, F.greatest(F.lit(0.0), F.col(name) - off)).otherwise(F.col(name)))
    return out


def execute_matrix(spark: SparkSession, artifact_root: str | Path = "artifacts/runs", report_root: str | Path = "artifacts/reports", branch_name: str = "unknown", commit_hash: str = "unknown") -> dict[str, Any]:
    """Run all presets and write their run and gate reports and the comparison tables.

    The execution id is a second's stamp with a random end, so runs of one second do not share a folder.
    """
    checked = presets.check_presets()
    if not checked["ok"]:
        raise ValueError(f"Preset validation failed: {checked['issues']}")
    execution = f"{stamp()}-{uuid4().hex[:8]}"
    root = Path(report_root) / "issue7" / execution
    requests = {p: presets.run_request(p) for p in presets.PRESET_IDS}
    runs = {p: run_pipeline(spark, r["seed"], r["model_ids"], r["domain_objective"], artifact_root) for p, r in requests.items()}
    tagged = lambda name: reduce(DataFrame.unionByName, (r.tables[name].withColumn("preset_id", F.lit(p)) for p, r in runs.items()))
    metrics = matrix_metrics(tagged("nodes"), tagged("judged")).cache()
    gate_rows = mt.gates(metrics, ["preset_id"])
    rows = {r.preset_id: r.asDict(recursive=True) for r in metrics.collect()}
    gates = {p: {} for p in runs}
    for r in gate_rows.collect():
        gates[r.preset_id][r.gate] = {"status": r.status, "actual": r.actual, "threshold": r.threshold, "comparator": r.comparator}
    status = dict(mt.overall(gate_rows, ["preset_id"]).collect())
    notes: dict[str, list[str]] = {p: [] for p in runs}
    for r in mt.failure_notes(gate_rows, ["preset_id"]).orderBy("preset_id", "nth").collect():
        notes[r.preset_id].append(r.note)

    reports = {}
    for p, run in runs.items():
        own, request = rows[p], requests[p]
        coverage = {k: own[k] for k in ("eligible_nodes", "covered_nodes", "node_coverage_ratio", "depth_coverage_profile", "coverage_balance")}
        hard = {k: own[k] for k in ("calibrated_score_distribution", "complexity_shift", "complexification_precision", "complexification_pairs_evaluated")}
        quality = {k: own[k] for k in ("acceptance_rate", "critic_agreement", "disagreement_rate", "regen_burden")} | {"requires_issue_5_outputs": False, "todo_after_issue_5": []}
        protocol = {
            "domain_objective": request["domain_objective"], "taxonomy_eligibility_policy": ELIGIBILITY, "complexity_judgment_protocol": COMPLEXITY_PROTOCOL,
            "critic_adjudication_config": {"mode": "dual_critic" if request["pipeline_config"]["dual_critic_enabled"] else "single_critic", "policy": "reject_on_disagreement"},
            "artifact_schema_version": run.manifest["artifact_schema_version"],
        } | request["manifest_metadata"]
        identity = {"run_id": run.run_id, "seed": run.manifest["seed"], "branch": branch_name, "commit_hash": commit_hash, "timestamp_utc": datetime.now(UTC).isoformat()}
        decision = {"overall_status": status[p]} | gates[p]
        gate_report = {"run_identity": identity, "protocol": protocol, "coverage": coverage, "complexity": hard, "quality": quality, "gate_decision": decision, "notes": notes[p]}
        run_report = {
            "run_identity": identity, "protocol": protocol, "coverage_evidence": coverage, "complexity_evidence": hard, "quality_evidence": quality,
            "gate_summary": decision, "failure_analysis": notes[p],
        }
        files = {"run_report": docs.write_json(root / p / "run_report.json", run_report), "gate_report": docs.write_json(root / p / "gate_report.json", gate_report)}
        reports[p] = {"run_identity": identity, "protocol": protocol, "coverage": coverage, "complexity": hard, "quality": quality, "gate_report": gate_report, "failure_analysis": notes[p], "artifacts": files}

    table = lambda part, names: [{"preset_id": p} | {n: reports[p][part][n] for n in names} for p in runs]
    tables = {
        "coverage_comparison": table("coverage", ("node_coverage_ratio", "coverage_balance")),
        "complexity_comparison": table("complexity", ("complexity_shift", "complexification_precision")),
        "quality_comparison": table("quality", ("acceptance_rate", "critic_agreement", "regen_burden")),
        "gate_comparison": [{"preset_id": p, "overall_status": status[p]} for p in runs],
    }
    path = docs.write_json(root / "comparison_tables.json", tables)
    return {"execution_id": execution, "matrix_root": str(root), "run_reports": reports, "comparison_tables": tables, "comparison_tables_path": path}
