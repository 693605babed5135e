"""Run presets: the baseline and its ablations, and checks that they can be compared."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

# The presets of the published comparison, and the fields in which they must agree or be complete.
PRESET_IDS = ("B0", "A1", "A4")
SHARED = {
    "domain_objective": "pilot-domain",
    "seed": 7,
    "model_ids": {"generator": "gpt-4.1-mini", "critic_a": "gpt-4.1", "critic_b": "gpt-4.1"},
    "protocol_version": "0.1.0",
    "artifact_schema_version": "v1",
    "evaluation_protocol_version": "milestone-1",
}
METADATA_FIELDS = ("baseline_or_ablation_tag", "run_label", "hypothesis_focus", "protocol_version", "artifact_schema_version", "evaluation_protocol_version")
STAGE_SWITCHES = ("global_diversification_enabled", "local_diversification_enabled", "complexification_enabled", "dual_critic_enabled")
OWN = {
    "B0": ("baseline-full-pipeline", ["H1", "H2", "H3", "H4"], None),
    "A1": ("ablation-no-global-diversification", ["H1"], "global_diversification_enabled"),
    "A4": ("ablation-single-critic", ["H4"], "dual_critic_enabled"),
}
# Extension: the ablations that are documented only.
EXTRA = {
    "A2": ("ablation-no-local-diversification", ["H2"], "local_diversification_enabled"),
    "A3": ("ablation-no-complexification", ["H3"], "complexification_enabled"),
    "A5": ("ablation-reduced-critic-strictness", ["H4"], None),
}


def _preset(tag: str, label: str, focus: list[str], off: str | None) -> dict[str, Any]:
    switches: dict[str, Any] = {name: name != off for name in STAGE_SWITCHES}
    if tag == "A4":
        switches["single_critic_mode"] = "critic_a"
    if tag == "A5":
        switches["critic_strictness"] = "reduced"
    return {**deepcopy(SHARED), "baseline_or_ablation_tag": tag, "run_label": label, "hypothesis_focus": list(focus), "pipeline_config": switches}


def preset(preset_id: str) -> dict[str, Any]:
    """A fresh copy of a preset; ValueError for an unknown id."""
    own = OWN.get(preset_id) or EXTRA.get(preset_id)
    if own is None:
        raise ValueError(f"Unsupported preset_id: {preset_id}")
    return _preset(preset_id, *own)


def check_presets(presets: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """Whether all presets are complete and agree with the first in every field that comparisons rest on."""
    presets = presets if presets is not None else {p: preset(p) for p in PRESET_IDS}
    missing = {p: absent for p, held in presets.items() if (absent := [f for f in METADATA_FIELDS if f not in held])}
    base = next(iter(presets.values()))
    differing = {f: odd for f in SHARED if (odd := [p for p, held in presets.items() if held.get(f) != base.get(f)])}
    issues = [f"{p} missing required fields: {', '.join(absent)}" for p, absent in missing.items()]
    issues += [f"Comparability field {f} differs for preset {odd[0]}" for f, odd in differing.items()]
    return {"ok": not issues, "issues": issues, "missing_fields": missing, "non_comparable_fields": list(differing)}


def run_request(preset_id: str) -> dict[str, Any]:
    held = preset(preset_id)
    request = {name: held[name] for name in ("domain_objective", "seed", "model_ids", "pipeline_config")}
    return request | {"manifest_metadata": {name: held[name] for name in METADATA_FIELDS}}
