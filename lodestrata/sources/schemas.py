"""Declared schemas of all records, so that empty files read as typed tables."""

_IDS = "taxonomy_node_id STRING, meta_prompt_id STRING"
_LINEAGE = "lineage STRUCT<taxonomy_node_id: STRING, meta_prompt_id: STRING, instantiation_id: STRING>"

TAXONOMY_NODE = "taxonomy_node_id STRING, parent_taxonomy_node_id STRING, label STRING, depth INT, branch_source STRING, confidence DOUBLE, notes STRING"
TAXONOMY_EDGE = "parent_taxonomy_node_id STRING, taxonomy_node_id STRING"
INSTANTIATION = f"instantiation_id STRING, {_IDS}, {_LINEAGE}, text STRING"
LOCAL_REJECTION = f"reason STRING, {_IDS}, candidate_instantiation_id STRING"
COMPLEXIFIED = f"{INSTANTIATION}, is_complexified BOOLEAN, complexity_source STRING, source_intent STRING"
SEMANTIC_FAILURE = f"instantiation_id STRING, {_IDS}, reason STRING, source_intent STRING, candidate_text STRING, semantic_overlap_ratio DOUBLE"
DECISION = (
    f"instantiation_id STRING, {_IDS}, critic_a_decision STRING, critic_b_decision STRING, disagreement BOOLEAN, adjudication_policy STRING, "
    "quality_status STRING, final_reason STRING, regeneration_count INT, review_status STRING"
)
REJECTION = f"instantiation_id STRING, {_IDS}, reason STRING, critic_a_decision STRING, critic_b_decision STRING, regeneration_count INT"
REGENERATION = f"instantiation_id STRING, {_IDS}, regeneration_index INT, regenerated_text STRING, critic_a_decision STRING, critic_b_decision STRING"
GATE = "gate STRING, status STRING, actual DOUBLE, threshold DOUBLE, comparator STRING"
