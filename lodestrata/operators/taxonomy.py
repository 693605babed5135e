"""Taxonomy trees for any number of objectives, level by level, by narrow steps only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import normalize_label, overlap, seed_terms, taxonomy_id, token_set

MERGE_FILTER_STRATEGY = "normalize+deduplicate+parent-filter"
NODE_COLUMNS = ("taxonomy_node_id", "parent_taxonomy_node_id", "label", "depth", "branch_source", "confidence", "notes")


def policy(max_depth: int, branching_factor: int) -> dict:
    return {"max_depth": max_depth, "branching_factor": branching_factor, "merge_filter_strategy": MERGE_FILTER_STRATEGY}


def child_labels(label: F.Column, term: F.Column, branching_factor: int) -> F.Column:
    """Normalised, distinct labels of a node's children: of three candidates, one of which repeats the first."""
    basic = F.concat_ws(" ", label, term, F.lit("fundamentals"))
    candidates = F.array(basic, F.concat_ws(" ", label, term, F.lit("advanced")), F.concat(F.lit("  "), basic, F.lit("  ")))
    usable = F.filter(F.transform(candidates, normalize_label), lambda c: (c != "") & (c != normalize_label(label)))
    return F.slice(F.array_distinct(usable), 1, max(branching_factor, 1))


def expand_taxonomy(objectives: DataFrame, objective_col: str = "objective", max_depth: int = 2, branching_factor: int = 2) -> DataFrame:
    """All nodes of all objectives: domain_namespace, the node's columns, and ord, its place breadth-first.

    Every node has as many children as the first (the candidates are two different labels), so a node's place
    follows from its parent's and no window is needed. Null objectives give no tree.
    """
    fan = min(max(branching_factor, 1), 2)
    name = normalize_label(F.col("objective"))
    space = F.when(name != "", name).otherwise(F.lit("domain"))
    root = objectives.select(F.col(objective_col).alias("objective")).where("objective IS NOT NULL")
    root = root.select(space.alias("domain_namespace"), seed_terms(F.col("objective")).alias("terms"))
    label = F.concat(F.col("domain_namespace"), F.lit(" root"))
    none = F.lit(None).cast("string")
    level = root.select(
        "domain_namespace", "terms", taxonomy_id(F.col("domain_namespace"), none, label).alias("taxonomy_node_id"), none.alias("parent_taxonomy_node_id"),
        label.alias("label"), F.lit(0).alias("depth"), F.lit("seed").alias("branch_source"), F.lit(1.0).alias("confidence"),
        F.lit("root taxonomy node").alias("notes"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("ord"),
    )
    levels, first = [level], 1
    for depth in range(max_depth):
        term = F.expr(f"element_at(terms, {depth} % size(terms) + 1)")
        kids = level.select("domain_namespace", "terms", F.col("taxonomy_node_id").alias("up"), "nth", F.posexplode(child_labels(F.col("label"), term, branching_factor)).alias("pos", "label"))
        nth = F.col("nth") * fan + F.col("pos")
        level = kids.select(
            "domain_namespace", "terms", taxonomy_id(F.col("domain_namespace"), F.col("up"), F.col("label")).alias("taxonomy_node_id"),
            F.col("up").alias("parent_taxonomy_node_id"), "label", F.lit(depth + 1).alias("depth"), F.lit("recursive-expansion").alias("branch_source"),
            F.lit(0.8).alias("confidence"), F.concat(F.lit("generated from parent "), F.col("up")).alias("notes"), nth.alias("nth"), (nth + first).alias("ord"),
        )
        levels.append(level)
        first += fan ** (depth + 1)
    return reduce(DataFrame.unionByName, levels).drop("terms", "nth")


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_taxonomy_node_id IS NOT NULL").select("domain_namespace", "parent_taxonomy_node_id", "taxonomy_node_id", "ord")


def integrity(nodes: DataFrame) -> DataFrame:
    """For each namespace: n_nodes, n_edges, n_roots, n_orphans, n_repeated_ids, is_tree.

    Depths grow by one from parent to child, so a table without orphans and repeated ids has no cycle.
    """
    up = nodes.select("domain_namespace", F.col("taxonomy_node_id").alias("parent_taxonomy_node_id"), F.col("depth").alias("up_depth")).distinct()
    placed = nodes.join(up, ["domain_namespace", "parent_taxonomy_node_id"], "left")
    is_root = F.col("parent_taxonomy_node_id").isNull()
    orphan = ~is_root & (F.col("up_depth").isNull() | (F.col("up_depth") + 1 != F.col("depth")))
    counted = placed.groupBy("domain_namespace").agg(
        F.count("*").alias("n_nodes"), F.count_if(~is_root).alias("n_edges"), F.count_if(is_root).alias("n_roots"),
        F.count_if(orphan).alias("n_orphans"), (F.count("*") - F.countDistinct("taxonomy_node_id")).alias("n_repeated_ids"),
    )
    return counted.withColumn("is_tree", (F.col("n_roots") == 1) & (F.col("n_orphans") == 0) & (F.col("n_repeated_ids") == 0))


def similar_siblings(nodes: DataFrame, max_overlap: float = 0.8) -> DataFrame:
    """Extension: pairs of siblings whose labels overlap by `max_overlap` or more, as candidates to merge. Siblings are at most two for each parent."""
    side = nodes.where("parent_taxonomy_node_id IS NOT NULL").select("domain_namespace", "parent_taxonomy_node_id", "taxonomy_node_id", "ord", token_set(F.col("label")).alias("t"))
    a, b = side.alias("a"), side.alias("b")
    same = (F.col("a.domain_namespace") == F.col("b.domain_namespace")) & (F.col("a.parent_taxonomy_node_id") == F.col("b.parent_taxonomy_node_id")) & (F.col("a.ord") < F.col("b.ord"))
    ratio = overlap(F.col("a.t"), F.col("b.t"))
    return a.join(b, same).where(ratio >= max_overlap).select(F.col("a.domain_namespace"), F.col("a.taxonomy_node_id").alias("kept_id"), F.col("b.taxonomy_node_id").alias("merged_id"), ratio.alias("overlap"))
