"""Rewriting the first part of an ordered table to be harder, with a check that meaning is preserved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import overlap, token_set

from .ordered import running_sums

FRACTION = 0.5
OVERLAP = 0.55

# The sentences of the two strategies.
REASONING = " Include a multi-step justification, evaluate one plausible distractor, and articulate why the final decision resolves ambiguity."
DRIFT_PROBE = "Compute prime factorization of 163 and explain each arithmetic step."

STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "append_reasoning": lambda text: F.concat(text, F.lit(REASONING)),
    "semantic_drift_probe": lambda text: F.lit(DRIFT_PROBE),
}


def rewriter(strategy: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The named strategy; a callable of text to text is taken as it is."""
    if callable(strategy):
        return strategy
    if strategy not in STRATEGIES:
        raise ValueError(f"Unsupported complexification strategy: {strategy}")
    return STRATEGIES[strategy]


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """Add pos, the row's place (from 0) in the order of `order`, whose values are unique.

    No task sees more than a range of the rows.
    """
    return running_sums(df, order, {"pos": F.lit(1)})


def with_limit(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """Add pos and limit: the first round(n * fraction) rows, half to even, are those with pos < limit."""
    placed = with_position(df, order)
    limit = placed.agg(F.rint(F.count("*") * F.lit(fraction)).alias("limit"))
    return placed.crossJoin(F.broadcast(limit))  # one row


def complexify(samples: DataFrame, order: list[str], fraction: float = FRACTION, threshold: float = OVERLAP, strategy: str | Callable[[Column], Column] = "append_reasoning") -> DataFrame:
    """Rewrite the first round(n * fraction) rows, half to even; add is_complexified, complexity_source, source_intent.

    A rewritten text that overlaps its source by less than `threshold` is given up for the source. candidate_text and
    semantic_overlap_ratio (null for rows that were not selected) are kept for the log. Arguments are checked first,
    so an unknown strategy fails even if no row would be selected.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("complexify_fraction must be between 0 and 1")
    rewrite = rewriter(strategy)
    chosen = F.col("pos") < F.col("limit")
    placed = with_limit(samples, order, fraction).withColumn("source_intent", F.col("text"))
    placed = placed.withColumn("candidate_text", F.when(chosen, rewrite(F.col("text"))))
    ratio = F.when(chosen, overlap(token_set(F.col("source_intent")), token_set(F.col("candidate_text"))))
    placed = placed.withColumn("semantic_overlap_ratio", ratio)
    good = chosen & (F.col("semantic_overlap_ratio") >= threshold)
    source = F.when(good, "complexification_transform_v1").when(chosen, "fallback_original_due_to_semantic_failure").otherwise("original")
    out = placed.withColumns({"is_complexified": F.coalesce(good, F.lit(False)), "complexity_source": source, "text": F.when(good, F.col("candidate_text")).otherwise(F.col("text"))})
    return out.drop("pos", "limit")


def semantic_failures(complexified: DataFrame) -> DataFrame:
    failed = complexified.where("complexity_source = 'fallback_original_due_to_semantic_failure'")
    keep = [c for c in ("instantiation_id", "taxonomy_node_id", "meta_prompt_id") if c in complexified.columns]
    return failed.select(*keep, F.lit("semantic_preservation_failed").alias("reason"), "source_intent", "candidate_text", "semantic_overlap_ratio")
