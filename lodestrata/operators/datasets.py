"""Extensions: the curated dataset with its splits, and the canonical row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_split(accepted: DataFrame, key: str = "instantiation_id", evaluation_percent: int = 10) -> DataFrame:
    """Add split (train or evaluation) by a hash of the key, so a sample never changes sides."""
    bucket = F.conv(F.substring(F.sha1(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    return accepted.withColumn("split", F.when(bucket < evaluation_percent, "evaluation").otherwise("train"))


def canonical_rows(samples: DataFrame, judged: DataFrame, run: dict[str, Any]) -> DataFrame:
    """The documented 14-column row of each judged sample, with what is known of its run."""
    own = samples.select("instantiation_id", "taxonomy_node_id", "meta_prompt_id", "text", "is_complexified", "complexity_source")
    votes = judged.select("instantiation_id", "critic_a_decision", "critic_b_decision", "quality_status", "regeneration_count")
    models = F.create_map(*(F.lit(x) for item in run["model_ids"].items() for x in item))
    joined = own.join(votes, "instantiation_id")
    return joined.select(
        F.lit(run["run_id"]).alias("run_id"), F.concat(F.lit("sample-"), F.substring(F.sha1("instantiation_id"), 1, 12)).alias("sample_id"),
        "taxonomy_node_id", "meta_prompt_id", "instantiation_id", "is_complexified", "complexity_source", "critic_a_decision", "critic_b_decision",
        "quality_status", "regeneration_count", F.lit(run["seed"]).alias("seed"), models.alias("model_ids"), F.lit(run.get("timestamp_utc")).alias("timestamp_utc"),
    )
