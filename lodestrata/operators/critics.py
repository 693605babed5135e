"""Two independent critics, adjudication of their votes, and bounded regeneration. Row by row; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import hash_vote

IDS = ("instantiation_id", "taxonomy_node_id", "meta_prompt_id")
_UNKNOWN = {"instantiation_id": "unknown-sample", "taxonomy_node_id": "unknown-node", "meta_prompt_id": "unknown-meta"}

Critic = Callable[[Column], Column]


def hash_critic(name: str) -> Critic:
    return lambda text: hash_vote(text, name)


@dataclass(frozen=True)
class Policy:
    """What follows on a disagreement: reject, accept, or up to `max_regenerations` new attempts.

    `regenerate_both_reject` (an extension, off by default) gives samples that both critics reject the same attempts.
    """

    disagreement: str = "reject"
    max_regenerations: int = 1
    regenerate_both_reject: bool = False

    def __post_init__(self) -> None:
        if self.disagreement not in ("reject", "accept", "regenerate"):
            raise ValueError("disagreement_policy must be one of: reject, accept, regenerate")
        if self.max_regenerations < 0:
            raise ValueError("max_regenerations_per_sample must be >= 0")

    @classmethod
    def parse(cls, given: dict | None) -> Policy:
        given = given or {}
        return cls(str(given.get("disagreement_policy", "reject")), int(given.get("max_regenerations_per_sample", 1)))

    def as_dict(self) -> dict:
        return {"disagreement_policy": self.disagreement, "max_regenerations_per_sample": self.max_regenerations}


def adjudicate(samples: DataFrame, policy: Policy = Policy(), critic_a: Critic | None = None, critic_b: Critic | None = None) -> DataFrame:
    """The samples' columns with both votes, the decision, and `attempts`, the log of regenerations up to the first success.

    A null text is judged as an empty one. The text of a sample stays as it was, whatever attempt succeeded.
    """
    a, b = critic_a or hash_critic("critic_a"), critic_b or hash_critic("critic_b")
    text = F.coalesce(F.col("text"), F.lit(""))
    voted = samples.withColumns({"critic_a_decision": a(text), "critic_b_decision": b(text)})
    va, vb = F.col("critic_a_decision"), F.col("critic_b_decision")
    voted = voted.withColumn("disagreement", va != vb)
    tries = policy.max_regenerations if policy.disagreement == "regenerate" or policy.regenerate_both_reject else 0
    eligible = F.lit(False)
    if policy.disagreement == "regenerate":
        eligible = F.col("disagreement")
    if policy.regenerate_both_reject:
        eligible = eligible | ((va == "reject") & (vb == "reject"))
    none = F.array().cast("array<struct<regeneration_index:int,regenerated_text:string,critic_a_decision:string,critic_b_decision:string>>")
    attempts = none
    if tries:
        suffix, made = "", []
        for k in range(1, tries + 1):
            suffix += f" [regen-{k}]"
            new = F.concat(text, F.lit(suffix))
            made.append(F.struct(F.lit(k).alias("regeneration_index"), new.alias("regenerated_text"), a(new).alias("critic_a_decision"), b(new).alias("critic_b_decision")))
        both = F.transform(F.array(*made), lambda m: (m["critic_a_decision"] == "accept") & (m["critic_b_decision"] == "accept"))
        success = F.array_position(both, True).cast("int")
        attempts = F.when(eligible, F.slice(F.array(*made), 1, F.when(success > 0, success).otherwise(tries))).otherwise(none)
    voted = voted.withColumn("attempts", attempts)
    last = F.try_element_at("attempts", F.lit(-1))
    regenerated = F.coalesce((last["critic_a_decision"] == "accept") & (last["critic_b_decision"] == "accept"), F.lit(False))
    other = {"accept": "policy_accept_on_disagreement", "reject": "policy_reject_on_disagreement", "regenerate": "policy_regenerate_exhausted"}[policy.disagreement]
    reason = (
        F.when(regenerated, "regeneration_consensus_accept").when(F.col("disagreement"), other).when(va == "accept", "both_accept").otherwise("both_reject")
    )
    accepted = F.col("final_reason").isin("both_accept", "policy_accept_on_disagreement", "regeneration_consensus_accept")
    return voted.withColumn("final_reason", reason).withColumns(
        {
            "quality_status": F.when(accepted, "accepted").otherwise("rejected"),
            "adjudication_policy": F.lit(policy.disagreement),
            "regeneration_count": F.size("attempts"),
            "review_status": F.lit("reviewed"),
        }
    )


def _ids(df: DataFrame) -> list[Column]:
    return [(F.coalesce(F.col(c).cast("string"), F.lit(_UNKNOWN[c])) if c in df.columns else F.lit(_UNKNOWN[c])).alias(c) for c in IDS]


def decisions(judged: DataFrame) -> DataFrame:
    return judged.select(
        *_ids(judged), "critic_a_decision", "critic_b_decision", "disagreement", "adjudication_policy", "quality_status", "final_reason", "regeneration_count", "review_status"
    )


def accepted_samples(judged: DataFrame) -> DataFrame:
    return judged.where("quality_status = 'accepted'").drop("disagreement", "attempts", "final_reason", "adjudication_policy", "review_status")


def rejection_log(judged: DataFrame) -> DataFrame:
    lost = judged.where("quality_status = 'rejected'")
    return lost.select(*_ids(judged), F.col("final_reason").alias("reason"), "critic_a_decision", "critic_b_decision", "regeneration_count")


def regeneration_log(judged: DataFrame) -> DataFrame:
    return judged.select(*_ids(judged), F.explode("attempts").alias("x")).select(*IDS, "x.*")


def within_budget(judged: DataFrame, max_disagreement_rate: float) -> DataFrame:
    """Extension: where more than this share of samples is in disagreement, all of those are rejected."""
    rate = judged.agg((F.count_if("disagreement") / F.greatest(F.count("*"), F.lit(1))).alias("rate"))
    over = F.col("disagreement") & (F.col("rate") > max_disagreement_rate)
    out = judged.crossJoin(F.broadcast(rate))  # one row
    return out.withColumns(
        {"quality_status": F.when(over, "rejected").otherwise(F.col("quality_status")), "final_reason": F.when(over, "disagreement_budget_exceeded").otherwise(F.col("final_reason"))}
    ).drop("rate")
