"""Coverage, complexity and quality metrics, gates on them, and notes on failed gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import safe_ratio

# Gate, comparator, threshold.
GATES = (
    ("coverage.node_coverage_ratio", ">=", 0.80),
    ("coverage.min_depth_coverage", ">=", 0.60),
    ("complexity.complexification_precision", ">=", 0.70),
    ("quality.critic_agreement", ">=", 0.75),
    ("quality.acceptance_rate", ">=", 0.50),
    ("quality.regen_burden", "<=", 1.00),
)
QUALITY_TODO = (
    "wire dual-critic per-sample decisions",
    "wire deterministic disagreement outcomes",
    "wire regeneration logs and accepted sample totals",
)
NO_FAILURE = "No threshold failures detected for this run."


def _by(df: DataFrame, run: str | None) -> tuple[DataFrame, str]:
    return (df, run) if run else (df.withColumn("__run", F.lit(0)), "__run")


def _one_row(df: DataFrame, zeros: dict[str, Column]) -> DataFrame:
    """The one row of `df`, or a row of `zeros` if it has none."""
    nothing = df.sparkSession.range(1).select(F.lit(True).alias("__only"))
    found = nothing.join(F.broadcast(df.withColumn("__only", F.lit(True)).withColumn("__there", F.lit(True))), "__only", "left")  # one row each
    return found.select(*(F.when(F.col("__there"), F.col(c)).otherwise(zeros[c]).alias(c) if c in zeros else F.col(c) for c in df.columns))


def node_counts(nodes: DataFrame, accepted: DataFrame, run: str) -> DataFrame:
    """Accepted samples of every eligible node, zeros included: run, node id, depth, cnt. Samples are summed before the join."""
    counts = accepted.groupBy(run, "taxonomy_node_id").agg(F.count("*").alias("cnt"))
    return nodes.select(run, "taxonomy_node_id", "depth").join(counts, [run, "taxonomy_node_id"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def gini(counts: DataFrame, run: str, value: str = "cnt") -> DataFrame:
    """Gini index of each run's values, 0 if there is none or all are zero.

    The sum over ascending values of place * value is taken by distinct value (m rows of value v after k rows add
    v * (m * k + m * (m + 1) / 2)), so windows run over few rows, not over all nodes.
    """
    steps = counts.groupBy(run, value).agg(F.count("*").alias("m"))
    before = Window.partitionBy(run).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("k", F.coalesce(F.sum("m").over(before), F.lit(0)))
    places = F.expr(f"{value} * (m * k + m * (m + 1) div 2)")
    sums = steps.groupBy(run).agg(F.sum("m").alias("n"), F.sum(F.col(value) * F.col("m")).alias("s"), F.sum(places).alias("w"))
    n, s, w = (F.col(c).cast("double") for c in "nsw")
    return sums.select(run, F.when(s == 0, F.lit(0.0)).otherwise(F.try_divide(2 * w, n * s) - (n + 1) / n).alias("gini"))


def depth_profile(counts: DataFrame, run: str) -> DataFrame:
    covered = F.count_if(F.col("cnt") > 0)
    return counts.groupBy(run, "depth").agg(F.count("*").alias("total"), covered.alias("covered"), safe_ratio(covered, F.count("*")).alias("ratio"))


def coverage(nodes: DataFrame, accepted: DataFrame, run: str | None = None) -> DataFrame:
    """eligible_nodes, covered_nodes, node_coverage_ratio, depth_coverage_profile, coverage_balance, min_depth_coverage; a row for each run.

    Nodes that repeat an id count once, but by row in the depth profile. Without accepted samples all counts are equal, so the balance is 1. Without a
    `run` there is always one row; without nodes it has zeros, an empty profile and a balance of 1.
    """
    nodes, by = _by(nodes, run)
    accepted, _ = _by(accepted, run)
    counts = node_counts(nodes, accepted, by)
    profile = depth_profile(counts, by)
    once = counts.groupBy(by, "taxonomy_node_id").agg(F.max("cnt").alias("cnt"))
    ids = once.groupBy(by).agg(F.count("*").alias("eligible_nodes"), F.count_if(F.col("cnt") > 0).alias("covered_nodes"))
    whole = profile.groupBy(by).agg(
        F.min("ratio").alias("min_depth_coverage"),
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ratio"))), lambda e: F.struct(e["depth"].cast("string"), e["ratio"]))).alias("depth_coverage_profile"),
    )
    balance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("gini"))).alias("coverage_balance")
    out = whole.join(ids, by).join(gini(once, by), by).select(
        by, "eligible_nodes", "covered_nodes", safe_ratio(F.col("covered_nodes"), F.col("eligible_nodes")).alias("node_coverage_ratio"), "depth_coverage_profile", balance, "min_depth_coverage"
    )
    if run:
        return out
    zero, none = F.lit(0.0), F.create_map().cast("map<string,double>")
    return _one_row(out.drop("__run"), {"eligible_nodes": F.lit(0).cast("long"), "covered_nodes": F.lit(0).cast("long"), "node_coverage_ratio": zero, "depth_coverage_profile": none, "coverage_balance": F.lit(1.0), "min_depth_coverage": zero})


def percentiles(score: Column) -> Column:
    exact = F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.struct(*(F.coalesce(exact[i], F.lit(0.0)).alias(f"p{p}") for i, p in enumerate((25, 50, 75))))


def complexity(scored: DataFrame, baseline: DataFrame, run: str | None = None) -> DataFrame:
    """calibrated_score_distribution, complexity_shift, complexification_precision, complexification_pairs_evaluated.

    `scored` has score and is_successful, `baseline` has score. The shift is median minus median, 0 if either is empty.
    Without a `run` there is always one row, of zeros if nothing is scored.
    """
    scored, by = _by(scored, run)
    own = scored.groupBy(by).agg(
        percentiles(F.col("score")).alias("calibrated_score_distribution"), F.median("score").alias("own"),
        safe_ratio(F.count_if("is_successful"), F.count("*")).alias("complexification_precision"), F.count("*").alias("complexification_pairs_evaluated"),
    )
    base = baseline.agg(F.median("score").alias("base"))  # one row
    shift = F.coalesce(F.col("own") - F.col("base"), F.lit(0.0)).alias("complexity_shift")
    out = own.crossJoin(F.broadcast(base)).select(by, "calibrated_score_distribution", shift, "complexification_precision", "complexification_pairs_evaluated")
    if run:
        return out
    zero = F.lit(0.0)
    none = F.struct(zero.alias("p25"), zero.alias("p50"), zero.alias("p75"))
    return _one_row(out.drop("__run"), {"calibrated_score_distribution": none, "complexity_shift": zero, "complexification_precision": zero, "complexification_pairs_evaluated": F.lit(0).cast("long")})


def quality(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """reviewed, accepted, agreements, disagreements, regenerated, and acceptance_rate, critic_agreement, disagreement_rate, regen_burden.

    `judged` has quality_status, disagreement and regeneration_count. The burden is by accepted samples, or by 1 if none.
    """
    counted = judged.groupBy(*(by or [])).agg(
        F.count("*").alias("reviewed"), F.count_if(F.col("quality_status") == "accepted").alias("accepted"),
        F.count_if(~F.col("disagreement")).alias("agreements"), F.count_if("disagreement").alias("disagreements"),
        F.coalesce(F.sum("regeneration_count"), F.lit(0)).alias("regenerated"),
    )
    rates = {"acceptance_rate": "accepted", "critic_agreement": "agreements", "disagreement_rate": "disagreements"}
    out = counted.withColumns({name: safe_ratio(F.col(c), F.col("reviewed")) for name, c in rates.items()})
    return out.withColumn("regen_burden", safe_ratio(F.col("regenerated"), F.greatest("accepted", F.lit(1))))


def quality_stub(spark) -> DataFrame:
    """The quality metrics of a run without adjudication: all null, so that their gates are open."""
    rates = ", ".join(f"CAST(NULL AS DOUBLE) AS {r}" for r in ("acceptance_rate", "critic_agreement", "disagreement_rate", "regen_burden"))
    todo = ", ".join(f"'{t}'" for t in QUALITY_TODO)
    return spark.sql(f"SELECT {rates}, true AS requires_issue_5_outputs, array({todo}) AS todo_after_issue_5")


def gates(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each gate: keys, gate, status (pass, fail, todo), actual, threshold, comparator.

    `metrics` has a column for each gate's last name; a null value is open (todo).
    """
    rows = ", ".join(f"'{g}', CAST({g.rsplit('.', 1)[1]} AS DOUBLE), CAST({t} AS DOUBLE), '{c}'" for g, c, t in GATES)
    long = metrics.select(*keys, F.expr(f"stack({len(GATES)}, {rows}) AS (gate, actual, threshold, comparator)"))
    passed = F.when(F.col("comparator") == ">=", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    status = F.when(F.col("actual").isNull(), "todo").when(passed, "pass").otherwise("fail")
    return long.select(*keys, "gate", status.alias("status"), "actual", "threshold", "comparator")


def overall(gate_rows: DataFrame, keys: list[str]) -> DataFrame:
    status = F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status") == "todo"), "todo").otherwise("pass")
    return gate_rows.groupBy(*keys).agg(status.alias("overall_status"))


def failure_notes(gate_rows: DataFrame, keys: list[str]) -> DataFrame:
    """A note for each failed gate, or one that there is none."""
    order = F.create_map(*(x for i, (g, _, _) in enumerate(GATES) for x in (F.lit(g), F.lit(i))))
    note = F.concat(F.lit("Failed threshold: "), "gate", F.lit(" ("), F.col("actual").cast("string"), F.lit(" "), "comparator", F.lit(" "), F.col("threshold").cast("string"), F.lit(")."))
    failed = F.when(F.col("status") == "fail", F.struct(order[F.col("gate")].alias("nth"), note.alias("note")))
    listed = gate_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(failed)).alias("notes"))  # six at most
    notes = F.when(F.size("notes") > 0, F.transform("notes", lambda n: n["note"])).otherwise(F.array(F.lit(NO_FAILURE)))
    return listed.select(*keys, F.posexplode(notes).alias("nth", "note"))


def shift_by(scored: DataFrame, baseline: DataFrame, segment: str) -> DataFrame:
    """Extension: the complexity shift in each segment (such as a depth); 0 where the baseline has none."""
    own = scored.groupBy(segment).agg(F.median("score").alias("own"))
    base = baseline.groupBy(segment).agg(F.median("score").alias("base"))
    return own.join(base, segment, "left").select(segment, F.coalesce(F.col("own") - F.col("base"), F.lit(0.0)).alias("complexity_shift"))


def classify_rerun(first: DataFrame, second: DataFrame, metric_deltas: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Extension: one row, exact (equal rows), drift (unequal rows, every |delta| within `tolerance`) or mismatch."""
    missing = first.exceptAll(second).agg(F.count("*").alias("missing"))
    added = second.exceptAll(first).agg(F.count("*").alias("added"))
    worst = metric_deltas.agg(F.coalesce(F.max(F.abs("delta")), F.lit(0.0)).alias("worst"))
    status = F.when((F.col("missing") == 0) & (F.col("added") == 0), "exact").when(F.col("worst") <= tolerance, "drift").otherwise("mismatch")
    return missing.crossJoin(added).crossJoin(worst).select(status.alias("classification"), "missing", "added", "worst")  # one row each


#: Extension: for each hypothesis the ablation it is judged against, and the metrics in which the baseline must be better.
HYPOTHESES = (
    ("H1", "A1", ("node_coverage_ratio", "min_depth_coverage")),
    ("H2", "A2", ("local_diversity",)),
    ("H3", "A3", ("median_complexity",)),
    ("H4", "A4", ("critic_agreement",)),
)
_QUALITY_BOUNDS = "critic_agreement >= 0.75 AND acceptance_rate >= 0.5 AND regen_burden <= 1.0"


def hypotheses(metrics: DataFrame, run: str = "preset_id", baseline: str = "B0") -> DataFrame:
    """Extension: hypothesis, ablation, accepted. A row for each hypothesis whose ablation was run.

    The baseline must exceed the ablation in each of its metrics; H3 also wants the baseline within the quality bounds.
    A null metric leaves the hypothesis open (null).
    """
    rows = F.array(*(F.struct(F.lit(h).alias("hypothesis"), F.lit(a).alias("ablation")) for h, a, _ in HYPOTHESES))
    base = metrics.where(F.col(run) == baseline)
    names = [c for c in metrics.columns if c != run]
    base = base.select(*(F.col(c).alias(f"base_{c}") for c in names), F.expr(_QUALITY_BOUNDS).alias("bounded"))  # one row
    paired = metrics.withColumn("h", F.explode(rows)).where(F.col(run) == F.col("h.ablation")).crossJoin(F.broadcast(base))
    verdict = F.lit(None).cast("boolean")
    for name, _, wanted in HYPOTHESES:
        better = F.lit(True)
        for metric in wanted:
            better = better & ((F.col(f"base_{metric}") > F.col(metric)) if metric in names else F.lit(None).cast("boolean"))
        if name == "H3":
            better = better & F.col("bounded")
        verdict = F.when(F.col("h.hypothesis") == name, better).otherwise(verdict)
    return paired.select("h.hypothesis", "h.ablation", verdict.alias("accepted"))
