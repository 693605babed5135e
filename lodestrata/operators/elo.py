"""Extension: Elo-style calibrated complexity from pairwise comparisons (the published Elo formula)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INITIAL = 1000.0
K = 32.0
MIN_COMPARISONS = 5
_OUT_ROWS = 10_000


def ratings(comparisons: DataFrame, initial: float = INITIAL, k: float = K, min_comparisons: int = MIN_COMPARISONS) -> DataFrame:
    """Rate the samples of each pool from comparisons (pool, seq, winner, loser), taken by seq, then winner and loser.

    Returns pool, sample, rating, comparisons, calibrated (enough comparisons). A comparison needs the ratings that
    the ones before it left, so a pool of any size is one sorted stream through one task. A sample is held from its
    first comparison to its last only.
    """
    text = [F.col(c).cast("string").alias(c) for c in ("pool", "winner", "loser")]
    games = comparisons.select("seq", *text)
    taken = games.select("pool", F.col("winner").alias("sample")).union(games.where("NOT winner <=> loser").select("pool", F.col("loser").alias("sample")))
    totals = taken.groupBy("pool", "sample").agg(F.count("*").alias("n"))
    for side in ("winner", "loser"):
        own = totals.select(F.col("pool").alias("p"), F.col("sample").alias("s"), F.col("n").alias(f"{side}_n"))
        games = games.join(own, F.col("pool").eqNullSafe(F.col("p")) & F.col(side).eqNullSafe(F.col("s"))).drop("p", "s")
    columns = ["pool", "winner", "loser", "winner_n", "loser_n"]
    stream = games.repartition("pool").sortWithinPartitions("pool", "seq", "winner", "loser").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[float, int]] = {}  # rating and comparisons of the samples that more comparisons follow for
        done: list[tuple] = []
        for batch in batches:
            for pool, winner, loser, winner_n, loser_n in zip(*(c.to_pylist() for c in batch.columns)):
                # All of a pool's samples are done before the next pool begins, so `held` has one pool's only.
                (a, m), (b, n) = held.get(winner, (initial, 0)), held.get(loser, (initial, 0))
                gained = k * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
                held[winner], held[loser] = (a + gained, m + 1), (b - gained, n + 1)
                for sample, total in {winner: winner_n, loser: loser_n}.items():
                    if held[sample][1] == total:
                        done.append((pool, sample, *held.pop(sample)))
            if len(done) >= _OUT_ROWS:
                yield packed(done)
                done = []
        if done:
            yield packed(done)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["pool", "sample", "rating", "comparisons"])

    found = stream.mapInArrow(run, "pool string, sample string, rating double, comparisons long")
    return found.withColumn("calibrated", F.col("comparisons") >= min_comparisons)
