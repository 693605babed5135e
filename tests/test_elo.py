import random

from pyspark.sql import functions as F

from lodestrata.operators import elo


def rate(games):
    score, seen = {}, {}
    for winner, loser in games:
        a, b = score.get(winner, 1000.0), score.get(loser, 1000.0)
        gained = 32.0 * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
        score[winner], score[loser] = a + gained, b - gained
        seen[winner], seen[loser] = seen.get(winner, 0) + 1, seen.get(loser, 0) + 1
    return {s: (score[s], seen[s]) for s in score}


def test_pools_match_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["p", "q", None]), seq, *(rng.choice(["a", "b", "c", "d", "e", None]) for _ in range(2))) for seq in range(400)]
    df = spark.createDataFrame(rows, "pool string, seq int, winner string, loser string").repartition(5)
    want = {(p, s): r for p in ("p", "q", None) for s, r in rate([x[2:] for x in rows if x[0] == p]).items()}
    got = elo.ratings(df).collect()
    assert {(r.pool, r.sample): (r.rating, r.comparisons) for r in got} == want and len(got) == len(want)


def test_a_pool_of_over_a_million_comparisons(spark):
    n = 1_000_003
    games = spark.range(n).select(F.lit("p").alias("pool"), F.col("id").alias("seq"), (F.col("id") * 7919 % 1009).alias("winner"), (1009 + F.col("id") * 31 % 1013).alias("loser"))
    got = {r.sample: (r.rating, r.comparisons) for r in elo.ratings(games).collect()}
    assert got == rate((str(i * 7919 % 1009), str(1009 + i * 31 % 1013)) for i in range(n))
