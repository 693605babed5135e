"""What the operators share: written tables, samples by hash, and shipping the package to executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.checkpoints import fresh_dir, materialize, shared_dir  # noqa: F401
from lodestrata.sources.shipping import BATCH_BYTES, ship  # noqa: F401


def quoted(name: str) -> str:
    """A column's name as it must be written where a dot would mean a field."""
    return f"`{name.replace('`', '``')}`"


def hash_sample(df: DataFrame, key: str, most: int, n: int | None = None) -> DataFrame:
    """At most `most` rows of `df`, those of least hash of `key`, the same in every run.

    A threshold on the hash first leaves about twice as many, so ordering them is cheap at any size of `df`.
    """
    n = df.count() if n is None else n
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if n > 2 * most:
        df = df.where(draw < int((1 << 40) * 2 * most / n))
    return df.orderBy(draw, key).limit(most)


#: A key is hot with more than this share of all rows, so there are fewer than 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def join_with_hot_keys(big: DataFrame, small: DataFrame, key: str, size: str) -> DataFrame:
    """Join `big` with `small`, which has one row for each key and the key's number of rows of `big` in `size`.

    Rows of hot keys meet their row by broadcast and stay where they are; the others are shuffled by the key. So no
    task gets a hot key's rows, whatever side adaptive execution broadcasts. The hot keys, fewer than 1 / HOT_SHARE at
    any size of the input, are known before the join, so both kinds are told apart by a filter and not by a join.
    """
    small = materialize(small, "keys")
    total, most = small.agg(F.sum(size), F.max(size)).first()
    least = (total or 0) * HOT_SHARE
    if (most or 0) <= least:
        return big.join(small, key)
    hot = small.where(F.col(size) > least)
    keys = [r[0] for r in hot.select(key).collect()]
    is_hot = F.col(key).isin(keys)
    return big.where(is_hot).join(F.broadcast(hot), key).union(big.where(~is_hot).join(small.where(F.col(size) <= least), key))
