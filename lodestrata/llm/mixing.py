"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key at the rate of its quality weight. A source's target is met by
complete epochs over all its documents, then by the documents of least keys, up to the word budget that
is left. The budget becomes one threshold on (key, tie, row) for each source, so nothing about single
documents is gathered, and the documents themselves are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ordered import running_sums

from .shared import materialize, quoted

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20260
#: Key buckets per unit of key: about 1 / BUCKETS of a source's documents, at most, are in one bucket.
BUCKETS = 4096
#: Sources whose thresholds may be broadcast (about 100 bytes each); with more, they are joined by shuffling.
BROADCAST_SOURCES = 100_000

_SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less the more symbols there are for each word; at least 0.05."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, _SYMBOLS, "")), F.lit(0))
    return F.greatest(F.lit(0.05), 1 / (1 + symbols / F.greatest(size, F.lit(1))))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """Add weight and target to a table with one row for each source (source, source_size).

    Sources by code point, null last, take the weights in turn. They share `share` of all words by weight; a
    target stops at `most` times its source's size and the excess is shared again, until none is above. With the
    sources in order of size by weight, those that stop come first, and the level of the others follows from sums.
    Places and sums are taken by ranges, so the sources, which may be as many as hosts, never meet in one task.
    """
    each = F.array(*map(F.lit, weights))
    ranked = running_sums(sizes.withColumn("null_last", F.col("source").isNull()), ["null_last", "source"], {"nth": F.lit(1)})
    ranked = ranked.withColumn("weight", F.element_at(each, F.pmod(F.col("nth"), F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("ratio", F.col("source_size") / F.col("weight"))
    ranked = materialize(running_sums(ranked, ["ratio", "nth"], {"sizes_before": F.col("source_size"), "weights_before": F.col("weight")}), "mix-sources")
    whole = F.broadcast(ranked.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights")))  # one row
    cap = F.col("source_size") * F.lit(most)
    level = (F.col("all_sizes") * F.lit(share) - F.col("sizes_before") * F.lit(most)) / (F.col("all_weights") - F.col("weights_before"))
    ranked = ranked.crossJoin(whole).withColumn("level", level).withColumn("full", cap <= F.col("level") * F.col("weight"))
    # The level of the first source that does not stop holds for all such.
    rest = ranked.agg(F.min(F.when(~F.col("full"), F.struct("ratio", "nth", "level")))["level"].alias("rest"))  # one row
    ranked = ranked.crossJoin(F.broadcast(rest))
    return ranked.select(*sizes.columns, "weight", F.when(F.col("full"), cap).otherwise(F.col("rest") * F.col("weight")).cast("double").alias("target"))


def _keyed(docs: DataFrame, own: list[str], id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None) -> DataFrame:
    """Written once: the documents' columns `own` as c0, c1 and so on, with source_key, source, size, key, tie and row, a number of the row."""
    named = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(own)), *(F.col(quoted(c)).alias(a) for a, c in (("id", id_col), ("text", text_col), ("source", source_col))))
    text = F.col("text")
    draw = F.xxhash64(F.lit(seed), "id", text)
    uniform = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    sized = named.withColumns({"source": F.col("source").cast("string"), "size": word_count(text), "u": uniform, "tie": F.xxhash64(F.lit(seed + 1), "id", text)})
    w = weight if weight is not None else quality_weight(text, F.col("size"))
    # Null sources join like others.
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    columns = [f"c{i}" for i in range(len(own))]
    keyed = sized.select(*columns, name.alias("source_key"), "source", "size", (-F.log("u") / w).alias("key"), "tie", F.monotonically_increasing_id().alias("row"))
    return materialize(keyed, "mix-keys")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """The documents' columns without the text, with size, source_size, target, epochs, selected, taken in place of columns of these names.

    size: words `[^\\x20\\x09-\\x0D]+` (null text: 0). A document is taken in every complete epoch of its source,
    and once more if it is among the least keys that fill the rest of the target; the last one taken is that at
    whose middle the budget ends, so a source is off its target by half a document at most. Draws depend on the
    seed, id and text only, so reruns agree; rows that repeat id and text share a draw, and where the budget ends
    among them as many are taken as it holds, which of these equal rows does not matter. A null source is a source,
    a null id is an id like others. Further columns are passed on; an empty table gives an empty one. `weight`
    replaces the quality weight, as a positive column over size and text.
    """
    added = ["size", "source_size", "target", "epochs", "selected", "taken"]
    own = [c for c in docs.columns if c != text_col and c.lower() not in added]
    keyed = _keyed(docs, own, id_col, text_col, source_col, seed, weight)
    return _taken(keyed, source_limits(keyed)).select(*(f"c{i}" for i in range(len(own))), *added).toDF(*own, *added)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """The mix itself: the documents' columns, each row as often as it is taken (see `mix_sources`); rows without words do not appear."""
    own = docs.columns
    keyed = _keyed(docs, own, id_col, text_col, source_col, seed, weight)
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("selected").cast("long")).otherwise(F.lit(0)).cast("int")
    copies = _taken(keyed, source_limits(keyed)).withColumn("times", times).where("times > 0")
    columns = [f"c{i}" for i in range(len(own))]
    return copies.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select(*columns).toDF(*own)


def source_limits(keyed: DataFrame) -> DataFrame:
    """For each source of (source_key, source, size, key, tie, row): source_key, source_size, target, epochs and the last (key, tie, row) that is selected."""
    meta = keyed.select("source_key", "source", "size", "key", "tie", "row", F.floor(F.col("key") * BUCKETS).alias("bucket"))
    sizes = meta.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES

    def sided(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # One step after another narrows down where the budget ends: a bucket of keys, a (key, tie) in it, and, if several
    # rows share that one, a task's rows and a row of them. Each step looks at sums of the one before.
    def crossed(rows: DataFrame, by: str, before: DataFrame) -> DataFrame:
        """For each source the last value of `by` that begins within the budget: source_key, by, before (words up to it), rest."""
        sums = rows.groupBy("source_key", by).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source_key").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("within", F.coalesce(F.sum("words").over(up_to), F.lit(0))).join(sided(before), "source_key")
        sums = sums.withColumn("reached", F.col("before") + F.col("within")).where("reached <= rest")
        found = sums.groupBy("source_key").agg(F.max_by(F.struct(by, F.col("reached").alias("before"), "rest"), by).alias("at"))
        return materialize(found.select("source_key", "at.*"), "mix-crossed")

    meta = meta.withColumns({"draw": F.struct("key", "tie"), "part": F.shiftrightunsigned("row", 33)})
    state = plan.where("rest > 0").select("source_key", F.lit(0).cast("long").alias("before"), "rest")
    for by in ("bucket", "draw", "part"):
        state = crossed(meta, by, state.select("source_key", "before", "rest"))
        meta = meta.join(sided(state.select("source_key", by)), ["source_key", by])
    upto = Window.partitionBy("source_key").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(upto) - F.col("size") / 2
    inside = meta.join(sided(state.select("source_key", "before", "rest")), "source_key").withColumn("middle", middle)
    last = F.max(F.when(F.col("middle") <= F.col("rest"), F.col("row")))
    # If not even the first of these rows is taken, those before it are.
    end = inside.groupBy("source_key").agg(F.struct(F.first("key").alias("key"), F.first("tie").alias("tie"), F.coalesce(last, F.min("row") - 1).alias("row")).alias("last"))
    return materialize(plan.join(end, "source_key", "left").select("source_key", "source_size", "target", "epochs", "last"), "mix-limits")


def _taken(keyed: DataFrame, limits: DataFrame) -> DataFrame:
    small = limits.count() <= BROADCAST_SOURCES
    joined = keyed.join(F.broadcast(limits) if small else limits, "source_key")
    joined = joined.withColumn("selected", F.coalesce(F.struct("key", "tie", "row") <= F.col("last"), F.lit(False)))
    return joined.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("selected").cast("long")))
