"""Token overlap of every text of one table with every text of another that shares a token with it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestrata.sources.shipping import ship

from . import setlinks

#: Tokens of items that are broadcast at once; with more, the items are taken in several passes.
PASS_TOKENS = 500_000
#: Rows of a batch that is returned.
BATCH_ROWS = 50_000


def _postings(items: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The items' ids, the distinct tokens, the items of each token with the bounds of these runs, and the items' sizes."""
    ids, sets = items.column(0).combine_chunks(), items.column(1).combine_chunks()
    sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = sets.flatten().dictionary_encode()
    tokens = coded.indices.to_numpy()
    owners = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(tokens, kind="stable")]
    return ids, coded.dictionary, owners, np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=len(coded.dictionary))))), sizes


def _overlaps(shared: Broadcast, names: list[str]):
    """From documents (id, tokens) to their pairs with the broadcast items, in batches of bounded size."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, owners, first, m = shared.value
        for batch in batches:
            sets = batch.column(1)
            n = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(sets.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
            held = np.bincount(np.repeat(np.arange(len(n)), n)[at >= 0], minlength=len(n))
            for low, _, counts in setlinks.counted(setlinks.Sets(at[at >= 0], held, n), owners, first, len(m)):
                row, item = np.nonzero(counts)
                overlap = counts[row, item] / np.minimum(n[row + low], m[item])
                for begin in range(0, len(row), BATCH_ROWS):
                    some = slice(begin, begin + BATCH_ROWS)
                    columns = [batch.column(0).take(pa.array(row[some] + low)), ids.take(pa.array(item[some])), pa.array(overlap[some])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return overlaps


def overlap_pairs(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, pass_tokens: int = PASS_TOKENS) -> DataFrame:
    """doc_id, item_id, overlap (common tokens over the smaller set's size) of all pairs that share a token.

    Both tables have an id, unique in it, and `tokens`, a set. Documents stay where they are, and a pair is counted
    within a batch of them, so a task holds a batch and the items of a pass, whatever the number of its pairs.
    """
    spark = docs.sparkSession
    ship(spark)
    passes = max(1, -(-(items.agg(F.sum(F.size("tokens"))).first()[0] or 0) // pass_tokens))
    schema = StructType([docs.schema[doc_id], items.schema[item_id], StructField("overlap", DoubleType())])

    def pairs(turn: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64(item_id), F.lit(passes)) == turn).select(item_id, "tokens").toArrow()
        shared = spark.sparkContext.broadcast(_postings(own))
        return docs.select(doc_id, "tokens").mapInArrow(_overlaps(shared, [doc_id, item_id, "overlap"]), schema)

    return reduce(DataFrame.union, map(pairs, range(passes)))
