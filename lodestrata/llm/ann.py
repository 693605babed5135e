"""Nearest neighbours by cosine: inverted lists, and an adaptive scan of rotated dimensions inside them.

Vectors are scaled to length one and rotated at random, so the first dimensions of a difference estimate
its whole length. Inside a probed list, distances grow by blocks of columns; after each block a
hypothesis test gives up the candidates whose partial distance is too large to end among the nearest.
What is left gets its exact cosine from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hash_sample, materialize, quoted

#: The lists are fitted, and the number of probes is chosen, on a sample: SAMPLE vectors, or SAMPLE_PER_LIST for each
#: list that the table wants if that is more, but SAMPLE_BYTES (single precision) at most.
SAMPLE = 20_000
SAMPLE_PER_LIST = 32
SAMPLE_BYTES = 128 << 20
#: Probes are as many as find this share of the true neighbours of sample vectors within the sample.
TARGET_RECALL = 0.97
#: Index rows and queries that meet in one task.
CHUNK_ROWS = 8192
CHUNK_QUERIES = 4096
#: Strictness of the tests, in standard deviations: one is wrong with a probability of about 0.001.
DEVIATIONS = 3.0
#: Ends of the column blocks, as shares of all dimensions.
BLOCK_ENDS = (0.25, 0.5, 0.75, 1.0)
_STRIP_VALUES = 1 << 22
_FIRST_ROWS = 256
_QUERY_STRIP = 64


@dataclass(frozen=True)
class Lists:
    dims: int
    rotation: np.ndarray  # dims x dims, orthogonal
    centres: np.ndarray  # lists x dims, rotated
    probes: int

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.rotation

    def own(self, rotated: np.ndarray) -> np.ndarray:
        """The list of each rotated vector, in strips of bounded memory."""
        step = max(1, _STRIP_VALUES // max(1, len(self.centres)))
        parts = [np.argmax(rotated[i : i + step] @ self.centres.T, axis=1) for i in range(0, len(rotated), step)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def wanted_lists(n: int) -> int:
    """Lists for a table of `n` vectors: they hold about 2 * sqrt(n) each, so both lists and what is in them grow with the table."""
    return max(1, int(np.sqrt(n) / 2))


def sample_size(n: int, dims: int) -> int:
    return min(max(SAMPLE, SAMPLE_PER_LIST * wanted_lists(n)), max(1, SAMPLE_BYTES // (4 * max(1, dims))))


def usable(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and double vectors, scaled by a power of two each, of the rows that are not null, of `dims` components, all finite, and not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    if dims is None:
        dims = int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 0
    rows = np.flatnonzero((lengths == dims) & (lengths > 0))
    if not len(rows):
        return rows, np.zeros((0, dims))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    vectors = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    largest = np.abs(vectors).max(axis=1)
    good = np.isfinite(largest) & (largest > 0)  # a null or nan component makes the largest one nan
    # By a power of two, which changes no cosine, so that squares neither overflow nor vanish.
    _, exponent = np.frexp(largest[good])
    return rows[good], np.ldexp(vectors[good], -exponent[:, None])


def fit_lists(vectors: np.ndarray, n: int, k: int, seed: int = 11, rounds: int = 8) -> Lists:
    """Lists for `n` vectors in all from a sample of them, by k-means on the sphere."""
    rng = np.random.default_rng(seed)
    dims = vectors.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0] if dims else np.zeros((0, 0))
    lists = Lists(dims, rotation, np.zeros((0, dims)), 1)
    x = lists.rotated(vectors) if len(vectors) else np.zeros((0, dims))
    count = int(min(wanted_lists(n), max(1, len(x) // SAMPLE_PER_LIST)))
    if count == 1:
        return Lists(dims, rotation, np.zeros((1, dims)), 1)
    centres = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        own = Lists(dims, rotation, centres, 1).own(x)
        order = np.argsort(own, kind="stable")
        held = np.bincount(own, minlength=count)
        first = np.cumsum(held) - held
        sums = np.add.reduceat(x[order], np.minimum(first, len(x) - 1), axis=0)
        sums[held == 0] = x[rng.integers(len(x), size=int((held == 0).sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    own = Lists(dims, rotation, centres, 1).own(x)
    some = rng.choice(len(x), min(200, len(x)), replace=False)
    needed = []
    for i in some:  # one at a time, so that memory does not grow with the sample's square
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1))[:k]
        rank = np.empty(count, dtype=np.int64)
        rank[np.argsort(-(centres @ x[i]), kind="stable")] = np.arange(count)
        needed.extend(rank[own[best]] + 1)
    needed.sort()
    probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))) - 1)])
    return Lists(dims, rotation, centres, probes)


def nearest_in_chunk(lists: Lists, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chunk's vectors, the `k` nearest to each query but its own id: query, id and exact cosine."""
    _, once = np.unique(ids, return_index=True)
    ids, vectors = ids[once], vectors[once]
    x, q = lists.rotated(vectors), lists.rotated(queries)
    ends = sorted({max(1, round(e * lists.dims)) for e in BLOCK_ENDS})
    starts = [0, *ends[:-1]]
    blocks = [np.ascontiguousarray(x[:, a:b]) for a, b in zip(starts, ends)]
    squares = [(block**2).sum(axis=1) for block in blocks]
    query_squares = [(q[:, a:b] ** 2).sum(axis=1) for a, b in zip(starts, ends)]
    norms = np.linalg.norm(vectors, axis=1)
    head = min(_FIRST_ROWS, len(x))
    # After a random rotation the share of a distance in b of all dimensions is Beta distributed.
    shares = np.array(ends) / lists.dims
    shares = np.minimum(1, shares + DEVIATIONS * np.sqrt(2 * shares * (1 - shares) / (lists.dims + 2)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, query_id in enumerate(query_ids):
        if i % _QUERY_STRIP == 0:
            strip = slice(i, i + _QUERY_STRIP)
            firsts = 2 - 2 * (q[strip] @ x[:head].T)
            partials = squares[0][head:] + query_squares[0][strip, None] - 2 * (q[strip, : ends[0]] @ blocks[0][head:].T)
        first = firsts[i % _QUERY_STRIP]
        first[ids[:head] == query_id] = np.inf
        limit = np.partition(first, k - 1)[k - 1] if head > k else np.inf
        alive, partial = np.arange(head, len(x)), partials[i % _QUERY_STRIP]
        for j, share in enumerate(shares):
            if j:
                partial = partial + squares[j][alive] + query_squares[j][i] - 2 * (blocks[j][alive] @ q[i, starts[j] : ends[j]])
            if tally is not None:
                tally["values"] = tally.get("values", 0) + len(alive) * (ends[j] - starts[j])
            stay = partial <= limit * share + 1e-9
            alive, partial = alive[stay], partial[stay]
        close = np.flatnonzero(first <= limit + 1e-9)
        alive, distance = np.concatenate([close, alive]), np.concatenate([first[close], partial])
        own = ids[alive] != query_id
        alive, distance = alive[own], distance[own]
        if len(alive) > k:
            close = distance <= np.partition(distance, k - 1)[k - 1] + 1e-9
            alive = alive[close]
        score = (vectors[alive] * queries[i]).sum(axis=1) / (norms[alive] * np.linalg.norm(queries[i : i + 1], axis=1))
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), query_id), ids[alive][best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` nearest found of each query, by cosine in double precision: query_id, rank (from 1), id_col, score.

    Queries are the rows for which `is_query` holds; candidates are all rows of another id, ties going to the
    smaller id. Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite
    components take no part, nor do rows without an id; rows that repeat an id are one vector where they are equal.
    A query that finds fewer than `k` in its probes has all lists probed until there are enough candidates. Other
    columns are not read; an empty table gives an empty one. Every usable row is indexed. Lists are dealt out in
    chunks by hash of the id, and the queries that probe a list in blocks, so neither a hot list nor many copies meet
    in one task, and a list is read once for each of its own blocks of queries.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    source = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    n, longest = source.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    _, sample = usable(hash_sample(source.select("id", "v"), "id", sample_size(n, longest), n).select(F.col("v")).toArrow().column(0))
    lists = spark.sparkContext.broadcast(fit_lists(sample, n, k))
    dims = lists.value.dims

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lists.value
        for batch in batches:
            rows, found = usable(batch.column(1), dims)
            if len(rows):
                kept = batch.take(pa.array(rows))
                place = own.own(own.rotated(found)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(place)], names=["id", "v", "q", "list"])

    schema = T.StructType([*source.schema.fields, T.StructField("list", T.IntegerType())])
    placed = materialize(source.mapInArrow(assign, schema), "ann-lists")
    sizes = dict(placed.groupBy("list").count().collect())  # a row for each list
    chunks = {c: -(-s // CHUNK_ROWS) for c, s in sizes.items()}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists that each query probes."""
        own, counts = lists.value, np.array([sizes.get(c, 0) for c in range(len(lists.value.centres))])
        step = max(1, _STRIP_VALUES // len(counts))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, found = usable(part.column(1), dims)
                if not len(rows):
                    continue
                order = np.argsort(-(own.rotated(found) @ own.centres.T), axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1)
                wanted = np.maximum(own.probes, 1 + (held < 8 * (k + 1)).sum(axis=1))
                row, col = np.nonzero(np.arange(order.shape[1]) < wanted[:, None])
                place = order[row, col].astype(np.int32)
                row, place = row[counts[place] > 0], place[counts[place] > 0]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[row])), pa.array(place)], names=["id", "list"])

    asked = placed.where("q").select("id", "v").dropDuplicates(["id"])
    asked = materialize(asked, "ann-queries")
    probes = materialize(asked.mapInArrow(probe, "id long, list int"), "ann-probes")
    asking = probes.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("blocks"))
    many = spark.createDataFrame(list(chunks.items()), "list int, chunks int").join(asking, "list")
    many = F.broadcast(materialize(many, "ann-blocks"))  # a row for each list
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")
    index = placed.join(many, "list").select("id", "v", "list", chunk, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    probes = probes.join(many, "list").select("id", "list", block, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    probes = probes.join(asked, "id").select("id", "v", "list", "chunk", "block")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            _, x = usable(left.column("v"), dims)
            _, q = usable(right.column("v"), dims)
            found = nearest_in_chunk(lists.value, left.column("id").to_numpy(), x, right.column("id").to_numpy(), q, k)
        return pa.table({"query_id": found[0], "id": found[1], "score": found[2]})

    keys = ["list", "chunk", "block"]
    found = index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score double")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").cast(id_type).alias(id_col), "score")
