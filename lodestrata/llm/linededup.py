"""Reversible line dedup: exact reference tables, with sharded cuckoo filters of the repeated keys in front.

State is three tables in the shared folder: `refs`, one row for each (line key, document) reference;
`counts`, the number of references and the largest document of every key; `filters`, a cuckoo filter for
each shard of keys, holding those with enough references. Inserting documents adds references and moves
keys that became frequent into their shard's filter; deleting documents takes references away and
fingerprints out. So after a deletion the state is that of an index never given those documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cuckoo import CuckooFilter, FilterFull
from .shared import materialize, quoted
from .textblock import TextBlock, blocks

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys that a shard is meant to hold; the number of shards follows from the number of frequent keys.
SHARD_KEYS = 1 << 18
#: Filters are broadcast up to this size in all; larger ones are brought together with their shard's references.
BROADCAST_BYTES = 32 << 20
#: References of a shard that meet its filter in one task.
CHUNK_REFS = 1 << 18


@dataclass
class LineKeys:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    long: np.ndarray  # which lines have a key of enough characters
    k1: np.ndarray
    k2: np.ndarray


def line_keys(block: TextBlock, min_chars: int) -> LineKeys:
    """128-bit hashes of the lines' keys: the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased."""
    starts, ends, first = block.line_bounds()
    block = block.lowered()
    word_starts, word_ends, _ = block.word_bounds()
    a, b = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    filled = np.flatnonzero(b > a)
    points = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
    left, right = word_starts[a[filled]], word_ends[b[filled] - 1]
    enough = points[right] - points[left] >= min_chars
    filled, left, right = filled[enough], left[enough], right[enough]
    long = np.zeros(len(starts), dtype=bool)
    long[filled] = True
    k1, k2 = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    k1[filled] = block.span_hashes(left, right, 0).view(np.int64)
    k2[filled] = block.span_hashes(left, right, 1).view(np.int64)
    return LineKeys(starts, ends, first, long, k1, k2)


def _references(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, block in blocks(batch.column(1)):
                keys = line_keys(block, min_chars)
                doc = np.repeat(np.arange(end - start), np.diff(keys.first))[keys.long]
                k1, k2 = keys.k1[keys.long], keys.k2[keys.long]
                order = np.lexsort((k2, k1, doc))
                doc, k1, k2 = doc[order], k1[order], k2[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                ids = batch.column(0).slice(start, end - start).take(pa.array(doc[new]))
                yield pa.RecordBatch.from_arrays([pa.array(k1[new]), pa.array(k2[new]), ids], names=["k1", "k2", "id"])

    return run


def _shard(k1: str, shards: int) -> F.Column:
    return F.shiftrightunsigned(F.col(k1), 24).bitwiseAND(F.lit(shards - 1)).cast("long")


class LineIndex:
    """The state of line dedup over the documents inserted so far and not deleted."""

    def __init__(self, spark: SparkSession, id_type: T.DataType | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_chars, self.min_docs, self.shard_keys = spark, min_chars, min_docs, shard_keys
        self.key_fields = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
        self.refs_schema = T.StructType([*self.key_fields, T.StructField("id", id_type or T.LongType())])
        self.refs: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 1

    def references(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Distinct (k1, k2, id) of the documents' long lines; rows with a null id hold none, rows that share an id are one document."""
        known = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).where("id IS NOT NULL")
        return known.mapInArrow(_references(self.min_chars), self.refs_schema).distinct()

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents. What the index holds already changes nothing, so a batch may come again."""
        new = self.references(docs, id_col, text_col)
        if self.refs is not None:
            new = new.join(self.refs, ["k1", "k2", "id"], "left_anti")
        new = materialize(new, "line-refs")
        counted = new.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.max("id").alias("last"))
        old = self.counts
        if old is None:
            self.refs, self.counts = new, materialize(counted, "line-counts")
            self._rebuild()
            return
        both = old.union(counted).groupBy("k1", "k2").agg(F.sum("refs").alias("refs"), F.max("last").alias("last"))
        self.refs, self.counts = self.refs.union(new), materialize(both, "line-counts")
        self._move(old, counted.select("k1", "k2"))

    def delete(self, ids: DataFrame) -> None:
        """Take documents out; `ids` has their ids in one column. Ids that are not in the index change nothing."""
        if self.counts is None:
            return
        gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        left = materialize(self.refs.join(gone, "id", "left_anti").select(*self.refs.columns), "line-refs")
        touched = materialize(self.refs.join(gone, "id", "left_semi").select("k1", "k2").distinct(), "line-touched")
        recounted = left.join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.max("id").alias("last"))
        old = self.counts
        self.refs, self.counts = left, materialize(old.join(touched, ["k1", "k2"], "left_anti").union(recounted), "line-counts")
        self._move(old, touched)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("refs") >= self.min_docs)

    def _rebuild(self) -> None:
        n = self.frequent().count()
        self.shards = 1 << max(0, int(np.ceil(np.log2(max(n, 1) / self.shard_keys))))

        def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            values, size = keys["k1"].to_numpy().view(np.uint64), len(keys)
            while True:
                try:
                    made = CuckooFilter.for_keys(size)
                    made.insert(values)
                    return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes()]})
                except FilterFull:
                    size *= 2

        keyed = self.frequent().select(_shard("k1", self.shards).alias("shard"), "k1").distinct()
        self.filters = materialize(keyed.groupBy("shard").applyInPandas(build, "shard long, filter binary"), "line-filters")

    def _move(self, old: DataFrame, touched: DataFrame) -> None:
        """Bring the filters in line with the counts where the touched keys' first halves became or ceased to be frequent."""
        halves = touched.select("k1").distinct()
        was = old.where(F.col("refs") >= self.min_docs).select("k1").distinct().join(halves, "k1", "left_semi").withColumn("step", F.lit(-1))
        now = self.frequent().select("k1").distinct().join(halves, "k1", "left_semi").withColumn("step", F.lit(1))
        steps = materialize(was.union(now).groupBy("k1").agg(F.sum("step").alias("step")).where("step <> 0"), "line-steps")
        if self.frequent().count() > 2 * self.shards * self.shard_keys:
            self._rebuild()
            return

        def update(key: tuple, held: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            state = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter.for_keys(len(moved))
            keys, step = moved["k1"].to_numpy().view(np.uint64), moved["step"].to_numpy()
            state.delete(keys[step < 0])
            try:
                state.insert(keys[step > 0])
            except FilterFull:
                return pd.DataFrame({"shard": [key[0]], "filter": [None]})
            return pd.DataFrame({"shard": [key[0]], "filter": [state.to_bytes()]})

        sharded = steps.withColumn("shard", _shard("k1", self.shards))
        updated = self.filters.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInPandas(update, "shard long, filter binary")
        self.filters = materialize(updated, "line-filters")
        if self.filters.where("filter IS NULL").limit(1).count():
            self._rebuild()

    def _probed(self) -> DataFrame:
        """References whose key may be frequent, by the filter of the key's shard."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        return self._probed_by_broadcast() if size <= BROADCAST_BYTES else self._probed_by_shard()

    def _probed_by_broadcast(self) -> DataFrame:
        shards = self.shards
        shipped = self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {shard: CuckooFilter.from_bytes(raw) for shard, raw in shipped.value.items()}
            for batch in batches:
                keys = batch.column(0).to_numpy().view(np.uint64)
                shard = ((keys >> np.uint64(24)) & np.uint64(shards - 1)).astype(np.int64)
                passed = np.zeros(len(keys), dtype=bool)
                for s in np.unique(shard):
                    if s in filters:
                        own = shard == s
                        passed[own] = filters[s].contains(keys[own])
                yield batch.filter(pa.array(passed))

        return self.refs.mapInArrow(run, self.refs_schema)

    def _probed_by_shard(self) -> DataFrame:
        """Filters of any size: the references are dealt by shard, those of a line that is found everywhere in chunks, to each of which the filter goes."""
        dealt = self.refs.withColumn("shard", _shard("k1", self.shards))
        chunks = dealt.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_REFS).cast("int").alias("chunks"))
        chunks = materialize(chunks, "line-chunks")
        sided = F.broadcast(chunks) if self.shards <= 1 << 20 else chunks
        refs = dealt.join(sided, "shard").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
        held = self.filters.join(chunks, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        names = self.refs_schema.names

        def probe(refs: pa.Table, held: pa.Table) -> pa.Table:
            refs_of = refs.select(names)
            if not held.num_rows:
                return refs_of.slice(0, 0)
            keys = refs.column("k1").combine_chunks().to_numpy().view(np.uint64)
            return refs_of.filter(pa.array(CuckooFilter.from_bytes(held.column("filter")[0].as_py()).contains(keys)))

        return refs.groupBy("shard", "chunk").cogroup(held.groupBy("shard", "chunk")).applyInArrow(probe, self.refs_schema)

    def drops(self) -> DataFrame:
        """For each document that loses lines: id, and `keys`, the keys of those lines."""
        hot = self.frequent().select("k1", "k2", "last")
        lost = self._probed().join(hot, ["k1", "k2"]).where(F.col("id") < F.col("last"))
        return lost.groupBy("id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
        """The documents' columns with `text_col` as it is kept (null: empty).

        With `counts`, also n_lines and n_dropped, in place of columns of these names; without, just the documents'
        own columns, whatever their names.
        """
        min_chars = self.min_chars
        columns = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
        place, n = columns.index(text_col), len(columns)
        # By position, so that no name of theirs can clash. The small side is hashed, so the texts are not sorted.
        numbered = docs.select(*map(quoted, columns)).toDF(*(f"c{i}" for i in range(n)))
        joined = numbered.join(self.drops().hint("shuffle_hash"), F.col(f"c{columns.index(id_col)}") == F.col("id"), "left").drop("id")
        added = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")] if counts else []
        out = T.StructType([*numbered.schema.fields, *added])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, marked = batch.column(place).fill_null(""), batch.column(n)
                lines = pa.compute.add(pa.compute.count_substring(texts, "\n"), 1).cast(pa.int64())
                dropped = np.zeros(batch.num_rows, dtype=np.int64)
                rows = np.flatnonzero(marked.is_valid().to_numpy(zero_copy_only=False))
                if len(rows):
                    kept, dropped[rows] = without_lines(texts.take(pa.array(rows)), marked.take(pa.array(rows)), min_chars)
                    texts = pa.compute.replace_with_mask(texts, marked.is_valid(), kept)
                held = [texts if i == place else c for i, c in enumerate(batch.columns[:n])]
                yield pa.RecordBatch.from_arrays([*held, lines, pa.array(dropped)][: len(out)], names=out.names)

        return joined.mapInArrow(run, out).toDF(*columns, *(f.name for f in added))


def without_lines(texts: pa.Array, marked: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray]:
    """The texts without the lines whose key is among the text's `marked` ones (lists of k1, k2), and how many those are."""
    keys = marked.flatten()
    of_key = np.repeat(np.arange(len(marked)), marked.value_lengths().to_numpy())
    m1, m2 = keys.field("k1").to_numpy(), keys.field("k2").to_numpy()
    data, sizes, dropped = [], [], []
    for start, end, block in blocks(texts):
        own = line_keys(block, min_chars)
        doc = np.repeat(np.arange(end - start), np.diff(own.first))
        gone = np.zeros(len(doc), dtype=bool)
        some = slice(*np.searchsorted(of_key, [start, end]))
        gone[own.long] = _among(doc[own.long], own.k1[own.long], own.k2[own.long], of_key[some] - start, m1[some], m2[some])
        stay = np.flatnonzero(~gone)
        # Bytes inside the lines that stay, and the line break before each of them but a text's first.
        step = np.zeros(len(block.data) + 1, dtype=np.int8)
        np.add.at(step, own.starts[stay], 1)
        np.add.at(step, own.ends[stay], -1)
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        later = stay[1:][doc[stay][1:] == doc[stay][:-1]]
        inside[own.starts[later] - 1] = True
        data.append(block.data[inside])
        sizes.append(block.per_doc(inside))
        dropped.append(np.bincount(doc, gone, end - start).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = [None, pa.py_buffer(bounds.astype(kind).tobytes()), pa.py_buffer(np.concatenate(data).tobytes())]
    return pa.Array.from_buffers(texts.type, len(texts), buffers), np.concatenate(dropped)


def _among(doc: np.ndarray, k1: np.ndarray, k2: np.ndarray, of_key: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """Which of (doc, k1, k2) are among (of_key, m1, m2)."""
    every = np.concatenate([np.stack([of_key, m1, m2], axis=1), np.stack([doc, k1, k2], axis=1)])
    marked = np.arange(len(every)) < len(m1)
    order = np.lexsort((~marked, every[:, 2], every[:, 1], every[:, 0]))  # the marked one first among equal rows
    ordered = every[order]
    head = np.ones(len(every), dtype=bool)
    head[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    found = np.empty(len(every), dtype=bool)
    found[order] = marked[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    return found[len(m1) :]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """Drop lines whose key of `min_chars` characters is in `min_docs` documents, but in the largest id holding it.

    Returns the documents' columns with the text as kept, and n_lines (before dropping) and n_dropped if `counts`,
    in place of columns of these names. A null or empty text is one empty line and comes back empty. Rows with a null
    id hold no reference and keep all lines. Rows that share an id are one document and lose the same lines. Further
    columns are passed on; an empty table gives an empty one.
    """
    index = LineIndex(docs.sparkSession, docs.schema[id_col].dataType, min_chars, min_docs)
    index.insert(docs, id_col, text_col)
    return index.apply(docs, id_col, text_col, counts)
