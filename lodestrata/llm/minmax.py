"""Near-duplicates by min-max hashing of word shingles.

Every permutation gives two signature values, its minimum and its maximum over the document's shingles;
each of them agrees between two documents with a probability of their Jaccard similarity, so half as many
hash evaluations fill a signature. Signatures are cut into bands; documents that share a band are
candidates, and candidates are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .shared import join_with_hot_keys, materialize, quoted
from .textblock import TextBlock, blocks, mix64, shingles

WORDS = 5
#: Documents are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 64 permutations, 128 values, 32 bands of 4: a pair at 0.75 shares no band with a probability of 5e-6.
PERMUTATIONS = 64
ROWS = 4
#: Members of a band's bucket up to which its pairs across components are listed; larger ones are compared in blocks.
SMALL_BUCKET = 24
BLOCK_DOCS = 256
#: Turns of comparing with random members, at most, and the pairs left for each member of open buckets at which they end.
MAX_TURNS = 8
FEW_PAIRS = 2
#: Ids that may be broadcast (8 MB of ids); beyond that, texts are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Documents that are compared with one other in one task.
CHUNK_PAIRS = 256

_SEEDS = mix64(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_XOR = (_SEEDS[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32)[:, None]
_MULTIPLY = ((_SEEDS[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
_BAND_PLACE = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_STRIP = 2048
_COLUMNS = 4096
N_BANDS = 2 * PERMUTATIONS // ROWS


def min_max(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each permutation over a non-empty array of 64-bit shingle hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = high = None
    for at in range(0, len(short), _STRIP):
        values = short[None, at : at + _STRIP] ^ _XOR
        values *= _MULTIPLY
        least, most = values.min(axis=1), values.max(axis=1)
        low = least if low is None else np.minimum(low, least)
        high = most if high is None else np.maximum(high, most)
    return low, high


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Band keys of signatures (documents x 2 * PERMUTATIONS, all minima first)."""
    bands = signatures.reshape(len(signatures), N_BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    keys = (bands * _BAND_PLACE).sum(axis=2, dtype=np.uint64) + np.arange(1, N_BANDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    return mix64(keys).view(np.int64)


def document_shingles(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    block = block.lowered()
    starts, ends, first = block.word_bounds()
    return shingles(block.span_hashes(starts, ends), first, WORDS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, block in blocks(batch.column(1)):
            hashes, pointer = document_shingles(block)
            n = end - start
            sizes, digests = np.zeros(n, dtype=np.int64), np.zeros((n, 2), dtype=np.uint64)
            signatures = np.zeros((n, 2 * PERMUTATIONS), dtype=np.uint32)
            for i in range(n):
                own = np.unique(hashes[pointer[i] : pointer[i + 1]])
                if len(own):
                    sizes[i] = len(own)
                    digests[i] = own.sum(dtype=np.uint64), mix64(own).sum(dtype=np.uint64)
                    signatures[i, :PERMUTATIONS], signatures[i, PERMUTATIONS:] = min_max(own)
            keys = pa.array(band_keys(signatures).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * N_BANDS, N_BANDS, dtype=np.int32)), keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, n), pa.array(sizes), *(pa.array(digests[:, j].view(np.int64)) for j in (0, 1)), bands],
                names=["id", "n", "d1", "d2", "bands"],
            )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct hashes) are linked."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _set(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), dtype="<u8")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, own = None, None
    for batch in batches:
        u, v, of_u, of_v = batch.columns
        held = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            if u[i] != known:
                known, own = u[i], _set(of_u[i])
            held[i] = similar(own, _set(of_v[i]))
        yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(held))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (u, v), written and without repeats, those linked on their full sets; `sets` has one set for each id (id, s).

    The pairs of one u are dealt out in chunks, to each of which its set goes once, so a document that is compared
    with many others makes no long task.
    """
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK_PAIRS).cast("int").alias("chunks"))
    few, hot = many.where("chunks = 1"), materialize(many.where("chunks > 1"), "chunks")
    dealt = pairs.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, "u", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"), F.lit(0))).drop("chunks")
    with_v = dealt.join(sets.select(F.col("id").alias("v"), F.col("s").alias("s_v")), "v")
    chunks = few.union(hot).select("u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    with_u = chunks.join(sets.select(F.col("id").alias("u"), F.col("s").alias("s_u")), "u")
    kind = pairs.schema["u"].dataType
    both = with_v.join(with_u, ["u", "chunk"]).select("u", "v", "s_u", "s_v")
    links = both.mapInArrow(_verify, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))
    return materialize(links, "links")


def _fits(left: str, right: str) -> str:
    """Whether the two sizes allow a link."""
    return f"100 * least({left}, {right}) >= {PERCENT} * greatest({left}, {right})"


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of a bucket's members in different components, if their sizes allow a link."""
    left, right = (rows.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "component"))) for s in ("l", "r"))
    fits = f"id_l < id_r AND component_l <> component_r AND {_fits('n_l', 'n_r')}"
    return left.join(right, "bucket").where(fits).select(F.col("id_l").alias("u"), F.col("id_r").alias("v")).distinct()


def _open_buckets(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Rows (bucket, id, n) with their component, of the buckets that hold several; c is the bucket's size."""
    placed = rows.join(components, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    return materialize(join_with_hot_keys(placed, mixed.select("bucket", "c"), "bucket", "c"), "open")


def _star(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's members with one of them, another one in every turn, across components."""
    draw = F.xxhash64("id", F.lit(turn))
    hub = rows.groupBy("bucket").agg(*(F.min_by(c, draw).alias(f"{c}_h") for c in ("id", "n", "component")), F.max("c").alias("c_h"))
    pairs = join_with_hot_keys(rows, hub, "bucket", "c_h").where(f"component <> component_h AND {_fits('n', 'n_h')}")
    return pairs.select(F.least("id", "id_h").alias("u"), F.greatest("id", "id_h").alias("v")).distinct()


def _left_to_compare(rows: DataFrame) -> tuple[int, int]:
    """Members of open buckets, and pairs of them across components."""
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    found = sizes.agg(F.sum("m"), F.sum(F.col("m") * F.col("m") - F.col("mm"))).first()
    return found[0] or 0, (found[1] or 0) // 2


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, block in blocks(batch.column(1)):
            hashes, pointer = document_shingles(block)
            sets = [np.unique(hashes[pointer[i] : pointer[i + 1]]).astype("<u8", copy=False).tobytes() for i in range(end - start)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(sets, pa.binary())], names=["id", "s"])


def common_sizes(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets[:split] with sets[split:], by products of strips of their shared columns."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((split, len(sets) - split), dtype=np.float32)
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        strip = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        strip[owner[a:b], column[a:b] - low] = 1
        out += strip[:split] @ strip[split:].T
    return out.astype(np.int64)


def _block_links(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the components of two blocks of a cluster (of one, if they are the same), whole."""
    first, second = key[1].as_py(), key[2].as_py()
    table = table.take(pa.compute.sort_indices(table, [("side", "ascending")]))
    side, component = table.column("side").to_numpy(), table.column("component").to_numpy()
    sets = [_set(raw) for raw in table.column("s")]
    split, ids = int((side == first).sum()), table.column("id").to_numpy()
    if first == second:
        sets, component, ids = sets * 2, np.tile(component, 2), np.tile(ids, 2)
    if not 0 < split < len(sets):
        return pa.table({"u": ids[:0], "v": ids[:0]})
    sizes, common = np.array([len(x) for x in sets]), common_sizes(sets, split)
    union = sizes[:split, None] + sizes[None, split:] - common
    u, v = np.nonzero((100 * common >= PERCENT * union) & (component[:split, None] != component[None, split:]))
    return pa.table({"u": np.minimum(ids[u], ids[split + v]), "v": np.maximum(ids[u], ids[split + v])})


def _links_in_clusters(large: DataFrame, sets: DataFrame) -> DataFrame:
    """All links across components inside clusters: documents that meet in large open buckets, in one step or several.

    A cluster is cut into blocks by hash, and each pair of blocks is a task of bounded size that compares whole sets
    and returns links only.
    """
    kind = large.schema["id"].dataType
    hub = large.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("c").alias("c_h"))
    clusters = connected_components(join_with_hot_keys(large, hub, "bucket", "c_h").select(F.col("id").alias("u"), F.col("hub").alias("v")))
    placed = materialize(large.select("id", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "id"), "clusters")
    sized = placed.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("k"), F.count("*").alias("size"))
    blocked = join_with_hot_keys(placed, sized, "cluster", "size").withColumn("side", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    blocked = blocked.select("id", "component", "cluster", "side", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    blocked = blocked.select("*", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"))
    pairs = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    found = blocked.join(sets, "id").select("cluster", "b1", "b2", "side", "id", "component", "s").groupBy("cluster", "b1", "b2").applyInArrow(_block_links, pairs)
    return materialize(found.distinct(), "links")


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) that further links make of those. Each counts as its star, so earlier links need not come again."""
    if links.isEmpty():
        return components
    stars = components.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
    return materialize(connected_components(stars.union(links)), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept (id_col = component_id).

    A-Z are lower-cased; shingles are five words `[^\\x20\\x09-\\x0D]+`, or the whole sequence of a shorter
    text. Null and empty texts have no shingle and link with nothing. Rows that repeat an id are one document
    if their texts are equal; rows with a null id get a null component, link with nothing and are kept. Other
    columns are not read; an empty table gives an empty one. Shingles are told apart by 64-bit hashes, and equal sets
    by their size and two 64-bit sums over them, which two different sets share with a probability of 2^-128.

    Documents of equal sets collapse to the smallest id first (partial min before the shuffle), so a group of
    copies costs one signature. Every member of a band's bucket is first compared with one other member of
    one of its buckets; components are formed, and while buckets hold several of them and many pairs are left,
    their members are compared with one random member of another component, and components are formed again.
    Then all pairs across components are compared: those of small buckets one by one, and what meets in large
    buckets in blocks that return links only. So a group of near copies costs rows in proportion to its size,
    and no pair that could be linked is skipped.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    schema = T.StructType(
        [T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    signed = materialize(source.mapInArrow(_signatures, schema), "signatures")
    usable = signed.where("id IS NOT NULL AND n > 0")
    sets = materialize(usable.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "sets")

    reps = usable.join(sets.select(F.col("rep").alias("id"), *(F.col(c).alias(f"s_{c}") for c in ("n", "d1", "d2"))), "id")
    reps = reps.where("n = s_n AND d1 = s_d1 AND d2 = s_d2").select("id", "n", "bands")
    posted = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.min("id").alias("pivot"), F.min_by("n", "id").alias("pivot_n"), F.count("*").alias("c")).where("c > 1")
    members = materialize(join_with_hot_keys(posted, shared, "bucket", "c"), "members")

    met = materialize(members.select("id").distinct(), "met")
    few = F.broadcast(met) if met.count() <= BROADCAST_IDS else met
    # Of rows that repeat an id with other texts, one counts.
    full = source.join(few, "id", "left_semi").mapInArrow(_sets, T.StructType([T.StructField("id", kind), T.StructField("s", T.BinaryType())]))
    full = materialize(full.groupBy("id").agg(F.min("s").alias("s")), "full-sets")

    first = members.where(f"id > pivot AND {_fits('n', 'pivot_n')}").groupBy("id").agg(F.min("pivot").alias("u"))
    tried = materialize(first.select("u", F.col("id").alias("v")), "tried")
    components = materialize(connected_components(_confirmed(tried, full)), "components")
    rows = _open_buckets(members.select("bucket", "id", "n"), components)
    size, left = _left_to_compare(rows)
    for turn in range(MAX_TURNS):
        if not left or (turn and left <= FEW_PAIRS * size):
            break
        pairs = materialize(_star(rows, turn).join(tried, ["u", "v"], "left_anti"), "turn")
        tried = tried.union(pairs)
        components = _joined(components, _confirmed(pairs, full))
        rows = _open_buckets(rows.select("bucket", "id", "n"), components)
        before = left
        size, left = _left_to_compare(rows)
        if left > 0.9 * before:
            break
    if left:
        large = rows.where(f"c > {SMALL_BUCKET}")
        rest = materialize(_across(rows.where(f"c <= {SMALL_BUCKET}")).join(tried, ["u", "v"], "left_anti"), "rest")
        links = _confirmed(rest, full)
        if not large.isEmpty():
            links = links.union(_links_in_clusters(large, full))
        components = _joined(components, links)

    named = sets.join(components.withColumnRenamed("id", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that `near_duplicates` does not keep; of each group the smallest id stays."""
    found = near_duplicates(docs, id_col, text_col)
    gone = materialize(found.where("NOT kept").select(F.col(quoted(id_col)).alias("gone")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    # By position, so that no name of theirs can clash.
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return numbered.join(side, F.col(f"c{docs.columns.index(id_col)}") == F.col("gone"), "left_anti").toDF(*docs.columns)
