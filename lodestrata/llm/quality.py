"""Quality rules: fixed document statistics, and gradient-boosted trees over them, scored as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hash_sample, quoted
from .textblock import TextBlock, blocks, mix64, windows

#: The classifier is fitted on at most this many labelled documents, those of least hash of doc_id.
TRAINING_ROWS = 10_000
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Documents are kept from this probability of good quality on.
KEEP_FROM = 0.5

FEATURES = ("log_words", "word_chars_mean", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate")
#: Direction in which the score may move with a feature: -1 never up, +1 never down, 0 either.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!?"]] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """Which elements occur twice or more."""
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(hashes), dtype=bool)
    at = np.searchsorted(twice, hashes)
    at[at == len(twice)] = 0
    return twice[at] == hashes


def _distinct(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Distinct values by document; `hashes` already differ between documents."""
    _, first = np.unique(hashes, return_index=True)
    return np.bincount(docs[first], minlength=n_docs)


def statistics(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The five base counts and the features, by document."""
    data, n = block.data, block.n_docs
    starts, ends, first = block.word_bounds()
    n_words = np.diff(first)
    doc_keys = mix64(np.arange(1, n + 1, dtype=np.uint64))
    words = block.span_hashes(starts, ends)
    of_word = np.repeat(np.arange(n), n_words)

    space, symbol = block.is_space(), _SYMBOL[data]
    points = (data & 0xC0) != 0x80
    word_chars = block.per_doc(points & ~space)
    n_symbols = block.per_doc(symbol)

    tri, whole, pointer = windows(words, first, 3)
    repeated = np.zeros(len(words) + 2, dtype=bool)
    if len(tri):
        at = whole[_repeats(tri ^ np.repeat(doc_keys, np.diff(pointer)))]
        for j in range(3):
            repeated[at + j] = True
    marks = np.concatenate([[0], np.cumsum(repeated[: len(words)])])
    n_repeat = marks[first[1:]] - marks[first[:-1]]

    line_starts, line_ends, line_first = block.line_bounds()
    of_line = np.repeat(np.arange(n), np.diff(line_first))
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    of_line = of_line[filled]
    lines = block.span_hashes(line_starts[filled], line_ends[filled]) ^ doc_keys[of_line]
    n_lines = np.bincount(of_line, minlength=n)
    n_dup = n_lines - _distinct(lines, of_line, n)

    base = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64)
    per_word, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [
            np.log1p(n_words),
            word_chars / per_word,
            n_symbols / per_word,
            n_dup / np.maximum(n_lines, 1),
            n_repeat / per_word,
            block.per_doc((data >= 65) & (data <= 90)) / chars,
            block.per_doc((data >= 48) & (data <= 57)) / chars,
            block.per_doc(_MARK[data]) / per_word,
            _distinct(words ^ doc_keys[of_word], of_word, n) / per_word,
        ],
        axis=1,
    )
    return base, features


@dataclass(frozen=True)
class Trees:
    """Boosted trees in flat arrays: all nodes of all trees in a row, leaves pointing at themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> Trees:
    """Boosting with logistic loss on histograms; deterministic.

    A split on a constrained feature must order its sides as the constraint says, and the sides' values stay
    on either side of their mean below it, so the score is monotone in that feature everywhere.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column, item in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            column.append(item)
        return len(value) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, level = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            for j, c in enumerate(cuts) if level < depth and len(rows) >= 2 * min_rows else ():
                if not len(c):
                    continue
                size = len(c) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], size))[:-1]
                nl = np.cumsum(np.bincount(binned[rows, j], minlength=size))[:-1]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(g - gl) / (h - hl + l2), low, high)
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                bad = (nl < min_rows) | (len(rows) - nl < min_rows) | (monotone[j] * (vr - vl) < 0)
                gain[bad] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
            if best is None:
                value[at] = rate * float(np.clip(-g / (h + l2), low, high))
                score[rows] += value[at]
                continue
            _, j, k, vl, vr = best
            feature[at], threshold[at] = j, float(cuts[j][k])
            goes = binned[rows, j] <= k
            mid = (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[j]]
            left[at], right[at] = node(), node()
            open_nodes += [(left[at], rows[goes], *bounds[0], level + 1), (right[at], rows[~goes], *bounds[1], level + 1)]
    ints = (np.array(a, dtype=np.int64) for a in (roots, feature))
    roots_array, feature_array = ints
    return Trees(roots_array, feature_array, np.array(threshold), np.array(left), np.array(right), np.array(value), start, depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, block in blocks(batch.column(1)):
            flat = pa.array(statistics(block)[1].ravel())
            bounds = pa.array(np.arange(0, (end - start + 1) * len(FEATURES), len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(bounds, flat)], names=["row", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = TRAINING_ROWS) -> Trees | None:
    """Trees fitted on at most `max_rows` labelled documents; None if the labels are not of both kinds.

    Null ids or labels take no part. The sample is bounded by `max_rows`, so it may be broadcast to find its
    texts, and its features (no texts) are gathered to fit.
    """
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("good"))
    sample = hash_sample(sample.select(F.col(id_col).alias("label_id"), (F.col("good") > 0).cast("double").alias("good")), "label_id", max_rows)
    texts = docs.select(F.col(quoted(id_col)).alias("label_id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(sample), "label_id").select(F.struct("label_id", "good").alias("row"), "text")
    schema = T.StructType([texts.schema["row"], T.StructField("features", T.ArrayType(T.DoubleType()))])
    found = texts.mapInArrow(_features, schema).groupBy("row").agg(F.min("features").alias("features"))  # one of repeated rows
    rows = found.select("row.good", "features").toArrow()
    if not rows.num_rows:
        return None
    y = rows.column("good").to_numpy()
    x = np.array(rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(y), len(FEATURES))
    if y.min() == y.max():
        return None
    order = np.lexsort([*x.T[::-1], y])  # the fit does not depend on the order in which tasks end
    return fit_trees(x[order], y[order])


def judge(docs: DataFrame, trees: Trees | None, text_col: str = "text", keep_from: float = KEEP_FROM, only_kept: bool = False, pass_columns: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept to `pass_columns`, in place of columns of these names.

    base_failed: fewer than MIN_WORDS words, or 100 * n_repeat_words > REPEAT_PERCENT * n_words. kept: not
    base_failed and the trees' probability is `keep_from` or more (1 without trees). With `only_kept`, the kept
    rows with their own columns only, whatever their names. A null or empty text has zero counts and fails the
    base rules. Rows are independent: repeated rows get repeated results; an empty table gives an empty one.
    One narrow pass; only the flat trees are broadcast.
    """
    added = [*(T.StructField(b, T.LongType()) for b in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    columns = pass_columns if pass_columns is not None else docs.columns
    if not only_kept:
        columns = [c for c in columns if c.lower() not in {f.name for f in added}]
    n = len(columns)
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    # By position, so that no name can clash.
    numbered = docs.select(*map(quoted, columns), quoted(text_col)).toDF(*(f"c{i}" for i in range(n)), "text")
    out = T.StructType([*numbered.schema.fields[:n], *([] if only_kept else added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value
        for batch in batches:
            for start, end, block in blocks(batch.column(n)):
                base, features = statistics(block)
                failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
                score = trees.probability(features) if trees is not None else np.ones(len(base))
                kept = ~failed & (score >= keep_from)
                part = batch.slice(start, end - start)
                if only_kept:
                    yield pa.RecordBatch.from_arrays(part.columns[:n], names=out.names).filter(pa.array(kept))
                else:
                    new = [pa.array(base[:, j]) for j in range(len(BASE))] + [pa.array(failed), pa.array(score), pa.array(kept)]
                    yield pa.RecordBatch.from_arrays(part.columns[:n] + new, names=out.names)

    return numbered.mapInArrow(run, out).toDF(*columns, *(f.name for f in out.fields[n:]))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labels, then judge every document: id_col with the columns of `judge`."""
    return judge(docs, fit(docs, labels, id_col, text_col), text_col, pass_columns=[id_col])
