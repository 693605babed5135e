"""Hidden Markov language model: Baum-Welch over all training texts, exact scaled-forward likelihoods.

The most frequent words are classes of their own; the others share classes by their hash. States emit classes,
and a shared class emits its words by their counts, so a text's probability is the HMM's over classes times that
of each word in its class. An executor needs states x classes, a bounded number, and the most frequent words,
while counts are those of every training text; rarer words are joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize
from .textblock import blocks

STATES = 6
#: Words with a class of their own, the most frequent ones, and classes that the others share by hash (a power of two).
OWN_CLASSES = 32_768
SHARED_CLASSES = 16_384
#: Passes over all training texts in which a text keeps one state, before those in which states change.
STILL_PASSES = 3
#: Baum-Welch passes over all training texts end when one gains less than this share of the log likelihood.
SETTLED = 1e-4
#: Words whose counts may be broadcast (16 bytes each).
HEAD_WORDS = 200_000
#: The key of the end token.
END = 0x5851F42D4C957F2D
#: Tokens that are worked on at once; longer texts are cut into pieces.
STRIP_TOKENS = 1 << 19
PIECE = 4096
_SCALED_EVERY = 4
_PSEUDO = 0.1
_SLOTS = 1 << 20


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes + 1 (the end) x states: probability of the class in the state

    @classmethod
    def random(cls, states: int, classes: int, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = rng.gamma(2.0, size=(classes + 1, states))
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        start, move, emit = start + _PSEUDO, move + _PSEUDO, emit + _PSEUDO
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        return Recursion(self).forward(tokens, first)

    def expected(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        return Recursion(self).expected(tokens, first)


@dataclass(frozen=True)
class Strip:
    """Pieces side by side: all their first tokens, then all second ones and so on, longer pieces first."""

    order: np.ndarray  # of the given pieces, from the longest
    steps: np.ndarray  # bounds of the steps in `tokens`
    tokens: np.ndarray
    last: np.ndarray  # place of each piece's last token


@dataclass(frozen=True)
class Pieces:
    """Sequences cut into pieces of at most PIECE tokens, so that long ones run in step too, in bounded memory."""

    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray  # the sequence
    begins: np.ndarray  # whether the piece begins its sequence
    linked: np.ndarray  # whether its sequence has several pieces

    @classmethod
    def cut(cls, tokens: np.ndarray, first: np.ndarray) -> Pieces:
        lengths = np.diff(first)
        many = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(lengths)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return cls(tokens, first[:-1][owner] + nth * PIECE, np.minimum(PIECE, lengths[owner] - nth * PIECE), owner, nth == 0, many[owner] > 1)

    def runs(self) -> list[tuple[int, int]]:
        """First and end piece of each sequence of several."""
        at = np.flatnonzero(self.linked & self.begins)
        return list(zip(at.tolist(), np.searchsorted(self.owner, self.owner[at], side="right").tolist()))

    def strips(self, some: np.ndarray, most: int = STRIP_TOKENS) -> Iterator[tuple[np.ndarray, Strip]]:
        """The given pieces by length, in strips of about `most` tokens; with the numbers of a strip's pieces."""
        some = some[np.argsort(self.lengths[some], kind="stable")]
        nth = np.cumsum(self.lengths[some]) // most
        for part in np.split(some, np.flatnonzero(np.diff(nth)) + 1):
            if len(part):
                strip = self.strip(part)
                yield part[strip.order], strip

    def strip(self, some: np.ndarray) -> Strip:
        order = np.argsort(-self.lengths[some], kind="stable")
        starts, lengths = self.starts[some][order], self.lengths[some][order]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        steps = np.concatenate([[0], np.cumsum(active)])
        nth = np.arange(steps[-1]) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tokens = np.empty(steps[-1], dtype=self.tokens.dtype)
        tokens[steps[nth] + np.repeat(np.arange(len(order)), lengths)] = self.tokens[np.repeat(starts, lengths) + nth]
        return Strip(order, steps, tokens, steps[lengths - 1] + np.arange(len(order)))


class Recursion:
    """Scaled forward and backward recursions of a model, exact up to rounding; `kind` is their precision.

    Emissions are divided by the largest of their class, whose logarithm is added back, and alphas and betas are
    scaled every few steps, so nothing runs out of range.
    """

    def __init__(self, model: Hmm, kind: type = np.float64):
        highest = model.emit.max(axis=1)
        self.logs = np.log(highest)
        self.emit = (model.emit / highest[:, None]).astype(kind)
        self.start, self.move = model.start.astype(kind), model.move.astype(kind)
        self.ones = np.ones(len(model.start), dtype=kind)

    def _scan(self, strip: Strip, into: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Emissions and alphas of a strip, each piece's log likelihood without `logs`, and its last alpha.

        `into` has the probabilities of the states at each piece's first token, before that is seen.
        """
        emitted, steps = self.emit[strip.tokens], strip.steps
        alphas, loglik = emitted.copy(), np.zeros(steps[1])
        alphas[: steps[1]] *= into
        for t in range(1, len(steps) - 1):
            low, high, before = steps[t], steps[t + 1], steps[t - 1]
            now = alphas[low:high]
            now *= alphas[before : before + high - low] @ self.move
            if t % _SCALED_EVERY == 0:
                scale = now @ self.ones
                now /= scale[:, None]
                loglik[: high - low] += np.log(scale)
        ends = alphas[strip.last].astype(np.float64)
        scale = ends.sum(axis=1)
        return emitted, alphas, loglik + np.log(scale), ends / scale[:, None]

    def _borders(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the last alpha before it, and the beta after its end; ones where its text begins or ends.

        A piece works on alphas as a matrix, which is found for all pieces of long texts in step, one row for each
        state before it. Then only these matrices are multiplied in turn.
        """
        states = len(self.start)
        enter, leave = np.ones((2, len(pieces.lengths), states))
        later = np.flatnonzero(pieces.linked & ~pieces.begins)
        if not len(later):
            return enter, leave
        work = {}
        for state in range(states):
            for some, strip in pieces.strips(later):
                _, _, loglik, ends = self._scan(strip, self.move[state])
                for piece, log, end in zip(some.tolist(), loglik, ends):
                    work[piece, state] = (log, end)
        begun = np.flatnonzero(pieces.linked & pieces.begins)
        ended = {}
        for some, strip in pieces.strips(begun):
            ended |= zip(some.tolist(), self._scan(strip, self.start)[3])
        for first, end in pieces.runs():
            alpha, matrices = ended[first], {}
            for i in range(first + 1, end):
                logs, rows = zip(*(work[i, s] for s in range(states)))
                matrices[i] = np.array(rows) * np.exp(np.array(logs) - max(logs))[:, None]
                enter[i] = alpha
                alpha = alpha @ matrices[i]
                alpha /= alpha.sum()
            beta = np.ones(states)
            for i in range(end - 1, first, -1):
                beta = matrices[i] @ beta
                beta /= beta.sum()
                leave[i - 1] = beta
        return enter, leave

    def _into(self, pieces: Pieces, some: np.ndarray, enter: np.ndarray) -> np.ndarray:
        return np.where(pieces.begins[some, None], self.start, enter[some].astype(self.move.dtype) @ self.move)

    def forward(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural-log likelihood of each sequence (tokens[first[i]:first[i + 1]], none empty)."""
        pieces = Pieces.cut(tokens, first)
        enter, _ = self._borders(pieces)
        out = np.add.reduceat(self.logs[tokens], first[:-1]) if len(first) > 1 else np.zeros(0)
        for some, strip in pieces.strips(np.arange(len(pieces.lengths))):
            np.add.at(out, pieces.owner[some], self._scan(strip, self._into(pieces, some, enter))[2])
        return out

    def still(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """As `expected`, if every sequence kept the state that it begins in."""
        states, start, emit, loglik = len(self.start), np.zeros(len(self.start)), np.zeros(self.emit.shape), 0.0
        logs = np.log(self.emit.astype(np.float64)) + self.logs[:, None]
        own = np.stack([np.add.reduceat(np.take(logs[:, s], tokens), first[:-1]) for s in range(states)], axis=1) + np.log(self.start.astype(np.float64))
        most = own.max(axis=1, keepdims=True)
        share = np.exp(own - most)
        total = share.sum(axis=1, keepdims=True)
        share /= total
        loglik = float((np.log(total) + most).sum())
        lengths = np.diff(first)
        for s in range(states):
            emit[:, s] = np.bincount(tokens, np.repeat(share[:, s], lengths), len(emit))
        start = share.sum(axis=0)
        return start, np.zeros((states, states)), emit, loglik

    def expected(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, emit) of the sequences, and their log likelihood."""
        pieces = Pieces.cut(tokens, first)
        enter, leave = self._borders(pieces)
        states, kind = len(self.start), self.move.dtype
        start, move, emit, loglik = np.zeros(states), np.zeros((states, states)), np.zeros(self.emit.shape), float(self.logs[tokens].sum())
        back = np.ascontiguousarray(self.move.T)
        for some, strip in pieces.strips(np.arange(len(pieces.lengths))):
            begins, steps = pieces.begins[some], strip.steps
            emitted, alphas, own, _ = self._scan(strip, self._into(pieces, some, enter))
            loglik += float(own.sum())
            betas = np.empty_like(alphas)
            betas[strip.last] = leave[some]
            for t in range(len(steps) - 3, -1, -1):
                low, mid, high = steps[t : t + 3]
                behind = (emitted[mid:high] * betas[mid:high]) @ back
                if t % _SCALED_EVERY == 0:
                    behind /= (behind @ self.ones)[:, None]
                betas[low : low + high - mid] = behind
            # Moves: from the alpha of the step before (for a piece's first token, that of the piece before) to what is emitted.
            emitted *= betas
            n, counts = steps[1], np.diff(steps)
            came = np.empty_like(alphas)
            came[:n] = enter[some].astype(kind)
            came[n:] = alphas[np.arange(n, steps[-1]) - np.repeat(counts[:-1], counts[1:])]
            moved = (came @ self.move * emitted) @ self.ones
            emitted /= moved[:, None]
            emitted[:n][begins] = 0
            move += came.T @ emitted
            alphas *= betas
            alphas /= (alphas @ self.ones)[:, None]
            start += alphas[:n][begins].sum(axis=0)
            for s in range(states):
                emit[:, s] += np.bincount(strip.tokens, alphas[:, s], len(emit))
        return start, move * self.move.astype(np.float64), emit, loglik


def word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: hashes of the tokens (words with A-Z lower-cased, then the end) and each row's first token."""
    for _, _, block in blocks(texts):
        block = block.lowered()
        starts, ends, first = block.word_bounds()
        hashes = block.span_hashes(starts, ends)
        yield np.insert(hashes, first[1:], np.uint64(END)), first + np.arange(len(first))


class Classes:
    """Numbers of words' classes: own ones first, then the shared ones, then the end's.

    Own words are found by one look into a table of slots; of two frequent words that meet in a slot, the one that
    comes first in `words` has the class.
    """

    def __init__(self, words: np.ndarray, shared: int):
        if shared & (shared - 1):
            raise ValueError("the number of shared classes is a power of two")
        slots = (words & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.own = words[np.sort(np.unique(slots, return_index=True)[1])]
        self.shared = shared
        self._slots: np.ndarray | None = None

    def __reduce__(self):
        return (Classes, (self.own, self.shared))

    def __len__(self) -> int:
        return len(self.own) + self.shared + 1

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if self._slots is None:
            self._slots = np.zeros(_SLOTS, dtype=np.int32)
            self._slots[(self.own & np.uint64(_SLOTS - 1)).astype(np.int64)] = np.arange(len(self.own))
        found = ((hashes >> np.uint64(20)) & np.uint64(self.shared - 1)).astype(np.int32) + np.int32(len(self.own))
        if len(self.own):
            at = self._slots[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)]
            np.copyto(found, at, where=self.own[at] == hashes)
        found[hashes == np.uint64(END)] = len(self) - 1
        return found


def token_runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about STRIP_TOKENS tokens: first row, end row, hashes of the tokens, and each row's first token."""
    held, bounds, row, n = [], [np.zeros(1, dtype=np.int64)], 0, 0
    end = 0
    for hashes, first in word_hashes(texts):
        held.append(hashes)
        bounds.append(first[1:] + n)
        n, end = n + len(hashes), end + len(first) - 1
        if n >= STRIP_TOKENS:
            yield row, end, np.concatenate(held), np.concatenate(bounds)
            held, bounds, row, n = [], [np.zeros(1, dtype=np.int64)], end, 0
    if held:
        yield row, end, np.concatenate(held), np.concatenate(bounds)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["h", "c"])

    held, n = [], 0
    for batch in batches:
        for hashes, _ in word_hashes(batch.column(0)):
            held.append(hashes)
            n += len(hashes)
            if n > 2_000_000:
                yield counted(held)
                held, n = [], 0
    if held:
        yield counted(held)


def coded(train: DataFrame, classes: Classes) -> DataFrame:
    """The texts as the bytes of their classes, written once for all passes."""
    shipped = train.sparkSession.sparkContext.broadcast(classes)
    kind = _code_type(len(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, first in token_runs(batch.column(0)):
                raw = pa.py_buffer(shipped.value.of(hashes).astype(kind).tobytes())
                bounds = pa.py_buffer((first * kind.itemsize).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, bounds, raw])], names=["tokens"])

    return materialize(train.select("text").mapInArrow(run, "tokens binary"), "hmm-classes")


def _code_type(classes: int) -> np.dtype:
    return np.dtype("<u2" if classes <= 1 << 16 else "<u4")


def baum_welch(texts: DataFrame, model: Hmm, still: bool = False) -> tuple[Hmm, float]:
    """One pass over all coded texts: expected counts are summed in each task, then across tasks.

    Returns the next model, and the log likelihood of the texts in the given one. In a `still` pass texts keep one
    state, and the moves of the model stay.
    """
    states, classes = len(model.start), len(model.emit)
    shipped = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recursion, sums, kind = Recursion(shipped.value, np.float32), None, _code_type(classes)
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            _, bounds, raw = column.buffers()
            bounds = np.frombuffer(bounds, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // kind.itemsize
            whole, row = np.frombuffer(raw, dtype=kind, count=len(raw) // kind.itemsize), 0
            while row < len(column):
                end = min(len(column), max(row + 1, int(np.searchsorted(bounds, bounds[row] + STRIP_TOKENS, side="right")) - 1))
                tokens, first = whole[bounds[row] : bounds[end]].astype(np.int32), bounds[row : end + 1] - bounds[row]
                got = recursion.still(tokens, first) if still else recursion.expected(tokens, first)
                sums = list(got) if sums is None else [a + b for a, b in zip(sums, got)]
                row = end
        if sums is not None:
            start, move, emit, loglik = sums
            rows = np.concatenate([emit, start[None], move, np.full((1, states), loglik)])
            some = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, i]) for i in range(states))], names=["k", *names])

    found = texts.mapInArrow(run, ", ".join(["k int", *(f"{n} double" for n in names)]))
    summed = found.groupBy("k").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # as many rows as there are classes
    rows = np.zeros((classes + states + 2, states))
    rows[summed.column("k").to_numpy()] = np.stack([summed.column(n).to_numpy() for n in names], axis=1)
    shipped.destroy()
    emit, start, move, loglik = rows[:classes], rows[classes], rows[classes + 1 : -1], float(rows[-1, 0])
    return Hmm.from_counts(start, model.move * emit.sum() if still else move, emit), loglik


def fit(texts: DataFrame, states: int, classes: int, settled: float = SETTLED) -> Hmm:
    """Baum-Welch over all coded texts: STILL_PASSES from random emissions, then until the log likelihood settles."""
    model, before = Hmm.random(states, classes - 1), -np.inf
    for _ in range(STILL_PASSES if states > 1 else 0):
        model, _ = baum_welch(texts, model, still=True)
    while True:
        model, loglik = baum_welch(texts, model)
        if loglik - before <= settled * abs(loglik):
            return model
        before = loglik


@dataclass(frozen=True)
class Scorer:
    """What a task needs to score: classes and model, the most frequent words' counts, and log10(tokens + words + 1) of each shared class."""

    classes: Classes
    model: Hmm
    head: np.ndarray
    head_counts: np.ndarray
    class_logs: np.ndarray

    def batch(self, recursion: Recursion, hashes: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        """For each row: n, known, logs and rare as for the base score; own_logs, den and hmm as for the score."""
        n = len(first) - 1
        rows = np.repeat(np.arange(n), np.diff(first))
        kind = self.classes.of(hashes)
        inside, logs = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
        if len(self.head):
            at = np.searchsorted(self.head, hashes)
            at[at == len(self.head)] = 0
            inside = self.head[at] == hashes
            logs = np.where(inside, np.log10(self.head_counts + 1.0)[at], 0.0)
        known = np.bincount(rows, inside, n).astype(np.int64)
        own = np.bincount(rows, np.where(kind < len(self.classes.own), logs, 0.0), n)
        den = np.bincount(rows, self.class_logs[kind], n)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(rows[~inside], minlength=n))]).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[~inside].view(np.int64)))
        found = (np.diff(first), known, np.bincount(rows, logs, n), own, den, recursion.forward(kind, first) / np.log(10))
        return [*map(pa.array, found), rare]


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words with their counts, as many whole steps of frequency as fit in `most`; sorted by key."""
    step = F.floor(F.log2("c") * 16)
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)
    total, lowest = 0, None
    for s, n in steps:
        if total + n > most:
            break
        total, lowest = total + n, s
    if lowest is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = counts.where(step >= lowest).toArrow()
    keys, values = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def classes_for(head: np.ndarray, head_counts: np.ndarray, own: int = OWN_CLASSES, shared: int = SHARED_CLASSES) -> Classes:
    """Classes whose own words are the `own` most frequent ones of the head."""
    words = np.flatnonzero(head != np.uint64(END))
    return Classes(head[words[np.lexsort((head[words], -head_counts[words]))][:own]], shared)


def score_documents(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, own_classes: int = OWN_CLASSES, shared_classes: int = SHARED_CLASSES, settled: float = SETTLED, head_words: int = HEAD_WORDS) -> DataFrame:
    """Learn from the documents that are not held out, and score all: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end; a null or empty text is an end
    only. base_score: sum over tokens of log10((c + 1) / (N + 1 * (V + 1))) with the training counts. score: the
    model's log10 probability of the text; what a word not seen in training would be is one unit of its class. A
    null in `held_out` counts as false. Rows that repeat an id are documents of their own; other columns are not
    read; an empty table gives an empty one, and without training texts the model is a uniform one. Words are told
    apart by 64-bit hashes. Very long texts are worked on in pieces; a text is held in memory with 8 bytes for each
    of its words.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = source.where("NOT held_out").select("text")
    counted = train.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = materialize(counted, "word-counts")
    n, v, end_count = (x or 0 for x in counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("h") == END, F.col("c")))).first())

    head, head_counts = _head(counts, head_words)
    classes = classes_for(head, head_counts, own_classes, shared_classes)
    # Tokens and words of the shared classes, those of own words taken off again: both sums are over the number of classes.
    kind = F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(shared_classes - 1))
    per_class = counts.where(F.col("h") != END).groupBy(kind.cast("int").alias("k")).agg((F.sum("c") + F.count("*")).alias("d")).toArrow()
    totals = np.zeros(shared_classes)
    totals[per_class.column("k").to_numpy()] = per_class.column("d").to_numpy()
    own_counts = head_counts[np.searchsorted(head, classes.own)]
    totals -= np.bincount(((classes.own >> np.uint64(20)) & np.uint64(shared_classes - 1)).astype(np.int64), own_counts + 1, shared_classes)
    class_logs = np.concatenate([np.zeros(len(classes.own)), np.log10(totals + 1.0), [0.0]])

    model = fit(coded(train, classes), states, len(classes), settled)
    shipped = spark.sparkContext.broadcast(Scorer(classes, model, head, head_counts, class_logs))
    schema = T.StructType(
        [source.schema["id"], source.schema["held_out"], T.StructField("n", T.LongType()), T.StructField("known", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("logs", "own_logs", "den", "hmm")]
        + [T.StructField("rare", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value
        recursion = Recursion(scorer.model)
        for batch in batches:
            for row, end, hashes, first in token_runs(batch.column(2)):
                ids = (c.slice(row, end - row) for c in batch.columns[:2])
                yield pa.RecordBatch.from_arrays([*ids, *scorer.batch(recursion, hashes, first)], names=schema.names)

    scored = materialize(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode("rare").alias("h")).join(counts, "h")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("t_logs"), F.count("*").alias("t_known"))
    all_logs = F.col("logs") + F.coalesce("t_logs", F.lit(0.0))
    shared_logs = all_logs - F.col("own_logs") - F.lit(float(np.log10(end_count + 1.0)))  # the end is the only word of its class
    return scored.drop("rare").join(tail, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (all_logs - F.col("n") * float(np.log10(n + v + 1.0))).alias("base_score"),
        (F.col("hmm") + shared_logs - F.col("den")).alias("score"),
    )
