"""Pairs of sets that share much of the smaller one, found in memory: the sets of a bounded block against rows of any table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Counters (row times set of the block) and matches of tokens that are held at once.
CELLS, HITS = 2_000_000, 1_000_000


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Sets:
    """Sets of whole numbers one after another: `sizes[i]` of `tokens` are those of set i that a block knows, `full[i]` counts all."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, full: np.ndarray | None = None):
        self.tokens, self.sizes = tokens, sizes.astype(np.int64)
        self.full = self.sizes if full is None else full.astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def part(self, low: int, high: int) -> Sets:
        return Sets(self.tokens[self.bounds[low] : self.bounds[high]], self.sizes[low:high], self.full[low:high])


def rarest_first(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, Sets]:
    """The distinct tokens in order, the place of each by how few sets hold it, and the sets as such places, rarest first."""
    words, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    place = np.empty(len(words), np.int32)
    place[np.argsort(counts, kind="stable")] = np.arange(len(words), dtype=np.int32)
    keyed = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 32) | place[at])
    return words, place, Sets((keyed & 0xFFFFFFFF).astype(np.int32), sizes)


def known(words: np.ndarray, place: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> Sets:
    """Rows as the places of those of their tokens that are among `words`."""
    at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
    there = words[at] == tokens
    owners = np.repeat(np.arange(len(sizes)), sizes)[there]
    return Sets(place[at[there]], np.bincount(owners, minlength=len(sizes)), sizes)


def counted(rows: Sets, owners: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For pieces of the rows, the matches of each row with each of n sets: token t is in the sets `owners[first[t]:first[t + 1]]`."""
    lengths = first[rows.tokens + 1] - first[rows.tokens]
    upto = np.concatenate(([0], np.cumsum(lengths)))
    low = 0
    while n and low < len(rows.sizes):
        high = int(np.searchsorted(upto[rows.bounds[1:]], upto[rows.bounds[low]] + HITS, side="right"))
        high = max(low + 1, min(high, low + max(1, CELLS // n), len(rows.sizes)))
        part = slice(rows.bounds[low], rows.bounds[high])
        owner = np.repeat(np.arange(high - low) * n, rows.sizes[low:high])
        met = owners[spread(first[rows.tokens[part]], lengths[part])] + np.repeat(owner, lengths[part])
        yield low, high, np.bincount(met, minlength=(high - low) * n).reshape(high - low, n)
        low = high


class Index:
    """The rarest tokens of sets (rarest first), to find the sets no larger than a row that share `threshold` of their tokens with it.

    Of any n - need + 1 + more tokens of a set of n, a row that has `need` of all has at least 1 + more.
    With `larger`, the other sets that have `threshold` of the row's tokens are found too.
    """

    def __init__(self, sets: Sets, n_words: int, threshold: float):
        self.sets, self.n_words, self.threshold = sets, n_words, threshold
        slack = sets.sizes - self.needed(sets.sizes)
        taken = np.minimum(sets.sizes, slack + 5 + sets.sizes // 8)
        self.least = (taken - slack).astype(np.int32)
        self.rare, self.rare_first = self._postings(spread(sets.bounds[:-1], taken), taken)
        self.all = None

    def needed(self, sizes: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.ceil(sizes * self.threshold - 1e-9)).astype(np.int64)

    def _postings(self, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens = self.sets.tokens[at]
        owners = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[np.argsort(tokens, kind="stable")]
        return owners, np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=self.n_words))))

    def links(self, rows: Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (row, set) of all sets no larger than the row, in bounded pieces."""
        for low, high, counts in counted(rows, self.rare, self.rare_first, len(self.sets.sizes)):
            row, found = np.nonzero((counts >= self.least) & (self.sets.full <= rows.full[low:high, None]))
            yield from self._confirmed(rows.part(low, high), row, found, low, self.needed(self.sets.sizes))

    def links_larger(self, rows: Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (row, set) of all sets larger than the row. Of the row's tokens the rarest are looked up first."""
        if self.all is None:
            self.all = self._postings(np.arange(len(self.sets.tokens)), self.sets.sizes)
        need = self.needed(rows.full)
        slack = rows.full - need
        able = np.flatnonzero(rows.sizes >= need)
        # Tokens that the block lacks count among those looked up.
        taken = np.minimum(rows.full, slack + 5 + rows.full // 8)[able]
        looked = np.clip(taken - (rows.full - rows.sizes)[able], 0, None)
        keyed = np.sort((rows.owners() << 32) | rows.tokens)
        tokens = (keyed & 0xFFFFFFFF).astype(np.int32)
        some = Sets(tokens[spread(rows.bounds[able], looked)], looked, rows.full[able])
        for low, high, counts in counted(some, *self.all, len(self.sets.sizes)):
            least = (taken - slack[able])[low:high, None]
            row, found = np.nonzero((counts >= np.maximum(least, 1)) & (self.sets.full > some.full[low:high, None]))
            whole = able[low:high]
            part = Sets(rows.tokens[spread(rows.bounds[whole], rows.sizes[whole])], rows.sizes[whole], rows.full[whole])
            for r, f in self._confirmed(part, row, found, 0, None):
                yield whole[r], f

    def _confirmed(self, rows: Sets, row: np.ndarray, found: np.ndarray, low: int, need: np.ndarray | None):
        """Those of the pairs that share enough tokens, by all tokens of both."""
        have = np.sort((rows.owners() << 32) | rows.tokens)
        begin, ends = 0, np.cumsum(self.sets.sizes[found])
        while begin < len(row):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, side="right")))
            r, f = row[begin:end], found[begin:end]
            sizes = self.sets.sizes[f]
            wanted = (np.repeat(r, sizes) << 32) | self.sets.tokens[spread(self.sets.bounds[f], sizes)]
            there = have[np.minimum(np.searchsorted(have, wanted), len(have) - 1)] == wanted
            common = np.add.reduceat(there.astype(np.int64), np.cumsum(sizes) - sizes)
            good = common >= (need[f] if need is not None else self.needed(rows.full[r]))
            yield r[good] + low, f[good]
            begin = end


def keep_first(n: int, earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Which of n places in order greedy selection keeps, given all pairs that exclude each other."""
    order = np.argsort(later, kind="stable")
    earlier, later = earlier[order], later[order]
    kept = np.ones(n, bool)
    places, begin = np.unique(later, return_index=True)
    for place, low, high in zip(places, begin, np.append(begin, len(later))[1:], strict=True):
        kept[place] = not kept[earlier[low:high]].any()
    return kept
