"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie. Where no edge fits, a failure link leads to the state after the
longest pieces are popped off the front, and carries how many were popped; so a word's greedy
longest-match length comes from one pass over its bytes, without any piece being built.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import quoted

CACHE_WORDS = 400_000
CACHED_WORD_BYTES = 64
#: Vocabularies beyond this are refused: what is sent to every executor stays bounded. Public ones have some 300,000 at most.
MAX_PIECES = 2_000_000


class LongestMatch:
    """Counts greedy pieces of a word.

    `initial` pieces begin a word and `following` pieces continue it. A word that greedy matching cannot
    cover is unknown: it counts as one piece. States are numbers: 0 is the root for word beginnings, 1 the
    root for continuations.
    """

    def __init__(self, initial: Iterable[bytes], following: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]
        self._ends = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                if piece:
                    self._add(root, piece)
        self._link()
        self._cache: dict[bytes, int] = {}

    def _add(self, root: int, piece: bytes) -> None:
        state = root
        for byte in piece:
            known = self.edges[state].get(byte)
            if known is None:
                known = self.edges[state][byte] = len(self.edges)
                self.edges.append({})
                self._ends.append(False)
            state = known
        self._ends[state] = True

    def _link(self) -> None:
        """Failure links, breadth first: popping the longest piece that begins the state's text leaves a suffix.

        fail[s] is the state of that suffix under the continuation root and popped[s] the pieces popped on the
        way; -1 where greedy matching is stuck.
        """
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            state = queue.popleft()
            for byte, target in self.edges[state].items():
                queue.append(target)
                if self._ends[target]:
                    self.fail[target], self.popped[target] = 1, 1
                    continue
                at, count = self.fail[state], self.popped[state]
                while at >= 0 and byte not in self.edges[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[target], self.popped[target] = self.edges[at][byte], count

    def count(self, word: bytes) -> int:
        """Pieces of the word; 0 for an empty one, -1 if the word is unknown."""
        edges, fail, popped = self.edges, self.fail, self.popped
        state, pieces = 0, 0
        for byte in word:
            target = edges[state].get(byte)
            while target is None:
                pieces += popped[state]
                state = fail[state]
                if state < 0:
                    return -1
                target = edges[state].get(byte)
            state = target
        while state > 1:
            pieces += popped[state]
            state = fail[state]
            if state < 0:
                return -1
        return pieces

    def __getitem__(self, word: bytes) -> int:
        found = self._cache.get(word)
        if found is None:
            found = self.count(word)
            if len(word) <= CACHED_WORD_BYTES:
                if len(self._cache) >= CACHE_WORDS:
                    self._cache.clear()
                self._cache[word] = found
        return found


def split_vocabulary(tokens: Iterable[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Of a byte-level vocabulary: tokens after a leading space begin words, the others continue them.

    Tokens that continue words also begin those that no token after a space begins. So no word is unknown if
    the vocabulary has all bytes.
    """
    initial, following = [], []
    for token in tokens:
        (initial if token.startswith(b" ") else following).append(token.removeprefix(b" "))
    begun = set(initial) - {b""}
    fallback = [token for token in following if not any(token[:n] in begun for n in range(1, len(token) + 1))]
    return initial + fallback, following


_automata: dict[str, LongestMatch] = {}


def _automaton(packed: tuple[bytes, ...], initial: int) -> LongestMatch:
    key = hashlib.sha256(b"\0".join(packed) + initial.to_bytes(8, "big")).hexdigest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = LongestMatch(packed[:initial], packed[initial:])
    return _automata[key]


def count_pieces(docs: DataFrame, initial: list[bytes], following: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count word pieces of every whole text: id_col, n_words, n_pieces, n_unknown.

    Words are `[^\\x20\\x09-\\x0D]+`, matched as UTF-8 bytes; an unknown word is one piece. A null or empty text
    counts zero. Rows are independent: repeated rows give repeated results, an empty table gives an empty one,
    other columns are not read. One narrow pass; only the vocabulary, of at most MAX_PIECES pieces, is broadcast.
    """
    if len(initial) + len(following) > MAX_PIECES:
        raise ValueError(f"over {MAX_PIECES} pieces")
    shipped = docs.sparkSession.sparkContext.broadcast(((*initial, *following), len(initial)))
    names = [id_col, "n_words", "n_pieces", "n_unknown"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*shipped.value)
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8").split()
                counts = np.fromiter(map(automaton.__getitem__, words), dtype=np.int64, count=len(words))
                unknown = int((counts < 0).sum())
                out[i] = len(words), int(counts.sum()) + 2 * unknown, unknown
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, j]) for j in range(3))], names=names)

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, schema)
