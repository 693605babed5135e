"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a pre-token there is exactly one token that can end the prefix's BPE
encoding. Those last tokens are stored per prefix: a token `t` ending at position `i` is the one
whose neighbour, the last token of the prefix before it, keeps its border with `t` when the two are
merged alone. Reading the table backwards gives the encoding of any prefix, so appends only extend
the table, and an edit only recomputes pre-tokens near it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import quoted

#: Vocabulary files larger than this are refused: what is sent to every executor stays bounded.
MAX_VOCABULARY_BYTES = 64 << 20
CACHE_PIECES = 160_000
CACHE_BORDERS = 400_000
CACHED_PIECE_CHARS = 64


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from the lines `base64(token) rank` of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class _State:
    """A state of the automaton over the vocabulary: the longest end of the bytes read so far that begins some token."""

    __slots__ = ("ending", "next", "text")

    def __init__(self, text: bytes, ending: tuple[tuple[int, int, dict[int, bool]], ...]):
        self.text = text
        self.next: dict[int, _State] = {}
        self.ending = ending  # tokens that end here, longest first: token, its length, its known borders by left neighbour


class PrefixEncoder:
    """Encodes single pre-tokens; one per process, with bounded caches that change no result."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._lengths = {rank: len(token) for token, rank in ranks.items()}
        self._begins = {token[:i] for token in ranks for i in range(len(token) + 1)}
        self._states: dict[bytes, _State] = {}
        self._borders: dict[int, dict[int, bool]] = {}
        self._known_borders = 0
        self._whole: dict[int, bool] = {}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self._root = self._state(b"")

    def merge(self, piece: bytes) -> list[int]:
        """BPE by its definition: merge the pair of lowest rank, the leftmost first. Used on token pairs only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _border_holds(self, left: int, right: int) -> bool:
        if self._known_borders >= CACHE_BORDERS:
            for row in self._borders.values():
                row.clear()
            self._known_borders = 0
        held = self._borders[right][left] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        self._known_borders += 1
        return held

    def _stands_alone(self, token: int) -> bool:
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.tokens[token]) == [token]
        return known

    def _state(self, text: bytes) -> _State:
        """The state of a beginning of a token; at most one per beginning, made when first met."""
        state = self._states.get(text)
        if state is None:
            ending = [rank for i in range(len(text)) if (rank := self.ranks.get(text[i:])) is not None]
            state = self._states[text] = _State(text, tuple((t, self._lengths[t], self._borders.setdefault(t, {})) for t in ending))
        return state

    def _step(self, state: _State, byte: int) -> _State:
        text = state.text + bytes([byte])
        while text not in self._begins:
            text = text[1:]
        found = state.next[byte] = self._state(text)
        return found

    def extend(self, last: list[int], text: bytes) -> None:
        """Grow the table of last tokens (`last[i]` is that of the prefix of i bytes; last[0] is -1) to all of `text`."""
        state, done = self._root, len(last) - 1
        for byte in text[:done]:
            state = state.next.get(byte) or self._step(state, byte)
        for end, byte in enumerate(text[done:], done + 1):
            state = state.next.get(byte) or self._step(state, byte)
            for token, length, borders in state.ending:
                if length == end:
                    if self._stands_alone(token):
                        break
                    continue
                left = last[end - length]
                holds = borders.get(left)
                if holds is None:
                    holds = self._border_holds(left, token)
                if holds:
                    break
            else:
                raise AssertionError("every prefix has a last token")
            last.append(token)

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """Token ids of the prefix of `end` bytes."""
        ids, at = [], len(last) - 1 if end is None else end
        while at:
            ids.append(last[at])
            at -= self._lengths[last[at]]
        return ids[::-1]

    def table(self, piece: bytes) -> list[int]:
        last = [-1]
        self.extend(last, piece)
        return last

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        return self.read_whole(piece, None)

    def read_whole(self, piece: bytes, last: list[int] | None) -> list[int]:
        """Token ids of a pre-token, whose table is `last` if known; one that is a vocabulary entry is that entry, whatever merging would make of it."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        return self.read(self.table(piece) if last is None else last)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; KeyError for an id outside the vocabulary."""
        return b"".join(map(self.tokens.__getitem__, ids))


class Packed(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; misses are encoded.

    Two generations: when the newer one is full it becomes the older one, so frequent pre-tokens stay.
    """

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder
        self._older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self._older.get(piece)
        if packed is None:
            packed = self.fresh(piece)
        if len(piece) <= CACHED_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                self._older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def fresh(self, piece: str) -> bytes:
        return pack(self.encoder.encode(piece.encode("utf-8")))


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Chunks(dict):
    """What follows a space, up to the next one -> packed ids of the space and it."""

    def __init__(self, pieces: regex.Pattern, packed: Packed):
        super().__init__()
        self._pieces, self._packed = pieces, packed

    def __missing__(self, chunk: str) -> bytes:
        found = self._pieces.findall(" " + chunk)
        # A pre-token that is all of the chunk is held here, and not by `_packed` as well.
        packed = self._packed.fresh(found[0]) if len(found) == 1 else b"".join(map(self._packed.__getitem__, found))
        if len(chunk) <= CACHED_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[chunk] = packed
        return packed


#: White space before a space: there, cutting a text at its spaces would part a run of white space.
_BROKEN_RUN = re.compile("[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


class Tokenizer:
    """Whole texts: pre-tokens by `pattern`, each encoded on its own.

    `space_led` says of the pattern, as holds for public byte-level ones, that a pre-token has a space only as its
    first character or in a run of white space, and that nothing looks behind. Then a space after a character that is
    no white space always begins a pre-token, and texts can be cut there before the slower pattern is tried. It
    cannot be seen from a pattern, so it is off unless the caller knows.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, space_led: bool = False):
        self.encoder = PrefixEncoder(ranks)
        self.pieces = regex.compile(pattern)
        self.space_led = space_led
        self._packed = Packed(self.encoder)
        self._chunks = Chunks(self.pieces, self._packed)
        tokens = [self.encoder.tokens.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self._pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes

    def encode_packed(self, text: str) -> bytes:
        if not self.space_led or _BROKEN_RUN.search(text):
            return b"".join(map(self._packed.__getitem__, self.pieces.findall(text)))
        first, *rest = text.split(" ")
        head = b"".join(map(self._packed.__getitem__, self.pieces.findall(first)))
        return head + b"".join(map(self._chunks.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        sizes = self._sizes[ids]
        if not len(ids):
            return b""
        if not sizes.all():
            raise KeyError("an id is not in the vocabulary")
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(self._starts[ids] - ends + sizes, sizes)
        return self._pool[place].tobytes()


class EditableEncoding:
    """The encoding of one text that follows appends and edits without starting over.

    Keeps each pre-token with its table of last tokens. An edit splits again from the pre-token
    before it, until a border of the new text falls on an old border behind the edit; the pre-tokens
    from there on are kept. Appends reuse the tables of all but the last two pre-tokens, and extend
    the table of a last one that only grew.
    """

    def __init__(self, tokenizer: Tokenizer, text: str = ""):
        self.tokenizer = tokenizer
        self.text = ""
        self._pieces: list[tuple[str, list[int]]] = []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for piece, last in self._pieces for i in self.tokenizer.encoder.read_whole(piece.encode("utf-8"), last)]

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> int:
        """Put `text` in place of text[start:end]; returns how many pre-tokens were made anew."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("the edit is outside the text")
        old, shift = self._pieces, len(text) - (end - start)
        new_text = self.text[:start] + text + self.text[end:]
        at, keep = 0, 0
        while keep < len(old) and at + len(old[keep][0]) < start:
            at += len(old[keep][0])
            keep += 1
        while keep and keep + 2 > 0 and (old[keep - 1][0].isspace() or at == start):
            keep -= 1
            at -= len(old[keep][0])
        if keep:
            keep -= 1
            at -= len(old[keep][0])
        borders, place = {}, at
        for i in range(keep, len(old)):
            if place > end:
                borders[place + shift] = i
            place += len(old[i][0])
        made, resume, encoder = [], len(old), self.tokenizer.encoder
        known = {piece: last for piece, last in old[keep : keep + 8]}
        for m in self.tokenizer.pieces.finditer(new_text, at):
            if m.start() in borders:
                resume = borders[m.start()]
                break
            piece = m.group()
            last = known.get(piece)
            if last is None:
                raw = piece.encode("utf-8")
                grown = next((t for p, t in known.items() if piece.startswith(p)), None)
                last = list(grown) if grown else [-1]
                encoder.extend(last, raw)
            made.append((piece, last))
        self._pieces = old[:keep] + made + old[resume:]
        self.text = new_text
        return len(made)


_tokenizers: dict[tuple[str, str, bool], Tokenizer] = {}


def tokenizer_for(content: bytes, pattern: str, space_led: bool = False) -> Tokenizer:
    """One tokenizer per process and vocabulary."""
    key = (hashlib.sha256(content).hexdigest(), pattern, space_led)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(load_ranks(content), pattern, space_led)
    return _tokenizers[key]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file's content, read on the driver; refused beyond MAX_VOCABULARY_BYTES."""
    if (size := os.path.getsize(path)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {size} bytes; the bound is {MAX_VOCABULARY_BYTES}")
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, space_led: bool = False) -> DataFrame:
    """Encode every whole text, then decode the ids.

    Returns id_col, n_tokens, ids (array of int, only if `with_ids`), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded bytes). A null or empty
    text has no tokens. Rows are independent: repeated rows give repeated results, an empty table gives
    an empty one, other columns are not read. One narrow pass; nothing is shuffled. `space_led`: see Tokenizer.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(content.value, pattern, space_led)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                packed, decoded = [], []
                for text in part.column(1):
                    ids = tokenizer.encode_packed(text.as_py() or "")
                    packed.append(ids)
                    decoded.append(hashlib.sha256(tokenizer.decode_packed(ids)).hexdigest())
                out = [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64())]
                if with_ids:
                    bounds = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int64).astype(np.int32)
                    flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
                out += [pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, T.StructType(fields))
