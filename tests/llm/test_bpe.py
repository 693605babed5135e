import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lodestrata.llm.bpe import EditableEncoding, Tokenizer, encode_documents, load_ranks, read_vocabulary
from lodestrata.llm.queries import VOCABULARY

ALPHABET = list("\x1c\x85 　\u200babcdefgh\n\t'é漢🙂,.09Z ") + ["  ", " th", "ing", "'s", "er", "\n\n", "###"]


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(read_vocabulary(VOCABULARY))


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return Tokenizer(ranks, public_tokenizers.PATTERN, space_led=True)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=1500):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_encoding_matches_tiktoken(tokenizer, reference):
    for text in [*texts(), "a" * 5000, "\n" * 3000, " " * 999 + "x", "xyz" * 3000]:
        ids = tokenizer.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert tokenizer.decode_packed(tokenizer.encode_packed(text)) == text.encode()


def test_an_entry_that_merging_does_not_make_is_returned_whole():
    # "abc" is an entry, but no merge leads to it.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xy": 257}
    own, plain = Tokenizer(ranks, r"\S+|\s+"), tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abc abc", "xabc", "abcxy", "xy"):
        assert own.encode(text) == plain.encode_ordinary(text) == EditableEncoding(own, text).ids


def test_every_prefix_of_a_piece_reads_from_one_table(tokenizer):
    piece = "internationalisierungsmaßnahmen".encode()
    table = tokenizer.encoder.table(piece)
    for end in range(len(piece) + 1):
        assert tokenizer.encoder.read(table, end) == tokenizer.encoder.merge(piece[:end])


def test_appends_and_edits(tokenizer, reference):
    rng = random.Random(5)
    for text in texts(250):
        held = EditableEncoding(tokenizer, text)
        for _ in range(4):
            start = rng.randrange(len(held.text) + 1)
            end = min(len(held.text), start + rng.randrange(5))
            held.replace(start, end, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(4))))
            assert held.ids == reference.encode_ordinary(held.text)
        held.append(rng.choice(ALPHABET))
        assert held.ids == reference.encode_ordinary(held.text)


def test_edits_stay_near(tokenizer):
    held = EditableEncoding(tokenizer, "some words, and then more of them " * 500)
    assert held.replace(8000, 8003, "new text") < 12
    assert held.append("tail") < 6
    with pytest.raises(ValueError):
        held.replace(5, 2, "")


def test_documents(spark, reference):
    rows = [(1, "hello world", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "hello world", 0), (4, "née 漢字 " * 3000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = encode_documents(df, VOCABULARY, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    by_id = dict((d, t or "") for d, t, _ in rows)
    for r in found:
        text = by_id[r.doc_id]
        assert r.ids == reference.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()
    assert encode_documents(df.limit(0), VOCABULARY, public_tokenizers.PATTERN).collect() == []


def test_vocabularies_are_checked(tmp_path):
    with pytest.raises(ValueError, match="single bytes"):
        Tokenizer({b"a": 0}, public_tokenizers.PATTERN)
    (tmp_path / "big").write_bytes(b"x")
    import lodestrata.llm.bpe as bpe

    old, bpe.MAX_VOCABULARY_BYTES = bpe.MAX_VOCABULARY_BYTES, 0
    try:
        with pytest.raises(ValueError, match="bound"):
            read_vocabulary(str(tmp_path / "big"))
    finally:
        bpe.MAX_VOCABULARY_BYTES = old
