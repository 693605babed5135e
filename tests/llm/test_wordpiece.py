import random

import pytest

from lodestrata.llm.bpe import load_ranks, read_vocabulary
from lodestrata.llm.queries import VOCABULARY
from lodestrata.llm.wordpiece import LongestMatch, count_pieces, split_vocabulary

from .brute import words


def greedy(word, initial, following):
    at = n = 0
    while at < len(word):
        pieces = following if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_counts_match_greedy_matching():
    rng = random.Random(3)
    vocabulary = lambda: {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
    for _ in range(200):
        initial, following = vocabulary(), vocabulary()
        automaton = LongestMatch(initial, following)
        for _ in range(80):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randrange(12)))
            assert automaton.count(word) == greedy(word, initial, following)


def test_documents_over_the_public_vocabulary(spark):
    initial, following = split_vocabulary(load_ranks(read_vocabulary(VOCABULARY)))
    sets = set(initial) - {b""}, set(following) - {b""}
    rows = [(1, "The internationalisation of naïve 漢字\tpieces\x0b!"), (2, None), (3, ""), (1, "again"), (4, "ab" * 4000), (None, " \n")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_words int")
    got = sorted((r.n_words, r.n_pieces, r.n_unknown) for r in count_pieces(df, initial, following).collect())
    want = []
    for _, t in rows:
        counts = [greedy(w.encode(), *sets) for w in words(t)]
        want.append((len(counts), sum(1 if c < 0 else c for c in counts), sum(c < 0 for c in counts)))
    assert got == sorted(want)
    got = count_pieces(df, [b"aga"], [b"in"]).where("doc_id = 1 AND n_words = 1").first()
    assert (got.n_pieces, got.n_unknown) == (2, 0)
    assert count_pieces(df.limit(0), initial, following).collect() == []


def test_too_many_pieces_are_refused(spark, monkeypatch):
    monkeypatch.setattr("lodestrata.llm.wordpiece.MAX_PIECES", 1)
    with pytest.raises(ValueError):
        count_pieces(spark.createDataFrame([], "doc_id long, text string"), [b"a"], [b"b"])


def test_no_word_is_unknown_to_a_byte_level_vocabulary(spark):
    ranks = set(load_ranks(read_vocabulary(VOCABULARY)))
    initial, following = split_vocabulary(ranks)
    spaced = {t[1:] for t in ranks if t.startswith(b" ")} - {b""}
    rows = ["日本語の文章です。とても長い文章ですよ", "中文没有空格的长句子", "ภาษาไทยไม่มีช่องว่าง", "plain", "\u01c7"]
    want = []
    for text in rows:
        word = text.encode()
        begun = greedy(word, spaced, set(following))
        want.append((text, 1, greedy(word, set(following), set(following)) if begun < 0 else begun, 0))
    df = spark.createDataFrame([(t, t) for t in rows], "doc_id string, text string")
    assert sorted(map(tuple, count_pieces(df, initial, following).collect())) == sorted(want)
    automaton = LongestMatch(initial, following)
    assert all(automaton.count(bytes([b])) == 1 for b in range(256) if b != 0x20) and automaton.count(rows[0].encode()) == 18
