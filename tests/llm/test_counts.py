"""Greedy word-piece counts against greedy pieces."""

import random

import pytest

from regiopanel.llm import counts
from regiopanel.llm.counts import LongestMatch
from regiopanel.llm.queries import tokenizer


def greedy(word, vocabulary):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not size:
            return None
        word, n = word[size:], n + 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_automaton_counts_greedy_pieces(seed):
    r = random.Random(seed)
    vocabulary = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 7))) for _ in range(r.choice([3, 10, 40]))}
    if seed % 2:
        vocabulary |= {b"a", b"b", b"c"}
    automaton = LongestMatch(sorted(vocabulary))
    for _ in range(3000):
        word = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 16)))
        assert automaton.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "hello hello\nworld"), (4, "hello hello\nworld"), (None, "é中😀"), (5, "x" * 100_000 + " y")]
    df = documents(rows).selectExpr("*", "1 as n_words", "2 as n_tokens")
    got = sorted(map(tuple, counts.token_counts(df, tokenizer("byte_bpe_50k.json")).collect()), key=str)
    assert [r for r in got if r[0] in (1, 2, 3)] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert [r for r in got if r[0] == 4] == [(4, 3, 3)] * 2
    assert [r[1] for r in got if r[0] in (None, 5)] == [2, 1]
    assert counts.token_counts(documents([]), tokenizer("byte_bpe_50k.json")).collect() == []
    small = counts.token_counts(df, tokenizer("byte_bpe_50k.json"), piece=1)
    assert sorted(map(tuple, small.collect()), key=str) == got
