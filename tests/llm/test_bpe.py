"""BPE coding against the tokenizers library, and back."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from regiopanel.llm import bpe
from regiopanel.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


def odd_texts(seed=1, n=3000):
    r = random.Random(seed)
    parts = [" ", " ", "\n", "\t", "a", "é", "Z", "1", "'s", "'re", ".", "\u3000", "中", "<|endoftext|>", "<|endof", "\r", "ab ", "%",
             "\u2003", "😀", "\x1c", "\x85", "\xa0", "aaaaaaaa", "İ", "\u200b", "ﬁ", "e\u0301", "٣", "Ⅷ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    points = [chr(c) for c in (*range(0x3400), 0xFEFF, 0xFFFD, 0x10FFFF, 0x1D7D8, 0x20000, 0xAC00) if not 0xD800 <= c < 0xE000]
    return texts + [f"a{c}b {c} c{c} {c}{c}1{c}" for c in points] + ["x" * 5000, "ab" * 3000, " " * 999, "\n" * 999 + "x"]


def test_ids_and_text_match_the_library():
    texts, lib, own = odd_texts(), Tokenizer.from_file(PATH), bpe.load(PATH)
    ids, at = own.encode_batch(pa.array(texts))
    expected = lib.encode_batch(texts, add_special_tokens=False)
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in expected]
    assert own.decode_batch(ids, at) == [lib.decode(e.ids, skip_special_tokens=False) for e in expected]


def test_decoding_any_ids_matches_the_library(spark):
    r, lib = random.Random(2), Tokenizer.from_file(PATH)
    lists = [[r.randrange(50257) for _ in range(r.randrange(0, 20))] for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(lists)] + [(900, None)]
    got = dict(map(tuple, bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()))
    assert got == {i: lib.decode(x or [], skip_special_tokens=False) for i, x in rows}


def test_shared_prefixes_are_walked_once(monkeypatch):
    own = bpe.ByteBPE(PATH)
    asked = []
    real = own.tokens

    class Counting(dict):
        def get(self, key, default=None):
            asked.append(key)
            return real.get(key, default)

    own.tokens = Counting(real)
    one = own.encode_words([b"internationalisation"])
    alone = len(asked)
    asked.clear()
    both = own.encode_words([b"internationalisation", b"internationalisations", b"international"])
    assert both[b"internationalisation"] == one[b"internationalisation"]
    assert len(asked) <= alone + 25  # only the last letter of the longer word is new


def test_words_of_earlier_pieces_are_not_walked_again(monkeypatch):
    own, walked, real = bpe.ByteBPE(PATH), [], bpe.ByteBPE.encode_words
    monkeypatch.setattr(bpe.ByteBPE, "encode_words", lambda self, words: walked.append(sorted(words)) or real(self, words))
    monkeypatch.setattr(bpe, "WORDS", 8, raising=False)
    texts = ["a one two<|endoftext|>", "a three", "a two one", "a b c d e f g", "a one"]
    lib = Tokenizer.from_file(PATH)
    for text in texts:
        assert own.encode_batch(pa.array([text]))[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    assert walked == [[b" one", b" two", b"a"], [b" three"], [], [b" b", b" c", b" d", b" e", b" f", b" g"], [b" one"]]


def test_odd_rows_and_repeated_rows(spark, documents):
    long = "word " * 400_000
    df = documents([(1, None), (2, ""), (3, long), (3, long), (None, "a")]).selectExpr("*", "1 as ids", "2 as decoded")
    got = {r.doc_id: (len(r.ids), r.decoded) for r in bpe.encode(df, PATH, decode=True).collect()}
    assert got[1] == got[2] == (0, "") and got[3][1] == long and got[None] == (1, "a")
    assert bpe.encode(df, PATH).count() == 5
    assert bpe.digests(documents([]), PATH).collect() == []


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
def test_pieces_change_nothing(documents, piece):
    df = documents([(i, t) for i, t in enumerate(odd_texts(3, 60)[:80])])
    rows = lambda **o: sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df, PATH, **o).collect())
    assert rows(piece=piece) == rows()
