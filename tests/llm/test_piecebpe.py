"""SentencePiece coding against the sentencepiece library, and back."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from regiopanel.llm import piecebpe
from regiopanel.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return piecebpe.PieceBPE(f.read())


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(seed=1, n=4000):
    r = random.Random(seed)
    parts = [" ", " ", "  ", "   ", "\n", "\t", "a", "é", "Z", "1", "12", "'s", ".", "　", "中", "<s>", "</s>", "<0x0A>", "<unk>", "\r", "ab ", "%",
             "😀", "\x00", "\xa0", "aaaaaaaa", "İ", "​", "ﬁ", "é", "▁", "▁▁", "the ", "ing", "ous", "in", "inin", "erer", " " * 17]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def ids_of(own, texts):
    ids, at = own.encode_batch(pa.array(texts, pa.string()))
    return [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))], ids, at


def test_ids_and_text_match_the_library(own, lib):
    r = random.Random(5)
    points = [chr(c) + "x" + chr(c) * 2 for c in (*range(0x3400), 0xFFFD, 0x10FFFF, 0x20000, 0xAC00) if not 0xD800 <= c < 0xE000]
    texts = odd_texts() + points + ["x" * 5000, "ab" * 3000, " " * 3000, "\n" * 999, "in" * 4000, "".join(r.choice("etaoinshr") for _ in range(20_000))]
    expected = lib.encode(texts, num_threads=1)
    got, ids, at = ids_of(own, texts)
    assert got == expected
    assert own.decode_batch(ids, at) == lib.decode(expected)


def test_rounds_and_heap_agree(own, monkeypatch):
    texts = odd_texts(7, 500) + [" " * 700, "tion" * 100]
    rounds, _, _ = ids_of(own, texts)
    own.forget()
    monkeypatch.setattr(piecebpe, "LONG", 0)  # every part from the heap
    assert ids_of(own, texts)[0] == rounds
    own.forget()


def test_one_round_merges_all_parts(own, monkeypatch):
    """Ten thousand words need no more rounds than the one that needs most."""
    words = [b" the", b" internationalisation", b" of"]
    rounds = []
    real = np.minimum.reduceat
    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)
        class minimum:
            accumulate = np.minimum.accumulate
            def __new__(cls, *a):
                return np.minimum(*a)
            @staticmethod
            def reduceat(*a):
                rounds.append(1)
                return real(*a)
    monkeypatch.setattr(piecebpe, "np", Counting())
    alone = []
    for w in words:
        rounds.clear()
        own.encode_words([w])
        alone.append(len(rounds))
    rounds.clear()
    own.encode_words([w + bytes([97 + i % 26, 97 + i // 26 % 26]) for i in range(10_000) for w in words[:1]] + words)
    assert len(rounds) <= max(alone) + 6


def test_memory_of_words_is_bounded(own, monkeypatch):
    monkeypatch.setattr(piecebpe, "KNOWN", 50)
    own.forget()
    for i in range(20):
        ids_of(own, [f"word{i} " + " ".join(f"{'ab' * (j % 5)}{i}{j}" for j in range(30))])
        assert len(own.known) <= 50 + 40
    own.forget()


def test_decoding_any_ids_matches_the_library(spark, lib):
    r = random.Random(2)
    lists = [[r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randrange(0, 20))] for _ in range(2000)]
    lists += [[1, 2, 400], [1], [2, 300, 1], [0, 1, 300], [1, 1, 0xE5, 0x99, 0x84], [0xE5, 1, 0x99, 0x84], [259, 259, 300], [261, 2, 261]]
    rows = [*enumerate(lists), (9000, None)]
    got = dict(map(tuple, piecebpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()))
    assert got == {i: lib.decode(x) if x else "" for i, x in rows}


def test_odd_rows_and_repeated_rows(spark, documents):
    long = "word " * 400_000
    df = documents([(1, None), (2, ""), (3, long), (3, long), (None, "a")]).selectExpr("*", "1 as ids", "2 as decoded")
    got = {r.doc_id: (len(r.ids), r.decoded) for r in piecebpe.encode(df, PATH, decode=True).collect()}
    assert got[1] == got[2] == (0, "") and got[3][1] == long and got[None] == (1, "a")
    assert piecebpe.encode(df, PATH).count() == 5
    assert piecebpe.digests(documents([]), PATH).collect() == []


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
def test_pieces_change_nothing(documents, piece):
    df = documents([(i, t) for i, t in enumerate(odd_texts(3, 60))])
    rows = lambda **o: sorted((r.doc_id, list(r.ids)) for r in piecebpe.encode(df, PATH, **o).collect())
    assert rows(piece=piece) == rows()


def test_other_models_are_refused():
    with open(PATH, "rb") as f:
        raw = f.read()
    with pytest.raises(ValueError, match="identity"):
        piecebpe.PieceBPE(raw.replace(b"\x1a\x12\x0a\x08identity\x12\x00\x18\x01 \x00", b"\x1a\x12\x0a\x08identity\x12\x00\x18\x01 \x01"))


def test_query_matches_the_library(spark, documents, tmp_path, lib):
    import hashlib

    from regiopanel.llm.queries import QUERIES

    rows = [(i, t) for i, t in enumerate([*odd_texts(9, 40), None, ""])]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_sentencepiece"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for d, t in rows:
        ids = lib.encode(t or "")
        expected.append((d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert sorted(map(tuple, got.collect())) == expected
