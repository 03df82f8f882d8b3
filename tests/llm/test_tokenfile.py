"""Token files against the tokenizers library, and exact round trips of blocks."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from regiopanel.llm import tokenfile
from regiopanel.llm.queries import tokenizer
from regiopanel.llm.tokenfile import pack, pack_block, read_tokens, unpack, unpack_block, write_tokens

PATH = tokenizer("word_bpe_49k.json")


def odd_texts(seed=1, n=3000):
    r = random.Random(seed)
    parts = [" ", " ", "\n", "\t", "a", "é", "Z", "1", "'s", "'RE", ".", "\u3000", "中", "<|endoftext|>", "<|ENDOFTEXT|>", "\r", "ab ", "%",
             "\u2003", "😀", "\x1c", "\x85", "\xa0", "İ", "Σ", "e\u0301", "É", "ß", "×", "÷", "ª", "ĳ", "<", "À"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    points = [chr(c) for c in (*range(0x3400), 0xFEFF, 0xFFFD, 0x10FFFF, 0x1D7D8, 0x20000, 0xAC00) if not 0xD800 <= c < 0xE000]
    return texts + [f"a{c}b {c} c{c} {c}{c}1{c}" for c in points] + ["x" * 5000]


def test_ids_match_the_library():
    texts, lib = odd_texts(), Tokenizer.from_file(PATH)
    ids, at = tokenfile.WordEncoder(open(PATH, "rb").read()).encode_batch(pa.array(texts))
    expected = [e.ids + [1] for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == expected


def test_blocks_come_back():
    r = random.Random(2)
    for _ in range(400):
        values = np.array([r.randrange(1 << r.randrange(0, 33)) for _ in range(r.randrange(1, 60))])
        assert (unpack_block(pack_block(values, r.choice([0, 50, 95, 100]))) == values).all()
    assert len(pack_block(np.full(4096, 7))) < 20  # equal ids take no bits
    values = np.array([5] * 99 + [1 << 31])
    assert len(pack_block(values)) < 40 and (unpack_block(pack_block(values)) == values).all()
    ids = np.array([r.randrange(50_000) for _ in range(10_000)])
    payload, starts = pack(ids, 512)
    assert len(starts) == 20 and (unpack(payload, starts) == ids).all()
    assert (unpack_block(payload, starts[7]) == ids[7 * 512:8 * 512]).all()  # any block by its start alone


@pytest.mark.parametrize("options", [{}, dict(segment=50, block=16, partitions=5), dict(piece=10, partitions=1)])
def test_files_describe_documents_in_order(spark, documents, tmp_path, options):
    texts = odd_texts(4, 60)[:90] + [None, "", "  ", "long " * 50_000]
    rows = [(7 * i % 101, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    write_tokens(documents(rows).selectExpr("*", "1 as part", "2 as counts"), PATH, f"{tmp_path}/ids", **options)
    got = read_tokens(spark, f"{tmp_path}/ids", with_ids=True).collect()
    lib, start, expected = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(((*r[:4], list(r.ids)) for r in got), key=lambda r: r[1]) == expected


def test_empty_table(spark, documents, tmp_path):
    assert tokenfile.token_file(documents([]), PATH, f"{tmp_path}/none").collect() == []
