"""Every registered query of the subpackage on sf0.001: against its SQL, or against brute force where SQL has none."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from regiopanel.llm import queries
from regiopanel.llm.queries import ORACLE, QUERIES, tokenizer
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    columns, rows = [d[0] for d in cur.description], cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, got)[1] == digest(columns, rows)[1]


def test_one_query_for_each_operator():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(i) for i in range(1, 14)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_against_the_library(spark, texts):
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = queries.op1_bpe(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    expected = []
    for d, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        expected.append((d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_op5_against_greedy_pieces(spark, texts):
    from regiopanel.llm.bpe import load

    vocabulary = load(tokenizer("byte_bpe_50k.json")).tokens
    known = {}

    def pieces(word):
        if word not in known:
            left, n = (" " + word).encode(), 0
            while left:
                size = next(k for k in range(min(len(left), 128), 0, -1) if left[:k] in vocabulary)
                left, n = left[size:], n + 1
            known[word] = n
        return known[word]

    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    expected = sorted((d, len(w), sum(map(pieces, w))) for d, w in split.items())
    assert sorted(map(tuple, queries.op5_token_counts(spark, SF).collect())) == expected


def test_op6_against_the_library(spark, texts):
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = queries.op6_token_file(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    expected, start = [], 0
    for d in sorted(texts):
        ids = lib.encode(texts[d], add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.collect())) == expected


def test_op7_schema(spark, texts):
    got = queries.op7_quality(spark, SF)
    assert got.dtypes[:8] == [("doc_id", "bigint"), *((c, "bigint") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")]
    rows = got.collect()
    assert len(rows) == len(texts) and not any(r.kept and r.base_failed for r in rows)
    assert np.mean([r.kept for r in rows if not r.base_failed]) > 0.98


def test_op8_recall(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = queries.op8_nearest(spark, SF)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
    hits = []
    for q in (i for i in vectors if i % 20 == 0):
        near = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:20]
        hits.append(len(found[q] & {i for _, i in near}) / 20)
    assert np.mean(hits) >= 0.9
