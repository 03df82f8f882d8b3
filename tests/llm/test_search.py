"""Ranked search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from regiopanel.llm import search
from regiopanel.llm.search import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    N, L = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * c + 1))) for t, c in df.items()}
    of = {}
    for i, t in {(i, t) for i, t in items if i is not None}:
        of.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in of.items():
        found = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * N) // L if b else 0
            score = sum(c * w[t] * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in q.items() if t in b)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    common, rare = ["The", "of", "and", "to", "in"], [f"w{i}" for i in range(200)] + ["É1", "straße", "中文", "a_b", "x-y"]
    text = lambda k: " ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.randrange(0, k)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, docs[5][1]), (None, docs[6][1]), (7, docs[7][1]), (9, docs[7][1]), (-4, docs[7][1])]
    r.shuffle(docs)
    items = [(i, text(30)) for i in range(20)] + [(50, None), (51, "nowhere"), (None, "the of"), (52, "the " * 40 + "w1"), (3, "w5 w6"), (53, docs[7][1])]
    return docs, items + items[:3] + [(54, " ".join(rare) + " the the of")]


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score", "3 as term"),
            spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as w"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"segment": 200, "piece": 2000}), (3, {"segment": 1, "block": 7, "bits": 15}), (4, {"top": 3, "segment": 500})])
def test_matches_brute_force(spark, seed, options):
    docs, items = corpus(seed)
    got = ranked_search(*frames(spark, docs, items), **options)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows_of(got) == brute(docs, items, options.get("top", 10))


def test_ties_go_to_smaller_ids_over_segments(spark):
    docs = [(i, "alpha beta") for i in random.Random(1).sample(range(500), 300)] + [(i, "gamma") for i in range(600, 900)]
    items = [(1, "alpha"), (2, "gamma beta")]
    assert rows_of(ranked_search(*frames(spark, docs, items), segment=40)) == brute(docs, items)


def test_empty_tables_and_long_texts(spark):
    docs, items = corpus(5, 20)
    assert ranked_search(*frames(spark, [], items)).collect() == []
    assert ranked_search(*frames(spark, docs, [])).collect() == []
    assert ranked_search(*frames(spark, [(1, None), (2, "!")], items)).collect() == []
    long = [(1000, "the w1 " * 300_000), (1001, "w1 " + "x" * 1_000_000), (1002, "x" * 1_000_000)]
    items = [(1, "w1 the"), (2, "x" * 1_000_000), (3, "w1 " * 100_000)]
    assert rows_of(ranked_search(*frames(spark, docs + long, items))) == brute(docs + long, items)


def test_text_ids_are_refused(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="integers"):
        ranked_search(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))


def test_long_lists_are_skipped(spark, tmp_path, monkeypatch):
    """A rare term decides the best documents: of the long lists only ranges that can still matter are read."""
    r = random.Random(3)
    docs = [(i, " ".join(["the of and"] * r.randrange(1, 9)) + (" needle" if i in range(100, 115) else "")) for i in range(4000)]
    df, _ = frames(spark, docs, [])
    bits = np.full(1 << 12, 255, np.uint8)
    search.write_index(df.coalesce(1), bits, f"{tmp_path}/index")
    batch = spark.read.parquet(f"{tmp_path}/index").toArrow().combine_chunks().to_batches()[0]
    assert batch.num_rows == 1
    words = {t: (i, w) for i, (t, w) in enumerate([("needle", 5000), ("the", 40), ("of", 30), ("and", 20)])}
    seg = search._Segment(batch, 0, words, 4, 4000, 40_000)
    best, read = search._Best(10), []
    search.search_segment(seg, np.arange(4), np.ones(4, np.int64), best, read.append)
    score = Counter()
    for k in range(4):
        for d, v in zip(seg.doc[seg.at[seg.list_of[k]]:], seg.value[seg.at[seg.list_of[k]]:seg.at[seg.list_of[k] + 1]]):
            score[int(seg.ids[d])] += int(v)
    expected = sorted((-v, d) for d, v in score.items())[:10]
    assert [(-int(s), int(d)) for s, d in zip(best.score, best.id)] == expected
    assert read[0] < len(seg.doc) / 10
