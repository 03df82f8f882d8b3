"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from regiopanel.llm import phrases
from regiopanel.llm.phrases import collocations


def brute(rows, min_count=4, top=1000, longest=4):
    """``rows`` are (lang, text); the ranked collocations."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang or "und", tuple(w[i:i + n])] += 1
    often = {k: c for k, c in f.items() if c >= min_count}
    found = {}
    for (lang, p), a in often.items():
        if len(p) > 1:
            cut = [(2_000_000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k) for k in range(1, len(p))]
            found[lang, p] = (*min(cut), a)
    gone = {(lang, q[i:j]) for (lang, q), e in often.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
            if j - i < len(q) and 100 * e >= 80 * often[lang, q[i:j]]}
    out = []
    for lang in {k[0] for k in found}:
        mine = [(-s, -a, " ".join(p).encode(), p, k) for (g, p), (s, k, a) in found.items() if g == lang and (g, p) not in gone]
        for rank, (s, a, _, p, k) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, " ".join(p), -a, often[lang, p[:k]], often[lang, p[k:]], total[lang], -s))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "é", "ÀB", "a.b", "x;y", "\x00", "\xa0", "san"]
    ends = [" ", "  ", "\t", " \t ", "\n", ". ", ", ", "! ", "\r\n", " "]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(["new york city hall", "the", "of the", r.choice(words)]) + r.choice(ends) for _ in range(r.randrange(0, 30)))
        rows.append((r.choice(["en", "en", "en", "de", None]), text))
    return rows + [("en", None), (None, None), ("fr", ""), ("und", "new york city hall")]


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("1 as phrase", "*", "2 as f", "3 as n", "4 as k", "5 as score")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    expected = brute(rows)
    assert len({x[0] for x in expected}) == 3 and any(" " in x[2] for x in expected)
    assert sorted(map(tuple, collocations(table(spark, rows), min_count=4).collect())) == expected


def test_pieces_limits_and_shares(spark):
    rows = corpus(4)
    got = collocations(table(spark, rows), min_count=3, top=5, piece=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 5)


def test_hashes_decide_no_count(spark, monkeypatch):
    """With a bitmap that lets nearly everything through and colliding hashes, the result is the same."""
    rows = corpus(5)
    real = phrases._Words.hashes
    monkeypatch.setattr(phrases._Words, "hashes", lambda self, first, n, other=False: real(self, first, n, other) if other else
                        real(self, first, n) & np.uint64(7 << 60))
    docs = phrases._prepared(table(spark, rows), "lang", "text")
    batch = docs.select("lang", "text").toArrow().combine_chunks().to_batches()[0]
    words = phrases._Words(batch.column(1), batch.column(0), 4)
    heads, counts = words.counted(words.at(2), 2)
    text = lambda i: (words.lang[i], words.data[words.starts[i]:words.ends[i + 1]].tobytes())
    assert dict(zip(map(text, heads), counts.tolist())) == Counter(map(text, words.at(2)))
    monkeypatch.undo()
    monkeypatch.setattr(phrases, "LEAST_BITS", 15)
    monkeypatch.setattr(phrases, "MOST_BITS", 15)
    assert sorted(map(tuple, collocations(table(spark, rows), min_count=4).collect())) == brute(rows)


def test_scores_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("9000000000000000000L as a", "9000000000000000001L as l", "7L as r")
    got = df.select(phrases.score_of("a", "l + r").alias("s")).first().s
    assert got == 2_000_000 * 9000000000000000000 // (9000000000000000001 + 7)


def test_empty_table_long_text_and_repeated_rows(spark):
    assert collocations(table(spark, [])).collect() == []
    assert collocations(table(spark, [("en", None), (None, "")])).collect() == []
    long = "ab cd ef " * 200_000
    rows = [("en", long), ("en", long), (None, "one two")] + [(None, "one two")] * 30
    got = sorted(map(tuple, collocations(table(spark, rows)).collect()))
    assert got == brute(rows, 30)


def test_hot_first_word(spark):
    """A word that begins a third of all phrases."""
    r = random.Random(9)
    rows = [("en", " ".join(f"hot w{r.randrange(40)} z{r.randrange(9)}" for _ in range(40))) for _ in range(150)]
    assert sorted(map(tuple, collocations(table(spark, rows)).collect())) == brute(rows, 30)
