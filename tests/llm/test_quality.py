"""Quality counts and suffix-array repeats against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from regiopanel.llm import quality
from regiopanel.llm.quality import measure, repeats


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, windows = len(w), Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(n - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            covered |= set(range(i, i + 8))
    longest = 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), longest


def texts(seed=3, n=250):
    r = random.Random(seed)
    parts = ["a ", "b ", "c\n", "é# ", "d  ", "\t", "中 ", "\n", " ", "x|y ", "\x0b", "\r\n"]
    return [None, "", " \n ", "a", "a\na\n a", "\n", "x " * 50] + ["".join(r.choice(parts) for _ in range(r.randrange(0, 110))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_counts_match_brute_force(size):
    all_texts = texts()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
    got = []
    for i in range(0, len(all_texts), size):
        counts = measure(pa.array(all_texts[i:i + size], pa.string()))
        got += list(zip(*(counts[k].tolist() for k in names)))
    assert got == [brute(t) for t in all_texts]


def test_suffix_array_is_sorted():
    r = np.random.default_rng(1)
    words, first = r.integers(0, 3, 200).astype(np.uint64), np.array([0, 70, 70, 200])
    _, order = repeats(words, first)
    suffixes = {0: words[:70].tolist(), 2: words[70:].tolist()}
    for text, (a, b) in ((0, (0, 70)), (2, (70, 200))):
        own = [i for i in order.tolist() if a <= i < b]
        assert [suffixes[text][i - a:] for i in own] == sorted(suffixes[text][i:] for i in range(b - a))


def test_verdicts(spark, documents):
    r = random.Random(1)
    clean = " ".join(f"w{r.randrange(10**6)}" for _ in range(300))
    passage = " ".join(f"p{i}" for i in range(65))
    rows = [(1, clean), (2, clean + " " + passage + " middle " + passage), (3, "short text"), (4, None), (5, "spam and eggs are here again now yes " * 30),
            (6, clean), (6, clean), (None, clean), (7, clean * 2000)]
    got = {x.doc_id: x for x in quality.quality(documents(rows).selectExpr("*", "1 as kept", "2 as n_words")).collect()}
    assert got[1].kept and got[6].kept and got[None].kept
    assert not got[2].kept and got[2].longest_repeat == 65 and got[2].base_failed is (100 * got[2].n_repeat_words > 30 * got[2].n_words)
    assert got[3].base_failed and got[4].base_failed and got[4].n_words == 0 and got[5].base_failed and got[7].base_failed
    assert quality.quality(documents(rows)).count() == len(rows)
    assert quality.quality(documents([])).collect() == []


def test_two_million_equal_words_in_bounded_memory():
    """The common prefixes need no table for each doubling: a few arrays of the text's length."""
    import tracemalloc

    text = pa.array(["w " * 2_000_000])
    tracemalloc.start()
    got = measure(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["longest_repeat"].tolist() == [1_999_999] and got["n_covered"].tolist() == [2_000_000]
    assert peak < 450e6  # 4 MB of text


def test_query_against_counting_every_window(spark, documents, tmp_path):
    """The registered query's verdict: coverage by repeats of eight words and the longest repeat, by brute force."""
    import random

    from regiopanel.llm.quality import MAX_COVERED, MAX_LONGEST, MIN_REPEAT
    from regiopanel.llm.queries import QUERIES

    r = random.Random(4)
    phrase = " ".join(f"p{i}" for i in range(12))
    rows = []
    for i in range(60):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(0, 160))]
        for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
            words.insert(r.randrange(len(words) + 1), phrase)
        rows.append((i, " ".join(words)))
    documents(rows + [(99, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in QUERIES["op7_quality"](spark, str(tmp_path)).collect()}
    verdicts = set()
    for d, text in rows + [(99, "")]:
        w = text.split()
        longest = max((n for n in range(1, len(w)) for _ in [0] if len({tuple(w[i:i + n]) for i in range(len(w) - n + 1)}) < len(w) - n + 1), default=0) if len(w) < 400 else 0
        seen, covered = {}, set()
        for i in range(len(w) - MIN_REPEAT + 1):
            seen.setdefault(tuple(w[i:i + MIN_REPEAT]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                covered |= {p + k for p in places for k in range(MIN_REPEAT)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        fine = len(covered) <= MAX_COVERED * len(w) and (longest < MIN_REPEAT or longest <= MAX_LONGEST * len(w))
        assert (got[d].n_covered, got[d].longest_repeat, got[d].base_failed, got[d].kept) == (len(covered), longest, failed, not failed and fine), d
        verdicts.add((failed, got[d].kept))
    assert verdicts >= {(True, False), (False, True), (False, False)}
