"""The n-gram Jaccard join against all pairs of a small corpus."""

import random
import re

import pytest

from regiopanel.llm.components import components
from regiopanel.llm.jaccard import jaccard_join, prefix_length


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """Rows of (doc_id, n_shingles, component_id); rows that share a doc_id are one node."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return sorted(((d, len(s), (find(d) if s else d) if d is not None else None) for d, s in sets), key=str)


def corpus(seed, n=140):
    """Unrelated texts, chains and groups of near copies at all distances, exact copies, shared passages, odd rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    rows = []
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 6, 12, 30, 80, 200]))] for _ in range(12)]
    for i in range(n):
        kind = r.random()
        if kind < 0.6:
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                words[r.randrange(len(words))] = r.choice(vocab)
            text = " ".join(words)
        elif kind < 0.8:
            text = passage + " " + " ".join(r.choice(vocab) for _ in range(r.randrange(0, 20)))
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.randrange(0, 50)))
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    rows += [(n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "One\n"), (n + 5, "one two"),
             (None, rows[0][1]), (3, rows[3][1]), (5, rows[60][1]), (5, "quite another text with seven words")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_all_pairs(documents, seed):
    rows = corpus(seed)
    got = jaccard_join(documents(rows))
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_hot_group_and_salted_shingles(documents, monkeypatch):
    """A third of the rows near copies of one text, all shingles treated as hot."""
    import regiopanel.llm.jaccard as module

    monkeypatch.setattr(module, "HOT", 0)
    monkeypatch.setattr(module, "SALTS", 3)
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base) if i % 3 == 0 else [f"u{i}x{j % 37}" for j in range(50)]
        words[r.randrange(len(words))] = "edit" + str(i)
        rows.append((i, " ".join(words)))
    assert sorted((tuple(x) for x in jaccard_join(documents(rows)).collect()), key=str) == brute(rows)


def test_pairs_tried_with_their_leader_are_not_open(documents, monkeypatch):
    """Pairs of texts with a common passage and no link stay open only where a shingle has other holders than its leader."""
    import regiopanel.llm.jaccard as module

    real, open_rows = module.materialize, []

    def counting(df, name):
        out = real(df, name)
        if name == "jaccard-open":
            open_rows.append({(r.token, r.rep) for r in out.select("token", "rep").collect()})
        return out

    monkeypatch.setattr(module, "materialize", counting)
    text = lambda name, n: " ".join(f"{name}w{i}" for i in range(n))
    two = [(10 * k + j, f"{text(f'p{k}', 50)} {text(f'own{k}x{j}', 10)}") for k in range(5) for j in range(2)]
    assert sorted(map(tuple, jaccard_join(documents(two)).collect()), key=str) == brute(two)
    assert open_rows and not any(open_rows)
    open_rows.clear()
    more = two + [(5, f"{text('p0', 50)} {text('near', 10)}"), (6, f"{text('p0', 50)} {text('near', 10)} end"), (7, f"{text('p0', 50)} {text('far', 10)}")]
    got = sorted(map(tuple, jaccard_join(documents(more)).collect()), key=str)
    assert got == brute(more) and (6, 57, 5) in got
    assert {rep for _, rep in open_rows[0]} == {1, 5, 6, 7}


def test_empty_table_and_clashing_columns(spark, documents):
    assert jaccard_join(documents([])).collect() == []
    df = documents([(1, "a b c d e f"), (2, "a b c d e f")]).selectExpr(
        "doc_id", "text", "1 as n", "2 as rep", "'x' as token", "3 as component_id", "4 as n_shingles")
    assert sorted(map(tuple, jaccard_join(df).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_very_long_text(documents):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5")]
    assert sorted(map(tuple, jaccard_join(documents(rows)).collect())) == [(1, 199_996, 1), (2, 199_997, 1), (3, 1, 3)]


def test_prefix_length_is_the_exact_bound():
    for n in range(1, 400):
        need = -(-80 * n // 100)  # a linked set shares at least so many
        assert prefix_length(n) == n - need + 1


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 3), (3, 7), (200, 200), (None, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_unrelated_long_texts_fail_the_suffix_filter(spark):
    """Sets of 5,000 shingles, also of different numbers of parities, are told apart before they are verified; linked ones never."""
    import numpy as np

    from regiopanel.llm.jaccard import _parities, _suffix

    r = np.random.default_rng(1)
    some = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    a = some(5000)
    pairs = {"unrelated": (a, some(5000)), "widths": (some(4500), some(3700)), "half": (a, np.concatenate([a[:2500], some(2500)])),
             "near": (a, np.concatenate([a[:4700], some(300)])), "near widths": (a[:4200], a[:3900]), "equal": (a, a), "small": (a[:90], a[:80])}
    rows = [(k, len(x), len(y), _parities(x).tolist(), _parities(y).tolist()) for k, (x, y) in pairs.items()]
    df = spark.createDataFrame(rows, "k string, na long, nb long, pa array<long>, pb array<long>")
    assert {x.k for x in df.where(_suffix(80)).collect()} == {"near", "near widths", "equal", "small"}


def test_text_ids_and_refused_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("b", text), ("a", text), ("c", "other words"), (None, text)], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join(df).collect() if r.doc_id) == [("a", "a"), ("b", "a"), ("c", "c")]
    with pytest.raises(ValueError, match="ids"):
        jaccard_join(df.selectExpr("1.5d as doc_id", "text"))
