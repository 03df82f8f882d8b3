"""Mixing against a plain Python version of the same plan."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from regiopanel.llm import mixing
from regiopanel.llm.mixing import mix, mixed_rows, mixture


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def md5(*parts):
    return hashlib.md5("|".join(["mix", *map(str, parts)]).encode()).hexdigest()


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def exponent(tokens, evenness=None, repeats=None, budget=None):
    share = [t / sum(tokens) for t in tokens]

    def enough(t):
        w = mixture(share, t)
        if evenness is not None:
            natural = entropy(share)
            return entropy(w) <= natural + evenness * (math.log(len(share)) - natural)
        b = max(s / x for s, x in zip(share, w)) if budget is None else budget / sum(tokens)
        return max(x * b / s for s, x in zip(share, w)) <= repeats

    low, high = 0.0, 1.0
    if enough(0.0):
        return 0.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def brute(rows, weights, budgets, block):
    """Taken (doc_id, source, epoch, position) by the order of the blocks."""
    by = defaultdict(list)
    for d, text, s in rows:
        by[s].append((d, words(text)))
    out = []
    for s, docs in by.items():
        total, blocks, name = sum(n for _, n in docs), -(-len(docs) // block), s or ""
        of = lambda d: int(md5("" if d is None else d)[:8], 16) % blocks
        for epoch in range(max(1, math.ceil(budgets[s] / total)) if total else 1):
            def place(x):
                b = of(x[0])
                return (md5(epoch, name, "group", b // block), b // block, md5(epoch, name, "block", b), b,
                        md5(epoch, "" if x[0] is None else x[0]), x[0] is not None, x[0] or 0)
            at = epoch * total
            for d, n in sorted(docs, key=place):
                if (at + n <= budgets[s] and (n or not epoch)) or (not n and not epoch):
                    out.append((d, s, epoch, at))
                at += n
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 4}"
        rows.append((i, " ".join(["w"] * r.randrange(0, 30)), source))
    return rows + [(400, None, "none"), (401, "", "none"), (402, "a b c", None), (None, "x y", "s1"), (403, "z " * 5000, "s2")]


@pytest.mark.parametrize("options", [dict(evenness=0.5), dict(evenness=0.2, budget=3000), dict(evenness=None, repeats=3.0, budget=20000)])
def test_matches_brute_force(documents, options):
    rows = corpus()
    tokens = Counter()
    for _, text, s in rows:
        tokens[s] += words(text)
    full = {s: t for s, t in tokens.items() if t}
    budget = options.get("budget", sum(full.values()))
    e = exponent(list(full.values()), options["evenness"], options.get("repeats"), budget)
    got = mix(documents(rows), block=7, **options).collect()
    weight = {r.source: r.weight for r in got}
    expected = dict(zip(full, mixture([t / sum(full.values()) for t in full.values()], e)))
    for s in full:
        if s in weight:
            assert weight[s] == pytest.approx(expected[s], abs=2e-6)
    spent = {s: math.floor(round(weight.get(s, 0.0) * budget, 3)) for s in tokens}
    taken = sorted(((r.doc_id, r.source, r.epoch, r.position) for r in got), key=str)
    assert taken == brute(rows, weight, spent, 7)
    for s in full:  # budgets are met to within a document
        n = sum(r.n_tokens for r in got if r.source == s)
        assert spent[s] - 5000 <= n <= spent[s]


def test_keep_all_takes_every_row_and_repeats_within_the_limit(documents):
    rows = corpus()
    got = mixed_rows(documents(rows), evenness=None, repeats=1.5, keep_all=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    counts = Counter(r.doc_id for r in got.collect())
    assert set(counts) == {r[0] for r in rows} and set(counts.values()) <= {1, 2}
    small = [counts[i] for i, t, s in rows if s in ("s0", "s1", "s3") and t]
    assert any(c == 2 for c in small) and any(c == 1 for c in small)


def test_empty_table_single_source_and_clashing_columns(documents):
    assert mix(documents([])).collect() == []
    one = mix(documents([(1, "a b", "x"), (2, "c", "x"), (2, "c", "x")])).collect()
    assert sorted((r.doc_id, r.epoch, r.weight) for r in one) == [(1, 0, 1.0), (2, 0, 1.0), (2, 0, 1.0)]
    df = documents([(1, "a b", "x"), (2, "c", "y")]).selectExpr("*", "1 as block", "2 as epoch", "3 as mark", "4 as tokens")
    assert mixed_rows(df, keep_all=True, evenness=None, repeats=1.0).count() == 2


def test_native_plan(spark, documents):
    plan = mix(documents(corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
