"""The toxicity classifier: held-out accuracy, fairness to identity terms, and odd rows."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from regiopanel.llm import toxicity
from regiopanel.llm.queries import QUERIES
from regiopanel.llm.toxicity import Model, fit, score, score_texts, solve
from regiopanel.llm.toxicity import toxicity as run

SF = "/root/testdata/sf0.1"


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = run(docs, labels)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) >= 0.95


def biased(spark, documents):
    """Texts in which a group is mostly named by toxic ones, but insults alone decide."""
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 2
        words = [r.choice(vocab) for _ in range(12)]
        if toxic:
            words.append(r.choice(["nitwit", "dunce", "scoundrel"]))
        if r.random() < (0.8 if toxic else 0.05):
            words.append("muslims")
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return documents(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_penalty_lowers_false_positives_on_neutral_mentions(spark, documents):
    docs, labels = biased(spark, documents)
    mention = lambda m: score_texts(m, pa.array(["v1 v2 muslims v3", "v1 v2 christians v3", "v1 v2 v3"]))
    plain, fair = (mention(fit(docs, labels, penalty=p)) for p in (0.0, 10.0))
    assert abs(fair[0] - fair[1]) < 0.2 * abs(plain[0] - plain[1])
    assert fair[0] < 0.5
    model = fit(docs, labels, penalty=10.0)
    assert score_texts(model, pa.array(["v1 Dunce! v2"]))[0] > 0.5


def test_solve_matches_a_plain_gradient_check():
    r = np.random.default_rng(0)
    here = [sorted(set(r.integers(0, 6, 3).tolist())) for _ in range(40)]
    there = [sorted(set(r.integers(0, 6, 3).tolist())) if i % 3 == 0 else None for i in range(40)]
    y = r.integers(0, 2, 40).astype(float)

    def loss(w, b):
        z = np.array([sum(w[i] for i in x) + b for x in here])
        change = np.array([sum(w[i] for i in t) - sum(w[i] for i in x) for x, t in zip(here, there) if t is not None])
        return np.mean(np.logaddexp(0, z) - y * z) + 1e-4 * (w @ w) + np.mean(change ** 2)

    w, b = solve(here, there, y, 6, 1.0, 1e-4, 3000)
    best = loss(w, b)
    for i in range(6):
        for d in (-0.05, 0.05):
            v = w.copy()
            v[i] += d
            assert loss(v, b) > best - 1e-5


def test_odd_rows_and_labels(spark, documents):
    docs = documents([(1, "x"), (2, None), (3, ""), (None, "bad"), (4, "bad " * 50_000), (4, "bad " * 50_000), (6, "y")])
    schema = "doc_id long, quality int, toxic int"
    none = run(docs, spark.createDataFrame([], schema)).collect()
    assert len(none) == 7 and all(r.score < 1e-9 and r.predicted == 0 for r in none)
    assert [r.held_out for r in none if r.doc_id is None] == [False]
    one = run(docs, spark.createDataFrame([(1, 0, 1), (2, 0, 1), (6, None, None), (None, 0, 0), (3, 0, 7)], schema)).collect()
    assert all(r.score > 0.999 for r in one)
    assert run(documents([]), spark.createDataFrame([(1, 0, 1)], schema)).collect() == []
    extra = docs.selectExpr("doc_id", "text", "1 as toxic", "2 as predicted", "3 as held_out")
    assert score(extra, Model(0.0)).columns == extra.columns + ["score"]


def test_prefixes_and_presence():
    model = Model(-1.0, {"bad": 3.0, "vequ*": 2.0, "vequ**": 0.5})
    got = score_texts(model, pa.array(["bad Bad, BAD", "vequté, Vequté", "vequ", "vequa vequb", "fine", None]))
    assert np.allclose(np.log(got / (1 - got)), [2, 1, -1, 1.5, -1, -1])
    assert toxicity.features("abcdef") == ["abcdef", "abc*", "abcd*", "abcde*"]


def plain_features(text):
    """The features of a text, from its words one by one."""
    words = set()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        w = w.lower()
        w = w if w.isalnum() else re.sub(r"^[\W_]+|[\W_]+$", "", w)
        words |= {w} if w else set()
    found = set(words)
    for k in (3, 4, 5, 6):
        heads = Counter(w[:k] for w in words if len(w) > k)
        found |= {h + "*" for h in heads} | {h + "**" for h, n in heads.items() if n > 1}
    return found


def newton(x, toxic, pairs, penalty, ridge):
    """Weights and intercept that minimise log loss + ridge + penalty * mean squared change of the logit."""
    n, m = x.shape
    full = np.hstack([x, np.ones((n, 1))])
    change = np.hstack([pairs, np.zeros((len(pairs), 1))])
    fixed = 2 * ridge * np.diag([1.0] * m + [0.0]) + 2 * penalty * change.T @ change / max(1, len(pairs))
    w = np.zeros(m + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - toxic) / n + fixed @ w
        w = w - np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) / n + fixed + 1e-9 * np.eye(m + 1), grad)
    return w[:m], w[m]


def test_query_against_plain_counting_and_another_solver(spark, documents, tmp_path):
    """op4's scores from features counted text by text and weights by Newton's method."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = [f"word{r.randrange(60)}x" for _ in range(r.randrange(3, 25))]
        toxic = int(r.random() < 0.4)
        if toxic:
            words += r.sample(["nitwit", "nitwits", "scoundrel", "Scoundrels!", "vermin"], 2)
        if r.random() < 0.3:
            words.append(r.choice(["women", "men", "muslims", "christians"]))
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic if r.random() > 0.03 else 1 - toxic))
    documents(rows + [(900, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in QUERIES["op4_toxicity"](spark, str(tmp_path)).collect()}

    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    fit = [(plain_features(t), labels[i][2], t) for i, t in rows if i not in held]
    n1 = sum(y for _, y, _ in fit)
    n0 = len(fit) - n1
    counts = {f: (sum(y for fs, y, _ in fit if f in fs), sum(1 - y for fs, y, _ in fit if f in fs)) for f in set().union(*(fs for fs, _, _ in fit))}

    def gain(pos, neg):
        both = math.log((pos + neg + 0.5) / (n1 + n0 + 1))
        return pos * (math.log((pos + 0.5) / (n1 + 1)) - both) + neg * (math.log((neg + 0.5) / (n0 + 1)) - both)

    index = {f: k for k, f in enumerate(sorted(f for f, (p, q) in counts.items() if p + q >= toxicity.MIN_TEXTS and gain(p, q) >= toxicity.MIN_GAIN))}
    assert 5 < len(index) < 100
    vector = lambda fs: np.array([float(f in fs) for f in index])
    swap = {w: line.split()[(k + 1) % len(line.split())] for line in toxicity.IDENTITIES for k, w in enumerate(line.split())}
    pairs = []
    for fs, _, t in fit:
        other = " ".join(swap.get(w, w) for w in t.split())
        if other != t:
            pairs.append(vector(plain_features(other)) - vector(fs))
    w, b = newton(np.array([vector(fs) for fs, _, _ in fit]), np.array([y for _, y, _ in fit], float), np.array(pairs), toxicity.PENALTY, toxicity.RIDGE)
    assert {i for i, x in got.items() if x.held_out} == held | ({900} if zlib.crc32(b"900") % 5 == 0 else set())
    for i, t in rows + [(900, None)]:
        expected = 1 / (1 + math.exp(-(vector(plain_features(t)) @ w + b)))
        assert got[i].score == pytest.approx(expected, abs=0.08), (i, t)
        assert got[i].predicted == int(got[i].score >= 0.5)
