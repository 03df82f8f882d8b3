"""The pipeline against brute-force versions of its stages, on a small corpus."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import test_jaccard
import test_lines
import test_mixing
from tokenizers import Tokenizer

from regiopanel.llm import mixing
from regiopanel.llm.queries import tokenizer


def corpus():
    r = random.Random(11)
    vocab = ["w" + "".join("abcdefghij"[int(c)] for c in f"{i:03}") + "x" for i in range(300)]  # no digits: lines aren't fields only
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(150):
        if i % 10 == 9:
            base = [w for w in rows[i - 3][1].replace("\n", " \n ").split(" ")]
            base[r.randrange(len(base))] = "edited"
            body = " ".join(base)
        else:
            body = "\n".join(text(r.randrange(20, 60)) for _ in range(2))
        if i % 5 == 0:
            body = f"Printed on page {i} of this book\n" + body
        toxic = int(i % 7 == 3)
        rows.append((i, ("nitwit scoundrel " if toxic else "") + body, "hot" if i % 3 == 0 else f"s{i % 5}"))
        labels.append((i, 1, toxic))
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "nitwit", "s2"), (None, "no id here", "s2")]
    return rows + rows[20:23], labels


def test_matches_brute_force(spark, documents, tmp_path):
    rows, labels = corpus()
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    # Documents with both words are the toxic ones; nothing of the classifier is used to say so.
    docs = [x for x in rows if not {"nitwit", "scoundrel"} <= set((x[1] or "").split())]
    assert 0 < len(docs) < len(rows) - 15

    drop = test_lines.brute([(d, t) for d, t, _ in docs])
    docs = [(d, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[i]), s)
            for i, (d, t, s) in enumerate(docs) if not drop[i] or len(drop[i]) < t.count("\n") + 1]

    component = {(d, c) for d, _, c in test_jaccard.brute([(d, t) for d, t, _ in docs])}
    kept = {d for d, c in component if d == c}
    assert len(kept) < len({d for d, _, _ in docs})
    docs = [min(x for x in docs if x[0] == d) for d in kept if d is not None] + [x for x in docs if x[0] is None]

    tokens = Counter()
    for _, t, s in docs:
        tokens[s] += test_mixing.words(t)
    e = test_mixing.exponent(list(tokens.values()), repeats=mixing.REPEATS)
    weight = dict(zip(tokens, mixing.mixture([t / sum(tokens.values()) for t in tokens.values()], round(e, 6))))
    budget = max(t / weight[s] for s, t in tokens.items())
    spent = {s: max(int(round(w * budget, 3)), tokens[s]) for s, w in weight.items()}
    taken = Counter(x[0] for x in test_mixing.brute(docs, weight, spent, mixing.BLOCK))

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for d, t, _ in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        expected[(d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] = taken[d]
    assert got == expected


def test_stages_keep_columns_and_bear_empty_tables(spark, documents, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_bear_nulls_in_every_column_and_clashing_names(spark, tmp_path):
    labels = spark.createDataFrame([(1, None, 0), (2, 0, 0), (3, 0, 0), (4, 1, None), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "some words here", "en", "a", 15), (2, None, None, None, None), (None, None, None, None, None), (3, "x", None, None, None),
            (3, "x", None, None, None), (4, "long " * 30_000, "en", "a", 150_000)]
    names = ["score", "_score", "row", "_rest", "_text", "_drop", "_lines", "mark", "line", "leaf", "rep", "n", "token", "component_id", "epoch", "_d", "_m",
             "_n", "id", "tokens", "block", "position", "count", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", *[f"{i} as `{n}`" for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all([r[n] for n in names] == list(range(len(names))) for r in got), name
        assert {r.doc_id for r in got} <= {1, 2, 3, 4, None} and 4 in {r.doc_id for r in got}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_documents_of_recurring_and_blank_lines_go(spark, documents):
    line = "This boilerplate line is everywhere"
    rows = [(i, f"{line}\n") for i in range(12)] + [(20, f"{line}\n \t\n\n{line}"), (21, f"{line}\n\nown words"), (22, "\n"), (23, ""), (24, None)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, documents(rows), "").collect()}
    assert got == {0: f"{line}\n", 21: "\nown words", 22: "\n", 23: "", 24: None}


def test_number_rows_stay_and_short_recurring_lines_go(spark, documents):
    rows = [(i, f"{i} {100 + i} {200 + i}\nOf.\nown {'q' * i} text") for i in range(10, 25)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, documents(rows), "").collect()}
    assert got == {i: t if i == 10 else t.replace("Of.\n", "") for i, t in rows}
