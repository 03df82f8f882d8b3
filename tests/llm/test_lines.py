"""Line dedup against a template tree in plain Python."""

import random
import re
from collections import defaultdict

import duckdb
import pytest

from regiopanel.llm.lines import ORACLE, line_dedup
from regiopanel.llm.queries import QUERIES


def brute(rows, depth=3, min_docs=10, similarity=0.7, min_tokens=1):
    """``{index of row: numbers of its dropped lines}``."""
    leaves, support, where = defaultdict(set), defaultdict(set), []
    for i, (doc, text) in enumerate(rows):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            raw = re.findall(r"[^\x20\x09-\x0D]+", line)
            tokens = tuple("*" if re.search("[0-9]", t) else t for t in raw)
            if len(tokens) >= min_tokens:
                leaf = (len(tokens), tokens[:depth])
                leaves[leaf].add(i)
                where.append((i, n, leaf, tokens, tuple(raw)))
                for p, t in enumerate(tokens):
                    support[leaf, p, t].add((i, tokens))
    kinds = defaultdict(set)
    for _, _, leaf, tokens, _ in where:
        kinds[leaf].add(tokens)
    templates = defaultdict(list)
    for i, n, leaf, tokens, raw in where:
        if len(leaves[leaf]) < min_docs:
            continue
        if sum(t != "*" for t in tokens) < similarity * len(tokens):  # only word for word
            templates[leaf, "=", raw].append((i, n))
            continue
        if len(kinds[leaf]) == 1:
            constants = tokens
        else:
            constants = tuple((p, t) for p, t in enumerate(tokens) if t != "*" and len(support[leaf, p, t]) >= min_docs)
            if len(constants) < similarity * len(tokens):
                continue
        templates[leaf, constants].append((i, n))
    drop = defaultdict(set)
    for places in templates.values():
        if len({i for i, _ in places}) >= min_docs:
            first = min(places, key=lambda x: (rows[x[0]][0] is not None, rows[x[0]][0] or 0, x[1]))
            for i, n in places:
                if (i, n) != first:
                    drop[i].add(n)
    return drop


def corpus(seed):
    r = random.Random(seed)
    words = "the of and to in is on by at from".split()
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randrange(0, 9)):
            kind = r.random()
            if kind < 0.25:
                lines.append(f"User {r.choice(['ann', 'bob', 'cy' + 'x' * r.randrange(30)])} logged in from the office at {r.randrange(99)}")
            elif kind < 0.4:
                lines.append("All rights reserved.  " + r.choice(["", " "]))
            elif kind < 0.5:
                lines.append(r.choice(["", " ", "ok", "a b", "\t", "12 34 56", f"{r.randrange(99)} {r.randrange(99)} 7", "1 2 of 3"]))
            else:
                lines.append(" ".join(r.choice(words) for _ in range(r.randrange(1, 8))))
        rows.append((i, "\n".join(lines)))
    return rows + [(80, None), (81, ""), (None, "All rights reserved."), (82, "\n".join(["All rights reserved."] * 3))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(documents, seed):
    rows = corpus(seed)
    drop = brute(rows)
    assert drop
    got = line_dedup(documents(rows), counts=True)
    expected = []
    for i, (doc, text) in enumerate(rows):
        lines = text.split("\n") if text is not None else []
        expected.append((doc, len(lines), len(drop[i]), None if text is None else
                         "\n".join(x for n, x in enumerate(lines) if n not in drop[i])))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_variable_fields_and_clean_documents(documents):
    rows = [(i, f"unique line {'q' * i} of words\nPage {i} of 20 printed here by the user u{i}\nown text number{i} here alone") for i in range(30)]
    rows.append((99, "a clean text\nwith its own lines\n\nof words"))
    got = {r.doc_id: r for r in line_dedup(documents(rows), counts=True).collect()}
    assert got[99].text == rows[-1][1] and got[99].n_dropped == 0
    assert "Page 0 of 20" in got[0].text  # the first of a template stays
    assert all("Page" not in got[i].text for i in range(1, 30))
    assert all(f"unique line {'q' * i} of words" in got[i].text for i in range(2, 30))


def test_keeps_columns_and_drops_emptied(spark, documents):
    rows = [(i, "This boilerplate line is everywhere") for i in range(12)] + [(50, ""), (51, None), (52, "x\ny"), (53, "This boilerplate line is everywhere\n ")]
    df = documents(rows).selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 as line", "2 as mark", "3 as _text_", "4 as leaf")
    got = line_dedup(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.line, r.mark, r.leaf) for r in got.collect() if r.doc_id != 51) == [
        (0, rows[0][1], 1, 2, 4), (50, "", 1, 2, 4), (52, "x\ny", 1, 2, 4)]
    assert got.where("doc_id = 51").first().text is None


def test_empty_table_long_line_and_repeated_rows(documents):
    assert line_dedup(documents([]), counts=True).collect() == []
    long = " ".join(f"w{'x' * (i % 7)}" for i in range(100_000))
    rows = [(1, long), (1, long), (2, "a b c d")] + [(10 + i, "the same line again") for i in range(10)] + [(19, "the same line again")]
    got = sorted(map(tuple, line_dedup(documents(rows), counts=True).collect()), key=str)
    assert [r[:3] for r in got if r[0] < 10] == [(1, 1, 0), (1, 1, 0), (2, 1, 0)]
    assert sorted((r[0], r[2]) for r in got if r[0] >= 10) == [(10, 0)] + [(10 + i, 1) for i in range(1, 10)] + [(19, 1)]


def query(spark, documents, tmp_path, rows):
    """``{doc_id: text}`` of the registered query."""
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r.text for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}


def test_number_rows_stay_and_equal_ones_go(spark, documents, tmp_path):
    numbers = [(i, f"{i} {100 + i} {200 + i}\n2019-01-{i} {i} 45% {i}.5 of {i}") for i in range(10, 25)]  # one masked line a leaf
    equal = [(i, "12 34 56\n12 34 56") for i in range(50, 62)]
    few = [(i, "9 9 9\n9 9 9") for i in range(70, 79)]
    mixed = [(100 + i, f"7 8 9 {i} plus") for i in range(15)] + [(i, "1 2 3 4 equal") for i in range(150, 162)]
    rows = numbers + equal + few + mixed
    gone = {i: "" for i in [*range(51, 62), *range(151, 162)]}
    assert query(spark, documents, tmp_path, rows) == dict(rows) | {50: "12 34 56"} | gone


def test_sql_follows_the_same_rule(spark, documents, tmp_path):
    """Number rows, short lines and templates, in leaves of one masked line and of several, by the query and by its SQL."""
    rows = [(i, t) for i, t in corpus(7) if i is not None]
    rows += [(100 + i, f"{i} {10 + i} {20 + i}\nLes.\n12 34 56\nOf. it\nown {'q' * i} text") for i in range(14)]
    rows += [(200 + i, f"7 8 9 {i} plus\n1 2 3 4 equal\nPage {i} of the whole book") for i in range(12)]
    got = query(spark, documents, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {d: t for d, _, _, t in con.execute(ORACLE).fetchall()}
    assert got[105] == f"5 15 25\nown {'q' * 5} text" and got[205] == "7 8 9 5 plus"


def test_short_recurring_lines_go(documents):
    rows = [(i, f"Les.\n{i}\nown {'q' * i} text {'r' * i} here\nAnd ornd.\n12 34") for i in range(1, 13)] + [(50, "few\nof it"), (51, "few\nof it")]
    got = {r.doc_id: r.text for r in line_dedup(documents(rows)).collect()}
    assert got == dict(rows) | {i: f"{i}\nown {'q' * i} text {'r' * i} here" for i in range(2, 13)}
