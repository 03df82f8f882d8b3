r"""Operator 2: line dedup by a log-template tree.

A line's tokens (words without white space) with a digit in them are variable. The tree has a fixed
depth: a line goes to the node of its token count, then down its ``DEPTH`` leading tokens (variable
ones as one wild card) to a *leaf*. Lines of a leaf are generalised position by position: a token that
``min_docs`` documents share at a position of the leaf is constant there, every other is a variable
field. Lines with the same constants are one *template*, provided that at least ``similarity`` of
their tokens are constant. A template found in ``min_docs`` documents or more recurs: its lines are
dropped from all documents, except its first line (by ``doc_id`` and line number).

The tree is the key of a shuffle, not a structure in memory. Lines are reduced to hashes and equal
lines to one row with its count before anything is shuffled by leaf, so a line that a third of the
documents share is a row from each task. Only leaves that ``min_docs`` documents reach and that hold several different
lines have their tokens compared. Constants are counts per (leaf, position, token), which combine in
each task; there is no clustering inside a leaf and no leaf is ever gathered in one place. Aggregates that go back to
lines by a join are written first, so that adaptive execution can split a hot key of the join.

Lines with more variable tokens than the similarity rule allows, such as rows of numbers, can't belong to a template with
variable fields: of these only lines equal token by token, variable ones unmasked, are one template. (Any other line that recurs word for
word is covered by the first rule: all its tokens without a digit are constant then.)

Defined results: lines are split at ``\n``; blank lines, lines of fewer than ``min_tokens`` tokens (by default there are none) and the
order of lines stay as they are. A null text stays null, with no lines. Repeated rows (same ``doc_id`` and
text) are treated alike and are one of a template's documents; rows with a null ``doc_id`` come before all others. Other
columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.llm.ship import ship
from regiopanel.llm.words import column, find_lines, find_words, mix, pieces, rolling_spans, rolling_sums, span_hashes, text_bytes
from regiopanel.session import materialize

PIECE = 1 << 20
#: Leading tokens that lead to a leaf, documents that make a token constant and a template recurring, the
#: share of constant tokens that a template needs, and tokens below which a line is no template.
DEPTH, MIN_DOCS, SIMILARITY, MIN_TOKENS = 3, 10, 0.7, 1
#: The hash of a variable token.
WILD = np.uint64(0x2A2A2A2A2A2A2A2A)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class _Lines:
    """Per line of a piece: its text, number, token range, leaf, hash and hash of the unmasked tokens (``exact``), and
    whether ``similarity`` of its tokens can be constant (``alike``); lines shorter than ``least`` are left out."""

    def __init__(self, texts: pa.Array, depth: int, least: int, similarity: float = SIMILARITY):
        data, off = text_bytes(texts)
        words, lines = find_words(data, off), find_lines(data, off)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
        variable, plain = digits[words.ends] > digits[words.starts], span_hashes(data, words.starts, words.ends)
        self.tokens = np.where(variable, WILD, plain)
        first = np.searchsorted(words.starts, lines.starts)
        last = np.searchsorted(words.starts, lines.ends)
        keep = np.flatnonzero(last - first >= least)
        count = np.diff(lines.first)
        self.first, self.last = first[keep], last[keep]
        self.text = np.repeat(np.arange(len(count)), count)[keep]
        self.number = (np.arange(lines.first[-1]) - np.repeat(lines.first[:-1], count))[keep]
        n = (self.last - self.first).astype(np.uint64)
        self.hash, self.exact = self._hashes(self.tokens), self._hashes(plain)
        fields = np.concatenate([[0], np.cumsum(variable, dtype=np.int64)])
        count = self.last - self.first
        self.alike = count - (fields[self.last] - fields[self.first]) >= similarity * count
        self.leaf = mix(n)
        for d in range(depth):
            there = self.first + d < self.last
            token = self.tokens[np.where(there, self.first + d, 0)] if len(self.tokens) else self.leaf
            self.leaf = mix(self.leaf * np.uint64(0x9FB21C651E98DF25) + np.where(there, token, np.uint64(d)))

    def _hashes(self, tokens: np.ndarray) -> np.ndarray:
        return rolling_spans(rolling_sums(tokens), self.first, self.last)

    def once(self, what: np.ndarray) -> np.ndarray:
        """Whether a line is the first of its text with this value."""
        order = np.lexsort((np.arange(len(what)), what, self.text))
        again = np.zeros(len(what), bool)
        again[order[1:]] = (self.text[order][1:] == self.text[order][:-1]) & (what[order][1:] == what[order][:-1])
        return ~again


def _scan(docs: DataFrame, kind: str, depth: int, least: int, similarity: float) -> DataFrame:
    """One row per line. ``exact`` is null where the line can belong to a template with variable fields."""
    names = ["doc_id", "mark", "line", "leaf", "hash", "exact", "new_leaf", "new_hash", "new_exact"]

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            got = _Lines(column(batch, "text"), depth, least, similarity)
            at = pa.array(got.text, pa.int64())
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id").take(at), column(batch, "mark").take(at), pa.array(got.number, pa.int32()),
                pa.array(got.leaf.view(np.int64)), pa.array(got.hash.view(np.int64)),
                pa.array(got.exact.view(np.int64), mask=got.alike),
                pa.array(got.once(got.leaf)), pa.array(got.once(got.hash)), pa.array(got.once(got.exact))], names)

    return docs.mapInArrow(run, f"doc_id {kind}, mark long, line int, leaf long, hash long, exact long, new_leaf boolean, "
                                "new_hash boolean, new_exact boolean")


def _tokens(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """``hash, tokens`` of the lines whose numbers ``docs`` has in ``wanted``."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            got = _Lines(column(batch, "text"), depth, least)
            wanted = column(batch, "wanted")
            keys = np.concatenate([w.values.to_numpy() + (i << 32) for i, w in enumerate(wanted)]) if len(wanted) else np.zeros(0, np.int64)
            keep = np.flatnonzero(np.isin(got.text.astype(np.int64) << 32 | got.number, keys))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum((got.last - got.first)[keep])]), pa.int32()),
                pa.array(np.concatenate([got.tokens[a:b] for a, b in zip(got.first[keep], got.last[keep])]).view(np.int64)
                         if len(keep) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(got.hash[keep].view(np.int64)), lists], ["hash", "tokens"])

    return docs.mapInArrow(run, "hash long, tokens array<long>")


def _without(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with the lines numbered in ``_drop`` taken out of ``_text``; texts that lose none aren't split for it."""
    parts, some = F.split("_text", "\n", -1), F.col("_drop").isNotNull()
    df = df.withColumn("_parts", F.when(some, parts))
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_parts").cast("long") - 1), F.col("_drop"))
    worded = F.size(F.filter("_parts", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    text = F.array_join(F.transform(stay, lambda i: F.col("_parts")[i.cast("int")]), "\n")
    return df.select("*", F.when(some, text).otherwise(F.col("_text")).alias("_left"),
                     F.when(some, F.size("_drop")).otherwise(0).cast("long").alias("_dropped"), F.when(some, worded).alias("_worded"))


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS,
                    similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``doc_id, mark, lines``: the numbers of the lines to drop from the documents that have some.

    ``mark`` is ``xxhash64`` of the text, so that rows sharing a ``doc_id`` keep apart.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    lines = materialize(_scan(docs, kind, depth, max(1, min_tokens), similarity), "lines")

    distinct = lines.groupBy("leaf", "hash").agg(
        F.sum(F.col("new_leaf").cast("long")).alias("leaf_docs"), F.sum(F.col("new_hash").cast("long")).alias("docs"),
        F.min(F.struct("doc_id", "mark", "line")).alias("at"), F.first(F.col("exact").isNull()).alias("alike"))
    distinct = materialize(distinct, "distinct-lines")
    leaves = materialize(distinct.groupBy("leaf").agg(F.sum("leaf_docs").alias("n"), F.count("*").alias("kinds"))
                         .where(F.col("n") >= min_docs), "leaves")
    lone = distinct.where("alike").join(leaves.where("kinds = 1"), "leaf").select("leaf", "hash", F.col("hash").alias("template"))

    several = materialize(distinct.join(leaves.where("kinds > 1"), "leaf").select("leaf", "hash", "docs", "at"), "mixed-leaves")
    wanted = several.groupBy(F.col("at.doc_id").alias("id"), F.col("at.mark").alias("m")).agg(
        F.collect_set(F.col("at.line").cast("long")).alias("wanted"))
    # Both sides grow with the data, here and in ``line_dedup``: always a join by shuffle.
    texts = docs.join(wanted.hint("merge"), docs.doc_id.eqNullSafe(wanted.id) & (docs.mark == wanted.m)).select("text", "wanted")
    token = several.join(_tokens(texts, depth, max(1, min_tokens)).dropDuplicates(["hash"]), "hash")
    token = materialize(token.select("leaf", "hash", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token")), "line-tokens")
    constant = materialize(token.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("support")).where(
        (F.col("support") >= min_docs) & (F.col("token") != int(WILD))).drop("support"), "constants")
    general = token.join(constant, ["leaf", "pos", "token"]).groupBy("leaf", "hash", "n").agg(
        F.count("*").alias("constants"), F.bit_xor(F.xxhash64("pos", "token")).alias("template"))
    general = general.where(F.col("constants") >= similarity * F.col("n")).select("leaf", "hash", "template")

    template = materialize(lone.unionByName(general), "templates")
    found = materialize(lines.join(template, ["leaf", "hash"]).select("doc_id", "mark", "line", "leaf", "template"), "template-lines")
    rest = lines.where("exact is not null")  # none of these is in ``found``
    equal = rest.groupBy("leaf", "exact").agg(F.sum(F.col("new_exact").cast("long")).alias("n")).where(F.col("n") >= min_docs)
    equal = materialize(equal.drop("n"), "equal-lines")
    found = found.unionByName(rest.join(equal, ["leaf", "exact"]).select("doc_id", "mark", "line", "leaf", F.col("exact").alias("template")))
    recurs = found.groupBy("leaf", "template", "doc_id", "mark").agg(F.min("line").alias("line")).groupBy("leaf", "template").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "line")).alias("first")).where(F.col("n") >= min_docs)
    recurs = materialize(recurs, "recurring")
    drop = found.join(recurs, ["leaf", "template"]).where(~F.struct("doc_id", "mark", "line").eqNullSafe(F.col("first")))
    return drop.groupBy("doc_id", "mark").agg(F.collect_set(F.col("line").cast("long")).alias("lines"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """``df`` with recurring lines taken out of its texts.

    With ``counts``, only ``doc_id, n_lines, n_dropped, text``; otherwise the rows and columns of ``df``,
    without documents that had lines with a word and lost all of them.
    """
    drops = recurring_lines(df, id_col, text_col, **options)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("_rest"),
                     F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_mark"))
    drops = drops.select(F.col("doc_id").alias("_i"), F.col("mark").alias("_m"), F.col("lines").alias("_drop"))
    rows = rows.join(drops.hint("merge"), rows._id.eqNullSafe(drops._i) & (rows._mark == drops._m), "left").select("_rest", "_id", "_text", "_drop")
    out = _without(rows)
    if counts:
        lines = F.when(F.col("_text").isNull(), 0).otherwise(F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1)
        return out.select(F.col("_id").alias("doc_id"), lines.cast("long").alias("n_lines"),
                          F.col("_dropped").alias("n_dropped"), F.col("_left").alias("text"))
    out = out.where("_dropped = 0 or _dropped < _worded")
    return out.select(*[F.col("_left").alias(text_col) if c == text_col else F.col(f"_rest.`{c}`") for c in df.columns])


#: The same in DuckDB SQL over the table ``documents``, on the tokens themselves (ids are unique there).
ORACLE = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs),
lines AS (
  SELECT doc_id, line, raw, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END) AS w
  FROM (SELECT doc_id, i - 1 AS line, regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+') AS raw FROM numbered)),
kept AS (SELECT *, len(w) AS n, CAST(len(w) AS VARCHAR) || ' ' || array_to_string(w[1:3], ' ') AS leaf, array_to_string(w, ' ') AS masked,
                array_to_string(raw, ' ') AS exact, len(list_filter(w, lambda x: x <> chr(1))) >= CAST(0.7 AS DOUBLE) * len(w) AS alike
         FROM lines WHERE len(w) >= 1),
leaves AS (SELECT leaf, count(DISTINCT doc_id) AS docs, count(DISTINCT masked) AS kinds FROM kept GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
lone AS (SELECT doc_id, line, leaf, masked AS template FROM kept JOIN leaves USING (leaf) WHERE kinds = 1 AND alike),
kinds AS (SELECT leaf, masked, any_value(w) AS w, any_value(n) AS n, count(DISTINCT doc_id) AS d
          FROM kept JOIN leaves USING (leaf) WHERE kinds > 1 GROUP BY leaf, masked),
tokens AS (SELECT leaf, masked, n, d, pos, w[pos] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM kinds)),
constants AS (SELECT leaf, pos, token FROM tokens WHERE token <> chr(1) GROUP BY leaf, pos, token HAVING sum(d) >= 10),
general AS (
  SELECT leaf, masked, string_agg(CAST(pos AS VARCHAR) || ':' || token, ' ' ORDER BY pos) AS template
  FROM tokens JOIN constants USING (leaf, pos, token) GROUP BY leaf, masked, n HAVING count(*) >= CAST(0.7 AS DOUBLE) * n),
found AS (
  SELECT doc_id, line, leaf, template FROM lone
  UNION ALL
  SELECT doc_id, line, leaf, template FROM kept JOIN general USING (leaf, masked)
  UNION ALL
  SELECT doc_id, line, leaf, '=' || exact FROM kept WHERE NOT alike),
recurs AS (
  SELECT leaf, template, min(doc_id) AS d FROM found GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 10),
firsts AS (SELECT f.leaf, f.template, f.doc_id, min(f.line) AS line FROM found f JOIN recurs r ON f.leaf = r.leaf AND f.template = r.template AND f.doc_id = r.d GROUP BY 1, 2, 3),
gone AS (
  SELECT f.doc_id, list(f.line) AS drops FROM found f JOIN firsts x ON f.leaf = x.leaf AND f.template = x.template
  WHERE NOT (f.doc_id = x.doc_id AND f.line = x.line) GROUP BY f.doc_id)
SELECT docs.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(drops), 0) AS BIGINT) AS n_dropped,
       CASE WHEN drops IS NULL THEN text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(drops, i - 1)), lambda i: parts[i]), chr(10)), '') END AS text
FROM docs LEFT JOIN gone ON docs.doc_id = gone.doc_id
"""
