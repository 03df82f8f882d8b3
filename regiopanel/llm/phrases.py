r"""Operator 11: phrase collocation mining over count streams in prefix and suffix order.

Texts are lower-cased (A-Z) and split at ``[.,;:!?\x0A-\x0D]`` into pieces and those at spaces and tabs into words. Everything is
per language. A phrase is 2 to ``LONGEST`` words that follow each other in a piece; those with at least ``MIN_COUNT`` occurrences are
candidates. A cut after the first k words compares a phrase's count a with those of its left part l and right part r:
floor(2000000 a / (l + r)). The lowest cut counts. A candidate whose count is nearly that of a longer one (80 %) is part of it and goes.

1. Counts. A first pass counts word pairs by a 64-bit hash, combined in each task and shuffled as (hash, count). Pairs that reach
   ``MIN_COUNT`` set their bit in a bitmap (16 bits for each at least, 32 MB at most). A second pass counts words, and those
   phrases all of whose pairs have their bit, as texts. A frequent phrase has frequent pairs only, so it is counted in full; what the bitmap lets through
   besides is dropped by its exact count. Hashes thus decide what is counted, never a count.
2. Streams. Frequent phrases are kept once and read in two orders: by their first words (prefix order) and by their last words
   (suffix order). Each cut is a row that meets its left part in the first stream and its right part in the second; both meetings are sort-merge
   joins, two sorted streams walked in lockstep without hash tables, whose hot keys adaptive execution splits.
3. Extensions. The largest count of a one-word extension to the right is a maximum over prefixes, to the left one over suffixes. It bounds
   that of any longer phrase, since counts fall as phrases grow.

The best ``TOP`` of a language are found in two steps, in shares of a language and then over those, so that no task ranks all of it.

Defined results: a null text has no words; a null ``lang`` is ``und``. Words are any other bytes, also invisible ones. Repeated
rows count each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.llm.ship import ship
from regiopanel.llm.words import (_TABLE, bit_of, bitmap, column, expand, find_words, in_bitmap, lower_ascii, mix, pieces, release,
                                  rolling_spans, rolling_sums, span_texts, text_bytes)
from regiopanel.session import materialize

PIECE = 2 << 20
#: Words of a phrase at most, occurrences of a candidate, phrases of a language that are reported, the percentage of a candidate's
#: occurrences from which a longer one replaces it, and the scale of scores.
LONGEST, MIN_COUNT, TOP, COVERED, SCALE = 4, 30, 2000, 80, 2_000_000
#: log2 of the least and the most bits of the bitmap.
LEAST_BITS, MOST_BITS = 20, 28
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_OTHER = mix(_TABLE) | np.uint64(1)  # a second table of byte values, for hashes of 128 bits


class _Words:
    """The words of a batch, each followed by one space in ``data``, with the number of words that follow it in its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, longest: int):
        raw, off = text_bytes(texts)
        raw = lower_ascii(raw)
        words = find_words(raw, off, _APART)
        size = words.ends - words.starts
        at = expand(words.starts, size + 1)
        self.starts = np.cumsum(size + 1) - size - 1
        self.ends = self.starts + size
        self.data = raw[np.minimum(at, max(len(raw) - 1, 0))] if len(raw) else raw
        self.data[self.ends] = 0x20
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw], dtype=np.int64)])
        text = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
        new = np.ones(len(size), bool)
        new[1:] = (text[1:] != text[:-1]) | (breaks[words.starts[1:]] > breaks[words.ends[:-1]])
        piece = np.flatnonzero(new)
        last = np.repeat(np.append(piece[1:], len(size)), np.diff(np.append(piece, len(size)))) if len(size) else piece
        self.follow = last - np.arange(len(size)) - 1
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64)
        names = [np.frombuffer((x or "").encode(), np.uint8) for x in self.langs.to_pylist()]
        self.salt = np.array([int(rolling_spans(rolling_sums(_TABLE[x]), np.array([0]), np.array([len(x)]))[0]) for x in names], np.uint64)
        self.sums = rolling_sums(_TABLE[self.data])
        self.more = rolling_sums(_OTHER[self.data]) if longest > 2 else None

    def at(self, n: int) -> np.ndarray:
        """The words where a phrase of ``n`` words begins."""
        return np.flatnonzero(self.follow >= n - 1)

    def hashes(self, first: np.ndarray, n: int, other: bool = False) -> np.ndarray:
        """A hash of language and phrase."""
        h = rolling_spans(self.more if other else self.sums, self.starts[first], self.ends[first + n - 1])
        return mix(h + self.salt[self.lang[first]])

    def counted(self, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One beginning for each distinct phrase, and its count. Phrases are told apart by 128 bits of hash."""
        h, more = self.hashes(first, n), self.hashes(first, n, True)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if (same & (more[order][1:] != more[order][:-1])).any():
            order = np.lexsort((more, h))
            same = (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])
        heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else order
        return first[order[heads]], np.diff(np.append(heads, len(order)))


def _prepared(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))


def _frequent_pairs(docs: DataFrame, min_count: int, piece: int) -> DataFrame:
    """``hash`` of the word pairs that occur ``min_count`` times, and of few others at most (equal hashes)."""

    def run(batches):
        for batch in pieces(batches, "text", piece):
            words = _Words(column(batch, "text"), column(batch, "lang"), 2)
            h, n = np.unique(words.hashes(words.at(2), 2), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "f"])
        release()

    pairs = docs.mapInArrow(run, "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f"))
    return pairs.where(F.col("f") >= min_count).select("hash")


def _counts(docs: DataFrame, bits: int, shared, longest: int, piece: int) -> DataFrame:
    """``lang, n, phrase, f`` of all words and of the phrases whose pairs are all in the bitmap."""

    def run(batches):
        for batch in pieces(batches, "text", piece):
            words = _Words(column(batch, "text"), column(batch, "lang"), longest)
            known = np.zeros(len(words.starts), bool)
            pairs = words.at(2)
            known[pairs] = in_bitmap(shared.value, bit_of(words.hashes(pairs, 2), bits))
            first = words.at(1)
            for n in range(1, longest + 1):
                if n > 1:
                    first = first[words.follow[first] >= n - 1]
                    first = first[known[first + n - 2]]
                heads, counts = words.counted(first, n)
                yield pa.RecordBatch.from_arrays([
                    words.langs.take(pa.array(words.lang[heads])), pa.array(np.full(len(heads), n, np.int32)),
                    span_texts(words.data, words.starts[heads], words.ends[heads + n - 1]), pa.array(counts.astype(np.int64))],
                    ["lang", "n", "phrase", "f"])
        release()

    return docs.mapInArrow(run, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT,
                  piece: int = PIECE) -> DataFrame:
    """``lang, n, phrase, f``: all words, and the phrases of 2 to ``longest`` words that may occur ``min_count`` times, with exact counts."""
    docs = _prepared(df, lang_col, text_col)
    pairs = materialize(_frequent_pairs(docs, min_count, piece), "frequent-pairs")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * pairs.count()).bit_length()))
    places = pairs.select(F.shiftrightunsigned("hash", 64 - bits).alias("place"))
    return _counts(docs, bits, df.sparkSession.sparkContext.broadcast(bitmap(places, bits)), longest, piece)


def cuts(grams: DataFrame) -> DataFrame:
    """``lang, phrase, n, a, k, l, r``: each phrase of two words and more with the counts of both parts of each cut."""
    words = F.split("phrase", " ", -1)
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    each = grams.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), words.alias("words"),
                                       F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    each = each.select("lang", "phrase", "n", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                       joined(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    prefix = grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    suffix = grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    return each.join(prefix.hint("merge"), ["lang", "left"]).join(suffix.hint("merge"), ["lang", "right"]).select(
        "lang", "phrase", "n", "a", "k", "l", "r")


def extensions(grams: DataFrame) -> DataFrame:
    """``lang, phrase, e``: the largest count of a phrase that is one word longer, to the right (prefix order) or left (suffix order)."""
    longer = grams.where("n > 2")
    right = longer.select("lang", F.regexp_extract("phrase", "(?s)^(.*) [^ ]*$", 1).alias("phrase"), "f")
    left = longer.select("lang", F.regexp_extract("phrase", "(?s)^[^ ]* (.*)$", 1).alias("phrase"), "f")
    return right.unionByName(left).groupBy("lang", "phrase").agg(F.max("f").alias("e"))


def score_of(a, parts):
    """floor(SCALE * a / parts), exact beyond 64 bits."""
    return F.expr(f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({a} AS DECIMAL(19, 0)) DIV ({parts})")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT,
                 top: int = TOP, covered: int = COVERED, piece: int = PIECE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` collocations of each language (``n``: its words)."""
    counts = materialize(phrase_counts(df, lang_col, text_col, longest, min_count, piece), "phrase-counts")
    total = counts.where("n = 1").groupBy("lang").agg(F.sum("f").alias("total"))
    grams = materialize(counts.where(F.col("f") >= min_count), "frequent-phrases")
    scored = cuts(grams).withColumn("score", score_of("a", "l + r").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    best = best.join(extensions(grams).hint("merge"), ["lang", "phrase"], "left")
    best = best.where(F.col("e").isNull() | (100 * F.col("e") < covered * F.col("cut.a"))).select("lang", "phrase", "cut.*")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    some = best.withColumn("share", share)
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("at") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    some = some.drop("share", "at").withColumn("rank", rank).where(F.col("rank") <= top)
    return some.join(total.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                                         F.col("total").alias("n"), "score")


#: The same in DuckDB SQL over the table ``documents``; a space stands for every run of spaces and tabs.
ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS w FROM docs),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, m AS m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= 30),
cut AS (SELECT lang, phrase, f AS a, m, w, unnest(range(1, m)) AS k FROM often WHERE m > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS score
  FROM cut c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
             JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT o.lang, o.phrase FROM (
    SELECT lang, f, array_to_string(w[i:j], ' ') AS phrase
    FROM (SELECT lang, f, w, m, i, unnest(range(i + 1, m + 1)) AS j FROM (SELECT lang, f, w, m, unnest(range(1, m)) AS i FROM often WHERE m > 2))
    WHERE j - i + 1 < m) s JOIN often o ON o.lang = s.lang AND o.phrase = s.phrase WHERE 100 * s.f >= 80 * o.f),
kept AS (SELECT * FROM lowest ANTI JOIN inside USING (lang, phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
