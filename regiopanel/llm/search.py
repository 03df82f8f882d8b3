r"""Operator 12: ranked lexical search, a hybrid of term-at-a-time and document-at-a-time.

Terms are maximal runs of letters and digits of ASCII and of any other characters beyond it, A-Z lower-cased. A document's score for an item
is the sum over the item's terms of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``, in 64-bit integers.

1. Index. One pass over the documents writes *segments*: the ids and lengths of some documents in a row, and for each term of the items
   the list of those that hold it. Which terms the items have is a bitmap of ``2 ** BITS`` bits; what it lets through besides is no item's term and
   never looked up. Nothing is shuffled. Document counts of terms, and their number and length, are aggregates over the segments.
2. Search. A task holds a block of items (at most about ``BLOCK`` of their terms; a further block is a further pass over the segments) and goes through its
   segments. For an item, the short lists are added up first (term-at-a-time): their sorted sums are one more list, with bounds, as if of
   a single term. Then it and the long lists are walked together by ranges of ``RANGE`` documents (document-at-a-time): a range is
   skipped if the largest sum in it and the long lists' largest entries in it together stay below the k-th best score so far. The k-th largest
   sum of short lists starts that bound, and the best of earlier segments go on to the next.
3. A task gives the best ``k`` of its segments for each item; a window takes the best of all tasks.

Defined results: null texts have no terms. Rows of equal ``doc_id`` are documents of their own; a null id is one too and comes before
others of equal score. Repeated items count once; several texts of an ``item_id`` are one item, with all their terms; items without an id,
without terms or without a match give no rows. Ids of documents are integers (others are refused with a ``ValueError``). Extra columns are
ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.llm.ship import ship
from regiopanel.llm.words import bit_of, bitmap, column, expand, find_words, in_bitmap, lower_ascii, pieces, release, span_hashes, span_texts, text_bytes
from regiopanel.session import materialize, scratch_path

PIECE = 4 << 20
#: Results of an item, log2 of the bitmap's bits, entries of a segment's lists, terms of a block of items, and documents of a range.
TOP, BITS, SEGMENT, BLOCK, RANGE = 10, 24, 1 << 18, 1 << 17, 64
#: Lists of an item are short while they have together at most one entry for so many documents of the segment.
SHORT = 4
#: Fixed values of the score: share of the length in percent, and the scales of tf.
LENGTH, SCALE, TIMES, MORE = 75, 1_000_000_000, 1000, 8

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _terms(texts: pa.Array):
    """Lower-cased bytes and the spans of terms."""
    data, off = text_bytes(texts)
    return lower_ascii(data), find_words(data, off, _APART)


def _counted(data, words, keep):
    """Of the terms at ``keep``: the distinct ones, and the (text, term) pairs with their counts."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[keep]
    coded = span_texts(data, words.starts[keep], words.ends[keep]).dictionary_encode()
    n = max(1, len(coded.dictionary))
    pairs, counts = np.unique(text * n + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return coded.dictionary, pairs // n, pairs % n, counts


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term, hash, times``: the terms of each item with their repeats."""
    kind = dict(items.dtypes)[id_col]
    ship(items.sparkSession)

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            data, words = _terms(column(batch, "text"))
            names, text, term, counts = _counted(data, words, np.arange(len(words.starts)))
            whole, at = text_bytes(names)
            hashes = span_hashes(whole, at[:-1], at[1:])
            yield pa.RecordBatch.from_arrays([column(batch, "item_id").take(pa.array(text)), names.take(pa.array(term)),
                                              pa.array(hashes[term].view(np.int64)), pa.array(counts.astype(np.int64))],
                                             ["item_id", "term", "hash", "times"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").distinct()
    return rows.mapInArrow(run, f"item_id {kind}, term string, hash long, times long").groupBy("item_id", "term", "hash").agg(
        F.sum("times").alias("times"))


def write_index(docs: DataFrame, bits: np.ndarray, out: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT,
                piece: int = PIECE) -> None:
    """Write the segments of the documents, with the lists of the terms in the bitmap."""
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"ids of documents must be integers, not {kind}")
    shared, size = spark.sparkContext.broadcast(bits), int(math.log2(len(bits) * 8))

    def run(batches):
        number: dict[str, int] = {}
        ids, lengths, parts, n_docs, held = [], [], [], 0, 0

        def flush():
            doc, term, tf = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((doc, term))
            at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(number)))])
            row = [pa.concat_arrays(ids).cast(pa.int64()), pa.array(np.concatenate(lengths)), pa.array(list(number), pa.string()),
                   pa.array(np.diff(at)), pa.array(doc[order].astype(np.int32)), pa.array(tf[order].astype(np.int32))]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
            return pa.RecordBatch.from_arrays(one, ["ids", "lengths", "terms", "counts", "docs", "tfs"])

        for batch in pieces(batches, "text", piece):
            data, words = _terms(column(batch, "text"))
            keep = np.flatnonzero(in_bitmap(shared.value, bit_of(span_hashes(data, words.starts, words.ends), size)))
            names, text, term, counts = _counted(data, words, keep)
            each = np.bincount(text, minlength=batch.num_rows)
            first = np.concatenate([[0], np.cumsum(each)])
            names, n = names.to_pylist(), np.diff(words.first)
            start = 0
            while start < batch.num_rows:  # as many documents as the segment still takes
                stop = max(start + 1, int(np.searchsorted(first, first[start] + segment - held, "right")) - 1)
                own = slice(first[start], first[stop])
                used, local = np.unique(term[own], return_inverse=True)
                code = np.array([number.setdefault(names[i], len(number)) for i in used], np.int64)
                parts.append((text[own] - start + n_docs, code[local] if len(code) else local, counts[own]))
                ids.append(column(batch, "doc_id").slice(start, stop - start))
                lengths.append(n[start:stop])
                n_docs, held = n_docs + stop - start, held + int(first[stop] - first[start])
                if held >= segment or n_docs >= segment or stop < batch.num_rows:
                    yield flush()
                    number, ids, lengths, parts, n_docs, held = {}, [], [], [], 0, 0
                start = stop
        if ids:
            yield flush()
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "ids array<long>, lengths array<long>, terms array<string>, counts array<long>, docs array<int>, tfs array<int>")
    rows.write.option("parquet.block.size", 16 << 20).mode("overwrite").parquet(out)


class _Segment:
    """The lists of a segment with their entries of the score."""

    def __init__(self, batch: pa.RecordBatch, i: int, weights: dict[str, tuple[int, int]], size: int, n: int, length: int):
        part = lambda name: column(batch, name)[i].values
        ids = part("ids")
        self.ids, self.null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        m = 100 - LENGTH + (LENGTH * part("lengths").to_numpy() * n) // length
        self.n_docs = len(m)
        self.ranges = -(-self.n_docs // RANGE)
        counts = part("counts").to_numpy()
        known = [weights.get(t) for t in part("terms").to_pylist()]
        use = np.array([k is not None for k in known], bool)
        at = np.cumsum(counts) - counts
        rows = expand(at[use], counts[use])
        self.doc = part("docs").to_numpy()[rows].astype(np.int64)
        tf = part("tfs").to_numpy()[rows].astype(np.int64)
        self.size = counts[use]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        weight = np.array([k[1] for k in known if k is not None], np.int64)
        self.value = np.repeat(weight, self.size) * ((SCALE * tf) // (TIMES * tf + MORE * m[self.doc]))
        self.list_of = np.full(size, -1, np.int64)  # by the number of the term
        self.list_of[[k[0] for k in known if k is not None]] = np.arange(len(self.size))
        # Where each list's entries of each range start, and the largest of them.
        key = np.repeat(np.arange(len(self.size)), self.size) * self.ranges + self.doc // RANGE
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.most = np.zeros(len(self.size) * self.ranges, np.int64)
        if len(key):
            self.most[key[heads]] = np.maximum.reduceat(self.value, heads)
        self.most = self.most.reshape(len(self.size), self.ranges)
        self.begin = np.searchsorted(key, np.arange(len(self.size) * self.ranges + 1))


def _summed(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document once, ascending, with the sum of its values."""
    if not len(doc):
        return doc, value
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[heads], np.add.reduceat(value[order], heads)


class _Best:
    """The k best documents of an item: higher score first, then null ids, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def bound(self) -> int:
        """A document needs at least this score to be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        enough = score >= self.bound
        if enough.any():
            score, null, ids = (np.concatenate(x) for x in ((self.score, score[enough]), (self.null, null[enough]), (self.id, ids[enough])))
            order = np.lexsort((ids, ~null, -score))[:self.k]
            self.score, self.null, self.id = score[order], null[order], ids[order]


def search_segment(seg: _Segment, terms: np.ndarray, times: np.ndarray, best: _Best, seen=None) -> None:
    """Add the segment's documents that are among the best for an item. ``seen`` is told how many entries were read."""
    lists = seg.list_of[terms]
    there = lists >= 0
    lists, times = lists[there], times[there]
    if not len(lists):
        return
    order = np.argsort(seg.size[lists], kind="stable")
    lists, times = lists[order], times[order]
    short = int(np.searchsorted(np.cumsum(seg.size[lists]), seg.n_docs // SHORT, "right"))
    # Term at a time: the short lists become one list of sums.
    rows = expand(seg.at[lists[:short]], seg.size[lists[:short]])
    sum_doc, sum_value = _summed(seg.doc[rows], seg.value[rows] * np.repeat(times[:short], seg.size[lists[:short]]))
    bound = best.bound
    if len(sum_value) >= best.k:  # scores only grow from here
        bound = max(bound, int(np.partition(sum_value, len(sum_value) - best.k)[len(sum_value) - best.k]))
    long, long_times = lists[short:], times[short:]
    upper = (seg.most[long] * long_times[:, None]).sum(axis=0) if len(long) else np.zeros(seg.ranges, np.int64)
    sum_range = sum_doc // RANGE
    if len(sum_doc):
        heads = np.flatnonzero(np.concatenate([[True], sum_range[1:] != sum_range[:-1]]))
        upper[sum_range[heads]] += np.maximum.reduceat(sum_value, heads)
    # Document at a time, by ranges: the most promising few first, which raises the bound, then those that are left above it.
    left = np.flatnonzero(upper >= max(bound, 1))
    left = left[np.argsort(-upper[left], kind="stable")]
    read, step = len(rows), 4
    while len(left):
        now, left, step = np.sort(left[:step]), left[step:], 2 * step
        starts = seg.begin[(long[:, None] * seg.ranges + now).ravel()]
        counts = seg.begin[(long[:, None] * seg.ranges + now + 1).ravel()] - starts
        rows = expand(starts, counts)
        own = np.isin(sum_range, now)
        doc, value = _summed(np.concatenate([sum_doc[own], seg.doc[rows]]), np.concatenate([
            sum_value[own], seg.value[rows] * np.repeat(np.repeat(long_times, len(now)), counts)]))
        best.add(value, seg.null[doc], seg.ids[doc])
        read += len(rows)
        left = left[upper[left] >= max(bound, best.bound)]
    if seen is not None:
        seen(read)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                  segment: int = SEGMENT, piece: int = PIECE, bits: int = BITS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item of ``items`` (``item_id, text``)."""
    spark = docs.sparkSession
    kind, id_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)["item_id"]
    schema = f"item_id {id_kind}, doc_id long, score long"
    terms = materialize(item_terms(items), "search-terms")
    set_bits = bitmap(terms.select(F.shiftrightunsigned("hash", 64 - bits).alias("place")), bits)
    out = scratch_path(spark, "search-index")
    write_index(docs, set_bits, out, id_col, text_col, segment, piece)
    index = spark.read.schema("ids array<long>, lengths array<long>, terms array<string>, counts array<long>, docs array<int>, tfs array<int>").parquet(out)

    size = index.select(F.explode("lengths").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n, length = size["docs"], size["terms"] or 0
    holders = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    wanted = terms.join(holders, "term").select("item_id", "term", "times", weight.alias("w"))
    blocks = max(1, -(-wanted.count() // block)) if n else 0
    wanted = materialize(wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))), "search-weights")

    def search(b: int) -> DataFrame:
        rows = wanted.where(F.col("block") == b).drop("block").orderBy("item_id", "term").toArrow().combine_chunks()
        items_of = rows["item_id"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.int64()).dictionary_encode()
        code = items_of.indices.to_numpy(zero_copy_only=False)
        number: dict[str, tuple[int, int]] = {}
        for t, w in zip(rows["term"].to_pylist(), rows["w"].to_pylist()):
            number.setdefault(t, (len(number), w))
        term = np.array([number[t][0] for t in rows["term"].to_pylist()], np.int64)
        first = np.searchsorted(code, np.arange(len(items_of.dictionary) + 1))
        shared = spark.sparkContext.broadcast((items_of.dictionary, first, term, rows["times"].to_numpy(), number))

        def run(batches):
            names, first, term, times, number = shared.value
            best = [_Best(top) for _ in names]
            for batch in batches:
                for i in range(batch.num_rows):
                    seg = _Segment(batch, i, number, len(number), n, length)
                    for q, found in enumerate(best):
                        own = slice(first[q], first[q + 1])
                        search_segment(seg, term[own], times[own], found)
            counts = [len(x.score) for x in best]
            if sum(counts):
                ids = pa.array(np.concatenate([x.id for x in best]), mask=np.concatenate([x.null for x in best]))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(best)), counts))), ids,
                                                  pa.array(np.concatenate([x.score for x in best]))], ["item_id", "doc_id", "score"])
            release()

        return index.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        found = found.unionByName(search(b))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score")


#: The same in DuckDB SQL over the tables ``documents`` and ``benchmark``.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
size AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
item AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY 1, 2),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
