"""Operator 10: n-gram Jaccard join with rare-first prefix filtering.

A document is the set of hashes of its distinct 5-word shingles (words lower-cased A-Z; a shorter text
is one shingle). Two documents link when ``100 * |intersection| >= 80 * |union|``.

1. One pass over the texts gives each document's set size and a 128-bit key of its set; documents of
   equal sets form a *class* and go on as one. The same pass counts, for a fixed number of buckets
   of shingle hashes, the documents that hold them: a few MB at any corpus size. Shingles are put in
   one global order, rare buckets first, ties by hash.
2. A second pass gives each class its *prefix*, the ``n - ceil(0.8 n) + 1`` first shingles in that order.
   Linked classes share a shingle of both prefixes, so candidates come from a shuffle on prefix
   shingles only. Frequent ones (which the order puts last) are salted.
3. Candidates must pass the length filter, the positional filter (what can still follow the shared
   shingle) and the suffix filter (parities of the sets, as many as they have shingles: their Hamming distance bounds the
   symmetric difference from below). Each pair that passes is verified once on whole sets.
4. A class of a large group shares shingles with all others of it, so pairs are not all listed. *Star* rounds
   first link the holders of a shingle to one leader; components follow, and other leaders for
   shingles whose holders are in different components. Then only pairs of
   different components that share a prefix shingle and aren't its leader are still open; all of those that
   pass the filters are verified. No link between different components is lost, so components are exact.

An aggregate that goes back to its rows by a join is written first: the join then has a shuffle of its own on both
sides, and adaptive execution can split a hot shingle.

Everything that grows with the data is shuffled or written to the shared folder. The driver gets the
bucket counts (``2**BUCKETS`` bytes) and checksums.

Defined results: null, empty and blank texts have no shingles and link with nothing. Rows that share a
``doc_id`` are one document that links where any of its texts does; repeated rows come back each. A
row with a null ``doc_id`` links with nothing and has a null component. Extra columns are ignored. An empty
table gives an empty result. Ids are integers or text; others are refused with a ``ValueError``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.llm.components import components
from regiopanel.llm.ship import ship
from regiopanel.llm.words import (column, find_words, lower_ascii, mix, pieces, shingle_hashes, span_hashes,
                                  text_bytes)
from regiopanel.session import materialize

PIECE = 1 << 20
SHINGLE = 5
#: A pair links if its intersection is at least this percentage of its union.
PERCENT = 80
#: log2 of the number of frequency buckets, the ranges in which their counts travel, and parts in which tasks' counts are first added.
BUCKETS, RANGES, GATHER = 21, 32, 64
#: Shingles whose bucket holds at least so many documents more than the median bucket are salted so many ways.
HOT, SALTS = 2048, 128
#: Star rounds at most, after the first, before the remaining pairs are listed; a round is held while the squared
#: numbers of holders of open shingles are more than ``DENSE`` times the numbers. Neither changes the result.
ROUNDS, DENSE = 1, 4


#: Kinds of ids; others are refused.
ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
#: Parities of a set at least; a larger set has as many as the next power of two above its size.
PARITIES = 512


def _parities(spread: np.ndarray) -> np.ndarray:
    """Of how many shingles' hashes fall on each of ``PARITIES`` or more places, whether the number is odd."""
    width = max(PARITIES, 1 << (len(spread) - 1).bit_length())
    bits = np.bincount((spread & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = text_bytes(texts)
    data = lower_ascii(data)
    words = find_words(data, off)
    hashes, at = shingle_hashes(span_hashes(data, words.starts, words.ends), words.first, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        s = np.sort(hashes[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b - a > 1 else s)
    return out


def _key(shingles: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(shingles.tobytes())
    return tuple(np.frombuffer(raw, np.int64).tolist())


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64), kind))


def _scan(docs: DataFrame, kind: str, size: int) -> DataFrame:
    """A row for each document (set size and key), and each task's bucket counts, a row for each range."""
    shift = np.uint64(64 - BUCKETS)
    schema = pa.schema([("doc_id", ID_TYPES[kind]), ("n", pa.int64()),
                        ("c1", pa.int64()), ("c2", pa.int64()), ("range", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(1 << BUCKETS, np.int32)
        for batch in pieces(batches, "text", PIECE):
            sets = _sets(column(batch, "text"), size)
            keys = [_key(s) for s in sets]
            if sets:
                total += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=1 << BUCKETS).astype(np.int32)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if total.any():
            blocks = [_packed(part) for part in np.split(total, RANGES)]
            none = pa.nulls(RANGES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(RANGES, schema.field(0).type), none, none, none, pa.array(range(RANGES), pa.int32()),
                                              pa.array(blocks, pa.binary())], schema=schema)

    return docs.mapInArrow(run, f"doc_id {kind}, n long, c1 long, c2 long, range int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(counts.astype(np.int64).tobytes(), asbytes=True)


def _frequency_levels(scan: DataFrame) -> tuple[bytes, int]:
    """A byte for each bucket, larger for more documents, and the level from which a bucket is hot.

    The tasks' counts are added in two steps, first among ``GATHER`` parts of the tasks, then for each range.
    """
    each = (1 << BUCKETS) // RANGES
    unpack = lambda block: np.frombuffer(pa.Codec("zstd").decompress(block, each * 8), np.int64)

    def add(batches):
        sums = {}
        for batch in batches:
            for r, block in zip(column(batch, "range").to_pylist(), column(batch, "counts")):
                sums[r] = sums.get(r, 0) + unpack(block.as_buffer())
        for r, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_packed(s)], pa.binary())], ["range", "counts"])

    kind = "range int, counts binary"
    rows = scan.where("range is not null").select("range", "counts", F.pmod(F.spark_partition_id(), F.lit(GATHER)).alias("part"))
    rows = rows.repartition("range", "part").select("range", "counts").mapInArrow(add, kind)
    rows = rows.repartition(RANGES, "range").mapInArrow(add, kind).collect()
    counts = np.zeros(1 << BUCKETS, np.int64)
    for r in rows:
        counts[r["range"] * each:(r["range"] + 1) * each] = unpack(bytes(r["counts"]))
    level = lambda c: np.minimum(255, np.floor(8 * np.log2(1 + c))).astype(np.uint8)
    return level(counts).tobytes(), int(level(np.array([np.median(counts) + HOT]))[0])


def prefix_length(n, percent: int = PERCENT):
    """Shingles of which linked sets of size ``n`` (at least) share one: ``n - ceil(n * percent / 100) + 1``."""
    return n - (n * percent + 99) // 100 + 1


def _signatures(docs: DataFrame, kind: str, size: int, percent: int, levels) -> DataFrame:
    """``doc_id, c1, c2, n, prefix, cold, parity`` of each document with shingles: the prefix in global order, its
    number of shingles that aren't hot, and parities of the whole set."""
    shift, byte = np.uint64(64 - BUCKETS), np.uint64(56)

    def run(batches):
        table, hot = levels.value
        table = np.frombuffer(table, np.uint8)
        for batch in pieces(batches, "text", PIECE):
            ids, keep, n, c1, c2, prefixes, cold, parity = column(batch, "doc_id"), [], [], [], [], [], [], []
            for i, s in enumerate(_sets(column(batch, "text"), size)):
                if not len(s):
                    continue
                level = table[(s >> shift).astype(np.int64)]
                spread = mix(s)
                order = (level.astype(np.uint64) << byte) | (spread >> np.uint64(8))
                p = prefix_length(len(s), percent)
                at = np.argpartition(order, p - 1)[:p]
                at = at[np.argsort(order[at])]
                keep.append(i)
                n.append(len(s))
                key = _key(s)
                c1.append(key[0])
                c2.append(key[1])
                prefixes.append(s[at])
                cold.append(int((level[at] < hot).sum()))
                parity.append(_parities(spread))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(keep, pa.int64())), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()),
                _lists(prefixes, pa.int64()), pa.array(cold, pa.int32()), _lists(parity, pa.int64())],
                ["doc_id", "c1", "c2", "n", "prefix", "cold", "parity"])

    return docs.mapInArrow(run, f"doc_id {kind}, c1 long, c2 long, n long, prefix array<long>, cold int, parity array<long>")


def _length(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _enough(overlap, total, percent: int):
    """An overlap of two sets of ``total`` elements together suffices."""
    return (100 + percent) * overlap >= percent * total


def _beside_leaders(posting: DataFrame) -> DataFrame:
    """The postings without the leader of a shingle's holders; salted shingles have several, and keep them all."""
    return posting.where((F.col("salt") > 0) | (F.struct("rep", "n", "pos") != F.col("lead")))


def _suffix(percent: int):
    """By the parities ``pa`` and ``pb``: at least the Hamming distance of elements is in one set only."""
    # Sets that pass the length filter differ by a factor of two at most in their numbers of parities: of the longer list, the parities
    # of both halves together are those of half as many places.
    half = lambda a, b: F.when(F.size(a) > F.size(b), F.zip_with(
        F.slice(a, 1, F.size(b)), F.slice(a, F.size(b) + 1, F.size(b)), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(a))
    differ = F.zip_with(half("pa", "pb"), half("pb", "pa"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    total = F.col("na") + F.col("nb")
    return (100 + percent) * (total - apart) >= 2 * percent * total


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(
        _enough(common, F.size("sa") + F.size("sb"), percent)).select("a", "b").distinct()


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``df``."""
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[id_col]
    if kind not in ID_TYPES:
        raise ValueError(f"ids must be integers or text, not {kind}")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scan = materialize(_scan(docs, kind, size), "jaccard-scan")
    levels = spark.sparkContext.broadcast(_frequency_levels(scan))
    members = scan.where("range is null").select("doc_id", "n", "c1", "c2")

    some = docs.where("doc_id is not null")
    classes = materialize(_signatures(some, kind, size, percent, levels).groupBy("c1", "c2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
        F.first("cold").alias("cold"), F.first("parity").alias("parity")), "jaccard-classes")
    of_class = classes.select("c1", "c2", "rep")

    # Prefix shingles that two classes hold, each with the leader (smallest class) of its holders.
    posting = classes.select("rep", "n", "cold", F.posexplode("prefix").alias("pos", "token")).select(
        "token", F.when(F.col("pos") < F.col("cold"), 0).otherwise(1 + F.pmod(F.xxhash64("rep"), F.lit(SALTS))).cast("int").alias("salt"),
        "rep", "n", "pos")
    holders = Window.partitionBy("token", "salt").orderBy("rep", "n", "pos")
    posting = posting.select("*", F.first(F.struct("rep", "n", "pos")).over(holders).alias("lead"),
                             F.lead("rep").over(holders).alias("next"))
    posting = materialize(posting.where("salt > 0 or next is not null or lead.rep != rep").select(
        "token", "salt", "rep", "n", "pos", "lead"), "jaccard-postings")

    def star(of: DataFrame) -> DataFrame:
        """Pairs of a holder and its leader that pass length and position; the shared shingle need not be their first."""
        total, rest = F.col("n") + F.col("lead.n"), F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos"))
        return of.where(_length("n", "lead.n", percent) & (F.col("lead.rep") != F.col("rep")) &
                        _enough(rest + F.least("pos", "lead.pos"), total, percent)).select(
            F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()

    def plausible(pairs: DataFrame) -> DataFrame:
        side = classes.select("rep", "n", "parity")
        return pairs.join(side.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a").join(
            side.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b").where(
            _suffix(percent)).select("a", "b").distinct()

    hot = posting.where("salt > 0 and lead.rep = rep")  # the leaders of a salted shingle have a leader again
    top = materialize(hot.groupBy("token").agg(F.min(F.struct("rep", "n", "pos")).alias("lead")), "jaccard-leaders")
    pairs = materialize(plausible(star(posting).unionByName(star(hot.drop("lead").join(top, "token"))).distinct()), "jaccard-stars")

    def whole_sets(of: DataFrame, name: str) -> DataFrame:
        wanted = of.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

        def run(batches):
            for batch in pieces(batches, "text", PIECE):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), _lists(_sets(column(batch, "text"), size), pa.int64())],
                                                 ["doc_id", "shingles"])

        return materialize(some.join(wanted, "doc_id", "left_semi").mapInArrow(run, f"doc_id {kind}, shingles array<long>"), name)

    sets = whole_sets(pairs, "jaccard-sets")
    by_id = members.where("doc_id is not null and n > 0").join(of_class, ["c1", "c2"]).select("doc_id", "rep")
    texts = by_id.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b != hi")
    same = by_id.join(texts, "doc_id").select(F.col("rep").alias("a"), "b")  # texts of one document
    links = materialize(_verified(pairs, sets, percent).unionByName(same), "jaccard-links")
    label = components(links)

    def open_postings(of: DataFrame) -> DataFrame:
        """Those of the postings whose shingle's holders are in different components."""
        named = of.select("token", "rep", "n", "pos").join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
            "token", "rep", "n", "pos", F.coalesce("component", "rep").alias("component"))
        split = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        return named.join(materialize(split.select("token"), "jaccard-split"), "token", "left_semi")

    def merged(more: DataFrame) -> DataFrame:
        return components(label.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                          .unionByName(materialize(more, "jaccard-links")))

    # Every holder has been tried with its leader, so what is open is between the others: nothing where two classes share a shingle.
    still = _beside_leaders(posting)
    for again in range(rounds + 1):
        still = materialize(open_postings(still), "jaccard-open")  # a shingle that is settled stays so
        n, pairs_at_most = still.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if again == rounds or not n or pairs_at_most <= DENSE * n:
            break
        # Leaders for holders of about one size; the bounds of the sizes move from round to round.
        sized = still.withColumn("size", F.floor(F.log("n") / math.log(100 / percent) + 0.5 * again))
        top = materialize(sized.groupBy("token", "size").agg(
            F.min_by(F.struct("rep", "n", "pos", "component"), F.xxhash64("rep", F.lit(again))).alias("lead")), "jaccard-leaders")
        stars = plausible(star(sized.join(top, ["token", "size"]).where("component != lead.component")).join(pairs, ["a", "b"], "left_anti"))
        stars = materialize(stars, "jaccard-stars")
        pairs = pairs.unionByName(stars)
        label = merged(_verified(stars, whole_sets(stars, "jaccard-sets"), percent))

    side = classes.select("rep", F.col("parity"), F.col("n").alias("whole"))
    wide = still.join(side, (side.rep == still.rep) & (side.whole == still.n)).select(
        "token", still.rep, "n", "pos", "component", "parity")
    a = wide.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("at"),
                    F.col("component").alias("ca"), F.col("parity").alias("pa"))
    b = wide.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("bt"),
                    F.col("component").alias("cb"), F.col("parity").alias("pb"))
    rest = F.least(F.col("na") - F.col("at"), F.col("nb") - F.col("bt"))  # the first shared shingle passes this
    cross = a.join(b, "token").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _length("na", "nb", percent) &
                                     _enough(rest, F.col("na") + F.col("nb"), percent) & _suffix(percent)).select("a", "b").distinct()
    cross = materialize(cross.join(pairs, ["a", "b"], "left_anti"), "jaccard-cross")
    label = merged(_verified(cross, whole_sets(cross, "jaccard-sets"), percent))

    found = of_class.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = members.where("doc_id is not null and n > 0").join(found, ["c1", "c2"]).select("doc_id", "n", "component")
    return out.unionByName(members.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same in DuckDB SQL over the table ``documents``: all pairs that share a shingle, then all nodes that links reach.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT reach.node, steps.b FROM reach JOIN steps ON reach.other = steps.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, m AS component_id
FROM sizes JOIN (SELECT node, min(other) AS m FROM reach GROUP BY node) ON doc_id = node
"""
