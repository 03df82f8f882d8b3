"""Operator 6: token ids in files of patched frame-of-reference blocks.

Documents are put in ascending ``doc_id`` order (range partitions, sorted within), encoded with the
tokenizers library, closed with an end id and written as *segments* of whole documents. A segment
holds blocks of ``BLOCK`` ids. A block subtracts its minimum, packs the differences at the width
that the ``PERCENTILE`` of them needs, and keeps the bits above that width of the few larger ones in
an exception list; the segment's index has the byte at which each block starts, and each
document's id and length. Segments are rows of a Parquet table (``part``, ``segment``, index, payload),
so writing and reading go through Spark's file systems and commit protocol: a lost executor's task
is run again and only one attempt's file counts. Reading needs nothing but the files.

Block layout, little-endian: count u32, minimum u32, width u8, exceptions u32, the packed bits (most
significant first, filled to a byte), exception positions u32, the exceptions' bits above the width u32.

Encoding: the library's vocabulary lower-cases and drops white space, and no token crosses it, so each
task hands the library the distinct words of a piece only. Words of ASCII and U+00C0 to U+00FF are
lower-cased and cut into parts beforehand, as the file's normalizer and pre-tokenizer do, and the
library's model encodes the distinct parts; other words, and those that might hold a contraction or a special
token, go through the library's whole pipeline.

Defined results: null, empty and blank texts consist of the end id alone; rows with a null ``doc_id`` come
first; rows of equal ``doc_id`` follow each other in text order; ids are integers or text (others are refused with a ``ValueError``); extra columns are ignored; an empty table
gives an empty file and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel.llm.ship import received, send_file
from regiopanel.llm.words import SPACE, Words, column, expand, find_words, lower_ascii, pieces, text_bytes
from regiopanel.session import scratch_path

PIECE = 8 << 20
#: Ids in a block, ids after which a segment ends (with its document), and the share of a block's
#: differences that the packed width must hold.
BLOCK, SEGMENT, PERCENTILE = 4096, 1 << 17, 95
#: The id appended to each document.
END = 1
#: Distinct parts that a worker remembers at least until the next piece.
KNOWN = 500_000
_HEAD = np.dtype([("count", "<u4"), ("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u4")])


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, by distinct words."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_buffer(raw)
        self.parts = Tokenizer.from_buffer(raw)
        for t in (self.whole, self.parts):
            t.no_truncation()
            t.no_padding()
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(self.whole.get_vocab().values()) + 1
        self.closes = np.zeros(size, bool)  # ids of tokens that end a part
        for token, i in self.whole.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        """No parts are known, but for the end of a text (an empty part)."""
        self.known: dict[bytes, int] = {b"": 0}
        self.flat, self.at = np.array([END], np.int32), np.array([0, 1], np.int64)  # ids of known parts, and where each starts

    def _learn(self, parts: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(parts, range(n, n + len(parts))))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])

    def _encode(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

    def _encode_parts(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), 2000):
            some = parts[at:at + 2000]
            ids = np.array(self.parts.encode(b" ".join(some).decode(), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._learn(some, ids, np.diff(ends, prepend=0))
            else:  # a part without a closing token
                self._learn(some, *self._encode(self.parts, [p.decode() for p in some]))

    def numbers(self, parts: list[bytes], odd: np.ndarray) -> np.ndarray:
        """The numbers of distinct parts among the known ones; those that aren't known yet are encoded first."""
        if len(self.known) > KNOWN:
            self._forget()
        known = self.known
        fresh = [(p, o) for p, o in zip(parts, odd.tolist()) if p not in known]
        self._encode_parts([p for p, o in fresh if not o])
        rest = [p for p, o in fresh if o]
        if rest:
            self._learn(rest, *self._encode(self.whole, [p.decode("utf-8", "replace") for p in rest]))
        return np.array([known[p] for p in parts], np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed with :data:`END`, and each text's offset among them."""
        data, off = text_bytes(texts)
        low, starts, ends, odd = find_parts(data, find_words(data, off))
        spans = np.empty(2 * len(starts) + 1, np.int64)
        spans[:-1:2], spans[1::2], spans[-1] = starts, ends, len(data)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(spans) - 1, [
            None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(low))]).take(
                pa.array(np.arange(0, len(spans) - 1, 2))).dictionary_encode()
        of_part = coded.indices.to_numpy(zero_copy_only=False)
        strange = np.zeros(len(coded.dictionary), bool)
        strange[of_part] = odd
        number = self.numbers(coded.dictionary.to_pylist(), strange)
        first = np.searchsorted(starts, off)
        code = np.zeros(len(starts) + len(off) - 1, np.int64)  # parts, and the end of each text
        closing = first[1:] + np.arange(len(off) - 1)
        body = np.ones(len(code), bool)
        body[closing] = False
        code[body] = number[of_part]
        counts = np.diff(self.at)[code]
        ids = self.flat[expand(self.at[code], counts)]
        at = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], at[closing + 1]])


_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[0x27, 0x3C]] = _ODD  # contractions, and the texts of special tokens
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0xC3] = _LETTER
_CLASS[SPACE] = 0


def find_parts(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the spans of parts with whether each is odd.

    A word of ASCII and the letters U+00C0 to U+00FF is lower-cased and cut as the pre-tokenizer's pattern does: runs of
    letters, single digits, runs of other characters. Any other word, and one with an apostrophe or ``<``, is *odd*: it
    stays whole and as it is.
    """
    kind = _CLASS[data]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    kind[second & (data != 0x97) & (data != 0xB7)] = _LETTER  # not the signs for times and division
    bad = np.concatenate([[0], np.cumsum(kind == _ODD, dtype=np.int64)])
    odd = bad[words.ends] > bad[words.starts]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.starts[odd]] += 1
    edge[words.ends[odd]] -= 1
    whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    kind[whole] = _ODD
    low = lower_ascii(data)
    low[second & (data < 0x9F) & (data != 0x97)] += 0x20
    low[whole] = data[whole]
    begin = np.zeros(len(data), bool)
    begin[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & (kind[1:] != 0)
    begin[words.starts] = True
    starts = np.flatnonzero(begin)
    last = words.ends[np.searchsorted(words.starts, starts, "right") - 1]
    ends = np.minimum(np.append(starts[1:], len(data)), last)
    return low, starts, ends, kind[starts] == _ODD


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    gap = (ids - low).astype(np.uint32)
    width = int(np.partition(gap, k := max(0, -(-len(gap) * percentile // 100) - 1))[int(k)]).bit_length()
    large = np.flatnonzero(gap >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(gap.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width:]
    head = np.array([(len(ids), low, width, len(large))], _HEAD)
    return b"".join([head.tobytes(), np.packbits(bits).tobytes(), large.astype("<u4").tobytes(),
                     (gap[large] >> np.uint32(width)).astype("<u4").tobytes()])


def unpack_block(data, at: int = 0) -> np.ndarray:
    head = np.frombuffer(data, _HEAD, 1, at)[0]
    n, width, large = int(head["count"]), int(head["width"]), int(head["exceptions"])
    at += _HEAD.itemsize
    size = (n * width + 7) // 8
    gap = np.zeros((n, 32), np.uint8)
    gap[:, 32 - width:] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width).reshape(n, width)
    gap = np.packbits(gap, axis=1).view(">u4").ravel().astype(np.int64)
    at += size
    where = np.frombuffer(data, "<u4", large, at)
    gap[where] |= np.frombuffer(data, "<u4", large, at + 4 * large).astype(np.int64) << width
    return gap + int(head["minimum"])


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """The blocks of a segment and the byte at which each starts."""
    blocks = [pack_block(ids[i:i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1].astype(int).tolist()
    return b"".join(blocks), starts


def unpack(payload, starts) -> np.ndarray:
    return np.concatenate([unpack_block(payload, s) for s in starts]) if len(starts) else np.zeros(0, np.int64)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64()}[type(kind)]
    if isinstance(kind, T.StringType):
        return pa.string()
    raise ValueError(f"ids must be integers or text, not {kind.simpleString()}")


def write_tokens(df: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text",
                 partitions: int | None = None, segment: int = SEGMENT, block: int = BLOCK,
                 percentile: float = PERCENTILE, piece: int = PIECE) -> None:
    """Write the ids of every text to ``out``, in ascending id order."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    arrow, sent = pa.list_(_arrow_type(df.schema[id_col].dataType)), send_file(spark, path)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, docs, counts, held = [], [], [], 0

        def flush():
            payload, starts = pack(np.concatenate(ids), block, percentile)
            row = [[part], [number], [docs], [counts], [held], [starts], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        for batch in pieces(batches, "text", piece):
            got, at = received(WordEncoder, sent).encode_batch(column(batch, "text"))
            for i, doc in enumerate(column(batch, "doc_id").to_pylist()):
                ids.append(got[at[i]:at[i + 1]])
                docs.append(doc)
                counts.append(int(at[i + 1] - at[i]))
                held += counts[-1]
                if held >= segment:
                    yield flush()
                    ids, docs, counts, held, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    names = ["part", "segment", "doc_ids", "counts", "n_ids", "starts", "payload"]
    types = [pa.int32(), pa.int32(), arrow, pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
       .repartitionByRange(n, "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")  # rows of one id may be many
       .mapInArrow(run, f"part int, segment int, doc_ids array<{kind}>, counts array<long>, n_ids long, "
                        "starts array<long>, payload binary")
       .write.mode("overwrite").parquet(out))


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """From the files alone, per document: ``doc_id, start, n_tokens, ids_crc32`` and on request ``ids``."""
    files = spark.read.parquet(out)
    kind = dict(files.dtypes)["doc_ids"][len("array<"):-1]
    size = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition of the file
    base = size.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    begin = files.select("part", "segment", (F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("begin"))
    begin = begin.join(base, "part").select("part", "segment", (F.col("begin") + F.col("base")).alias("begin"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(column(batch, "payload")[i].as_buffer(), column(batch, "starts")[i].as_py())
                docs = column(batch, "doc_ids")[i].values
                counts = column(batch, "counts")[i].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
                m = len(docs)
                row = [pa.repeat(column(batch, "part")[i], m), pa.repeat(column(batch, "segment")[i], m), docs,
                       pa.array(at[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    row.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(row, names)

    names = ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    docs = files.select("part", "segment", "doc_ids", "counts", "starts", "payload").mapInArrow(
        run, f"part int, segment int, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return docs.join(begin, ["part", "segment"]).select(
        "doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file(df: DataFrame, path: str, out: str | None = None, **options) -> DataFrame:
    """Write the ids of every text, read the files back and describe each document from them."""
    spark = df.sparkSession
    out = out or scratch_path(spark, "token-ids")
    write_tokens(df, path, out, **options)
    return read_tokens(spark, out)
