"""Operator 1: byte-level BPE encoding by a prefix-sharing trie, and decoding.

BPE has a property that makes it incremental: the encoding of a word's prefix is fixed by its
*last token* and by the encoding of what stands before that token, and the last token is the one
vocabulary entry ending there that may follow the last token before it. So the state of a prefix
is one token id. The distinct words of a piece of the corpus form a trie; a depth-first walk
carries the states of the current path, and a prefix that many words share is worked out once.
The walk goes over the words in sorted order, which is the trie's depth-first order: the common
prefix with the previous word is the path to return to, so only one path is held in memory.

Spark partitions the documents; each task encodes the distinct words of up to ``PIECE`` bytes of
text at a time, and no task sees more than its own rows. Nothing is shuffled.

Defined results: a null text is encoded as the empty text (no ids, decoded to ""). The text of an
added token (``<|endoftext|>``) is that token's id, as in the tokenizers library. Repeated rows are
encoded each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.llm.ship import received, send_file
from regiopanel.llm.words import column, expand, pieces, release, text_bytes

#: Bytes of text whose distinct words share one trie.
PIECE = 2 << 20
#: Bytes that are put together from tokens at a time, and remembered pairs of tokens and words.
DECODE, PAIRS, WORDS = 2 << 20, 300_000, 200_000

# Fixed value: the pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable ones stand for themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """The vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, file: str | bytes):
        """``file``: its path, or its bytes."""
        if isinstance(file, str):
            with open(file, "rb") as f:
                file = f.read()
        spec = json.loads(file)
        chars = byte_alphabet()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items() if s not in self.added}
        self.text_of |= {i: s.encode() for s, i in self.added.items()}
        self.rank = dict.fromkeys(self.text_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}  # pair of ids: rank of its merge
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.joined[a, b] = r
            if self.rank[both] < 0:
                self.rank[both], self.parts[both] = r, (a, b)
        self.may_follow: dict[int, bool] = {}  # by the ids of both tokens in one number
        # A token that its own bytes don't encode to never occurs.
        self.tokens = {b: i for i, b in self.text_of.items() if i not in self.added.values() and
                       (i not in self.parts or self._apart(*self.parts[i], self.rank[i]))}
        self.longest = max(map(len, self.tokens))
        self.length = {i: len(b) for i, b in self.text_of.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.split = regex.compile(SPLIT)
        self.recent: dict[bytes | int, tuple[int, ...]] = {}  # words of the pieces before: many come again

    def _apart(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether no merge (of a rank below ``until``) joins a token ending in ``a`` with one starting ``b``.

        Steps back through time: of the two tokens at the border the one formed later is taken
        apart, and a merge across the border happens if its rank comes before both were used up.
        Of equal merges the left one comes first.
        """
        used_a = used_b = 1 << 60 if until is None else until
        if until is not None:
            used_b -= 1
        rank, joined = self.rank, self.joined
        while True:
            across = joined.get((a, b))
            if across is not None and across < used_a and across <= used_b:
                return False
            if rank[a] > rank[b]:
                used_a = rank[a]
                a = self.parts[a][1]
            elif rank[b] >= 0:
                used_b = rank[b]
                b = self.parts[b][0]
            else:
                return True

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct words, in one depth-first walk over their trie."""
        out: dict[bytes, tuple[int, ...]] = {}
        tokens, follow, longest, length = self.tokens, self.may_follow, self.longest, self.length
        last = [-1]  # last[d]: last token of the path's first d bytes
        before = b""
        if len(follow) > PAIRS:
            follow.clear()
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = tokens.get(word[start:end])
                    if token is None:
                        continue
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    fits = follow.get(pair)
                    if fits is None:
                        fits = follow[pair] = self._apart(last[start], token)
                    if fits:
                        break
                last.append(token)
            before, end, ids = word, len(word), []
            while end:
                ids.append(last[end])
                end -= length[last[end]]
            out[word] = tuple(ids[::-1])
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's offset among them."""
        data, off = text_bytes(texts)
        mark = np.zeros(len(data) + 1, bool)
        mark[safe_cuts(data)] = mark[off] = True
        cuts = np.flatnonzero(mark)  # word runs lie between these: tokens always end there
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [
            None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = runs.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        split, special = self.split.findall, self.special
        parts: list[bytes | int] = []  # of one run after another: words, and ids of added tokens
        first = np.empty(len(coded.dictionary) + 1, np.int64)
        for i, run in enumerate(coded.dictionary.to_pylist()):
            first[i] = len(parts)
            if run[:1] == b" " and run[1:].isalpha():  # a space and ASCII letters only: one word
                parts.append(run)
                continue
            text = run.decode("utf-8", "replace")
            if special is None or "<" not in text or not special.search(text):
                parts += [w.encode() for w in split(text)]
                continue
            at = 0
            for m in special.finditer(text):
                parts += [w.encode() for w in split(text[at:m.start()])]
                parts.append(self.added[m[0]])
                at = m.end()
            parts += [w.encode() for w in split(text[at:])]
        first[-1] = len(parts)
        ids_of = self._ids_of(parts)
        each = [ids_of[w] for w in parts]
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(upto[-1]))
        counts = np.diff(upto[first])
        starts = np.cumsum(counts) - counts
        ids = flat[expand(starts[code], counts[code])]
        at = np.concatenate([[0], np.cumsum(counts[code])])
        return ids, at[np.searchsorted(cuts, off)] if len(code) else np.zeros(len(off), np.int64)

    def _ids_of(self, parts: list[bytes | int]) -> dict[bytes | int, tuple[int, ...]]:
        """Ids of words, of which those that aren't remembered are walked; an added token's id is its own."""
        words = set(parts).difference(self.added.values())
        fresh = self.encode_words([w for w in words if w not in self.recent])
        if len(self.recent) + len(fresh) > WORDS:
            self.recent = {w: self.recent[w] for w in words if w in self.recent}
        self.recent |= fresh
        self.recent |= {i: (i,) for i in self.added.values()}
        return self.recent

    def forget(self) -> None:
        """Drop what is remembered from piece to piece: a worker that is used again needn't keep it."""
        self.recent = {}
        self.may_follow.clear()

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens, one after another, with starts and lengths by id."""
        if not hasattr(self, "_table"):
            n = max(self.text_of) + 1
            lengths = np.array([len(self.text_of.get(i, b"")) for i in range(n)], np.int64)
            data = np.frombuffer(b"".join(self.text_of.get(i, b"") for i in range(n)), np.uint8)
            self._table = data, np.cumsum(lengths) - lengths, lengths
        return self._table

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the id lists; bytes that are no UTF-8 become U+FFFD."""
        data, starts, lengths = self.table
        out: list[str] = []
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[at]
        first = 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + DECODE, "right")) - 1)
            some = ids[at[first]:at[last]]
            raw = data[expand(starts[some], lengths[some])].tobytes()
            cut = (ends[first:last + 1] - ends[first]).tolist()
            out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
            first = last
        return out


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two characters that surely are no white space.

    Every token ends before such a space, so what stands between two cuts is split into words
    alike wherever it occurs. Characters that might be Unicode white space give no cut.
    """
    ascii_word = (data >= 0x21) & (data < 0x80)
    two_bytes = np.zeros(len(data), bool)
    two_bytes[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)  # last byte of U+00C0 to U+07FF
    left = ascii_word | two_bytes
    right = ascii_word | ((data >= 0xC3) & (data <= 0xE0)) | ((data >= 0xE4) & (data <= 0xF4))
    cut = data == 0x20
    if len(cut):
        cut[1:] &= left[:-1]
        cut[:-1] &= right[1:]
        cut[0] = cut[-1] = False
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The tokenizer of a file."""
    return ByteBPE(path)


def _ids_array(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False,
           piece: int = PIECE) -> DataFrame:
    """``doc_id, ids`` of every text; with ``decode`` also ``decoded``, the text of those ids."""
    kind, sent = dict(df.dtypes)[id_col], send_file(df.sparkSession, path)

    def run(batches):
        bpe = received(ByteBPE, sent)
        for batch in pieces(batches, "text", piece):
            ids, at = bpe.encode_batch(column(batch, "text"))
            out = [column(batch, "doc_id"), _ids_array(ids, at)]
            if decode:
                out.append(pa.array(bpe.decode_batch(ids, at), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)
        bpe.forget()
        release()

    names = ["doc_id", "ids", "decoded"][:2 + decode]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of id lists (null list: empty text; ids outside the vocabulary are an error)."""
    kind, sent = dict(df.dtypes)[id_col], send_file(df.sparkSession, path)

    def run(batches):
        bpe = received(ByteBPE, sent)
        for batch in batches:
            lists = column(batch, "ids").fill_null([])
            counts = np.array([len(x) for x in lists], np.int64)
            texts = bpe.decode_batch(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                     np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, decoded string")


def digests(df: DataFrame, path: str) -> DataFrame:
    """Per document: token count and SHA-256 of its ids and of the text decoded from them."""
    return encode(df, path, decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
