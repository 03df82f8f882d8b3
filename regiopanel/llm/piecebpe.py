"""Operator 13: SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text gets a leading space, spaces become U+2581, and characters are the first symbols. Any two neighbours whose joined text
is a piece may merge; the best piece (highest score) merges first, of equal ones the leftmost. No piece holds U+2581 after
another character, so words are independent, and so are parts of words between two characters that no piece holds side by side.

The distinct words of a piece of the corpus are encoded together in flat numpy arrays, a symbol an entry. A *round* looks up
the smallest pair rank of every part (a segmented minimum), merges the leftmost pair of that rank in all parts at once,
takes out the second symbols (compaction) and looks up only the pairs that are new. Parts without a pair leave. Where no better
piece can grow out of the merged one, further pairs of the same rank in the part are merged in the same round, from the left, without
overlap: they would come next anyway. Parts of more than ``LONG`` symbols, which would keep a round to themselves for
long, make the same merges one by one from a heap.

Spark partitions the documents; no task sees more than its own rows and nothing is shuffled. Memory follows ``PIECE``, the
longest single text and ``KNOWN`` remembered words.

Defined results: a null text is encoded as the empty text (no ids, decoded to ""). Characters outside the vocabulary become byte pieces
(or the unknown piece where the model has none). Texts of control pieces (``<s>``) are ordinary text. Repeated rows are encoded each; extra
columns are ignored; an empty table gives an empty result. Models with a normalizer other than identity, or with
user-defined or unused pieces, are refused with a ``ValueError``.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.llm.ship import received, send_file
from regiopanel.llm.words import column, expand, pieces, release, text_bytes

PIECE = 2 << 20
#: Symbols of a part that is encoded by rounds, distinct words that a worker remembers, bytes of words encoded at a time,
#: and bytes decoded at a time.
LONG, KNOWN, WORDS, DECODE = 1024, 200_000, 2 << 20, 2 << 20

# The model file's fields (pieces 1, trainer 2, normalizer 3), kinds of pieces, and the mark of a space.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
_NONE = np.iinfo(np.int32).max


def read_fields(raw: bytes):
    """``number, value`` of a protobuf message's fields: integers, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at:at + size]
            at += size


class PieceBPE:
    """The vocabulary and merges of a SentencePiece BPE model, from the bytes of its file."""

    def __init__(self, raw: bytes):
        self.texts: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.unknown_text, prefix, squeeze = " ⁇ ", True, True
        for number, value in read_fields(raw):
            if number == _PIECE:
                of = dict(read_fields(value))
                self.texts.append(of[1].decode())
                scores.append(struct.unpack("<f", of[2])[0] if 2 in of else 0.0)
                self.kinds.append(of.get(3, NORMAL))
            elif number == _TRAINER:
                of = dict(read_fields(value))
                if of.get(3, 1) != 2:
                    raise ValueError("not a BPE model")
                self.unknown_text = of[44].decode() if 44 in of else self.unknown_text
            elif number == _NORMALIZER:
                of = dict(read_fields(value))
                prefix, squeeze = bool(of.get(3, 1)), bool(of.get(4, 1))
                if of.get(2) or of.get(6) or squeeze or not prefix or not of.get(5, 1):
                    raise ValueError("only identity normalization with a leading space is supported")
        if {USER, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (text, kind) in enumerate(zip(self.texts, self.kinds)):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
        self.has_bytes = bool((self.byte_ids >= 0).all())
        self._merges(scores)
        self._forget()

    def _merges(self, scores: list[float]) -> None:
        """Symbols by character, and the sorted table of pairs that may merge."""
        normal = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        if any(SPACE in t.lstrip(SPACE) for t in normal):
            raise ValueError("pieces that hold a space after another character are not supported")
        symbol = dict(normal)
        for c in sorted({c for t in normal for c in t}):
            symbol.setdefault(c, len(self.texts) + len(symbol) - len(normal))  # characters of pieces that are none themselves
        self.first_other = len(self.texts) + len(symbol) - len(normal)  # further characters follow, by code point
        self.symbol_of = np.arange(self.first_other, self.first_other + 0x110000, dtype=np.int32)
        for t, i in symbol.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = i
        self.span = np.int64(self.first_other + 0x110000)
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        pairs, beside, careful = {}, set(), set()
        for t, i in normal.items():
            rank = rank_of[scores[i]]
            for k in range(1, len(t)):
                beside.add((symbol[t[k - 1]], symbol[t[k]]))
                left, right = symbol.get(t[:k]), symbol.get(t[k:])
                if left is not None and right is not None:
                    pairs[left, right] = rank, i
                    for part in (left, right):  # a better piece, or one as good, can grow out of this one
                        if part < len(scores) and len(self.texts[part]) > 1 and rank <= rank_of[scores[part]]:
                            careful.add(rank_of[scores[part]])
        self.pairs = pairs
        keys = np.array([a * int(self.span) + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([r for r, _ in pairs.values()], np.int32)[by], _NONE)
        self.joined = np.append(np.array([i for _, i in pairs.values()], np.int32)[by], -1)
        self.beside = np.sort(np.array([a * int(self.span) + b for a, b in beside], np.int64))
        self.all_at_once = np.ones(len(rank_of) + 1, bool)
        self.all_at_once[sorted(careful)] = False

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, the last one (no rank) for pairs that don't merge."""
        key = left * self.span + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1).astype(np.int32)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all parts after their merges, and how many each part has. ``starts`` has each part's first symbol."""
        done_part, done_symbols = [], []
        n = len(starts)
        size = np.diff(np.append(starts, len(symbols)))
        part = np.repeat(np.arange(n, dtype=np.int32), size)
        symbols = symbols.astype(np.int64)
        place = np.full(len(symbols), len(self.keys) - 1, np.int32)
        if len(symbols) > 1:
            inside = np.flatnonzero(part[1:] == part[:-1])
            place[inside] = self._look_up(symbols[inside], symbols[inside + 1])
        rank = self.ranks[place]
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbols)))
            over = best == _NONE
            if over.any():  # parts without a pair leave
                gone = np.repeat(over, counts)
                done_part.append(part[gone])
                done_symbols.append(symbols[gone])
                stay = ~gone
                symbols, part, place, rank = symbols[stay], part[stay], place[stay], rank[stay]
                best, counts = best[~over], counts[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            # Of neighbouring hits every other one, from the left; of the ranks that need care only the part's first.
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            of = part[hit]
            leads = np.concatenate([[True], of[1:] != of[:-1]])
            hit = hit[np.where(self.all_at_once[rank[hit]], in_run % 2 == 0, leads)]
            symbols[hit] = self.joined[place[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            place[hit] = place[hit + 1]  # no pair if the second symbol was the part's last
            new = np.cumsum(stay)[hit] - 1
            symbols, part, place = symbols[stay], part[stay], place[stay]
            fresh = np.concatenate([new, new[new > 0] - 1])
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[part[fresh] == part[fresh + 1]]
            place[fresh] = self._look_up(symbols[fresh], symbols[fresh + 1])
            rank = self.ranks[place]
        if not done_part:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        part, symbols = np.concatenate(done_part), np.concatenate(done_symbols)
        return symbols[np.argsort(part, kind="stable")], np.bincount(part, minlength=n)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The same merges for one long part, from a heap of (rank, position)."""
        pairs, n = self.pairs, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = joined, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := pairs.get((symbols[x], symbols[after[x]]))):
                    heapq.heappush(heap, (p[0], x, symbols[x], symbols[after[x]], p[1]))
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words (spaces are 0x20 in them), one word after another, and how many each has."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[np.concatenate([[0], ends])]  # words' first characters
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        points[points == 0x20] = ord(SPACE)
        symbols = self.symbol_of[points]
        begins = np.zeros(len(symbols) + 1, bool)
        begins[chars] = True
        key = symbols[:-1] * self.span + symbols[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        begins[1:-1] |= self.beside[at] != key
        starts = np.flatnonzero(begins[:-1])
        size = np.diff(np.append(starts, len(symbols)))
        long = size > LONG
        took = np.repeat(~long, size)
        short = np.cumsum(np.where(long, 0, size)) - np.where(long, 0, size)
        merged, counts = self.merge(symbols[took], short[~long])
        if long.any():
            every = np.split(merged, np.cumsum(counts)[:-1]) if len(counts) else []
            whole: list = [None] * len(starts)
            for i, x in zip(np.flatnonzero(~long).tolist(), every):
                whole[i] = x
            for i in np.flatnonzero(long).tolist():
                whole[i] = np.array(self.merge_one(symbols[starts[i]:starts[i] + size[i]].tolist()), np.int64)
            merged, counts = np.concatenate(whole), np.array([len(x) for x in whole], np.int64)
        word = np.repeat(np.searchsorted(chars, starts, "right") - 1, counts)
        other = merged >= len(self.texts)
        if other.any():  # characters that are no piece
            kinds, which = np.unique(merged[other], return_inverse=True)
            back = {int(self.symbol_of[ord(c)]): c for c in {c for t in self.texts for c in t}} if (kinds < self.first_other).any() else {}
            each = [self._fallback(back[s] if s < self.first_other else chr(s - self.first_other)) for s in kinds.tolist()]
            sizes = np.array([len(x) for x in each], np.int64)
            flat = np.array([i for x in each for i in x], np.int64)
            count = np.ones(len(merged), np.int64)
            count[other] = sizes[which]
            out = np.repeat(merged, count)
            out[np.repeat(other, count)] = flat[expand((np.cumsum(sizes) - sizes)[which], sizes[which])]
            merged, word = out, np.repeat(word, count)
        return merged.astype(np.int32), np.bincount(word, minlength=len(words))

    def _fallback(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode())].tolist() if self.has_bytes else [self.unknown]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Drop the remembered words: a worker that is used again needn't keep them."""
        self._forget()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words among the known ones; those that aren't known yet are encoded first."""
        if len(self.known) > KNOWN:
            self._forget()
        known = self.known
        fresh = [w for w in words if w not in known]
        first = 0
        while first < len(fresh):
            last, size = first, 0
            while last < len(fresh) and (last == first or size + len(fresh[last]) <= WORDS):
                size += len(fresh[last])
                last += 1
            ids, counts = self.encode_words(fresh[first:last])
            known.update(zip(fresh[first:last], range(len(known), len(known) + last - first)))
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            first = last
        return np.array([known[w] for w in words], np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's offset among them."""
        data, off = text_bytes(texts)
        full = np.diff(off) > 0
        data = np.insert(data, off[:-1][full], 0x20)  # the leading space of each text
        off = off + np.concatenate([[0], np.cumsum(full)])
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        mark = np.frombuffer(SPACE.encode(), np.uint8)
        if len(data) > 3:
            cut[3:] &= ~((data[:-3] == mark[0]) & (data[1:-2] == mark[1]) & (data[2:-1] == mark[2]))
        bounds = np.zeros(len(data) + 1, bool)
        bounds[:-1] = cut
        bounds[off] = True
        cuts = np.flatnonzero(bounds)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [
            None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        number = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.diff(self.at)[number]
        ids = self.flat[expand(self.at[number], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, off)]

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces as they are shown, with starts and lengths by id, and which ids hide a leading space."""
        if not hasattr(self, "_table"):
            shown = []
            for text, kind in zip(self.texts, self.kinds):
                shown.append({CONTROL: b"", UNKNOWN: self.unknown_text.encode(), BYTE: bytes([int(text[3:5], 16)]) if kind == BYTE else b""}
                             .get(kind, text.replace(SPACE, " ").encode()))
            lengths = np.array([len(x) for x in shown], np.int64)
            spaced = np.array([k == NORMAL and t.startswith(SPACE) for t, k in zip(self.texts, self.kinds)], bool)
            self._table = np.frombuffer(b"".join(shown), np.uint8), np.cumsum(lengths) - lengths, lengths, spaced
        return self._table

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the id lists: the leading space goes; bytes that are no UTF-8 become U+FFFD each."""
        data, starts, lengths, spaced = self.table
        out: list[str] = []
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[at]
        control = np.array([k == CONTROL for k in self.kinds], bool)
        first = 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + DECODE, "right")) - 1)
            some = ids[at[first]:at[last]]
            raw = data[expand(starts[some], lengths[some])].tobytes()
            cut = (ends[first:last + 1] - ends[first]).tolist()
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                own = some[at[first + i] - at[first]:at[first + i + 1] - at[first]]
                breaks = np.flatnonzero(control[own])  # bytes on both sides of a control piece make no character together
                k = 0
                while k < len(breaks) and breaks[k] == k:
                    k += 1
                a += bool(k < len(own) and spaced[own[k]])
                try:
                    if not len(breaks):
                        out.append(raw[a:b].decode("utf-8"))
                        continue
                except UnicodeDecodeError:
                    pass
                sides = np.maximum(a, np.concatenate([[a], cut[i] + np.cumsum(lengths[own])[breaks], [b]]))
                out.append("".join(_shown(raw[x:y]) for x, y in zip(sides[:-1], sides[1:])))
            first = last
        return out


def _shown(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _ids_array(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, piece: int = PIECE) -> DataFrame:
    """``doc_id, ids`` of every text; with ``decode`` also ``decoded``, the text of those ids."""
    kind, sent = dict(df.dtypes)[id_col], send_file(df.sparkSession, path)
    names = ["doc_id", "ids", "decoded"][:2 + decode]

    def run(batches):
        model = received(PieceBPE, sent)
        for batch in pieces(batches, "text", piece):
            ids, at = model.encode_batch(column(batch, "text"))
            out = [column(batch, "doc_id"), _ids_array(ids, at)]
            if decode:
                out.append(pa.array(model.decode_batch(ids, at), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)
        model.forget()
        release()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of id lists (null list: empty text; ids outside the vocabulary are an error)."""
    kind, sent = dict(df.dtypes)[id_col], send_file(df.sparkSession, path)

    def run(batches):
        model = received(PieceBPE, sent)
        for batch in batches:
            lists = column(batch, "ids").fill_null([])
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = model.decode_batch(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")


def digests(df: DataFrame, path: str) -> DataFrame:
    """Per document: token count and SHA-256 of its ids and of the text decoded from them."""
    return encode(df, path, decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
