"""Operator 5: greedy word-piece counts by a linear longest-match automaton.

Greedy word-piece takes, again and again, the longest vocabulary entry at the start of what is
left of a word. Written plainly it rereads characters. The automaton reads every byte once: it is
the trie of the vocabulary in which each node also has a failure link, the node of what remains
once the longest entries at its start have been taken off, and how many entries those were (the
*popped* count). Where no child fits, the popped count is added and the link followed; a word's end
pops what is left. Only counts are kept, no piece is ever built.

The pieces are those of a byte-level vocabulary; a word is read with the space before it, so that
entries that begin with a space are word starts. All single bytes are entries, so every word has a
count. Words are runs of bytes other than 0x20 and 0x09 to 0x0D.

Each task counts the distinct words of up to ``PIECE`` bytes of text once and sums per document;
nothing is shuffled. Defined results: null, empty and blank texts have no words and no tokens;
repeated rows are counted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.llm.bpe import ByteBPE
from regiopanel.llm.ship import received, send_file
from regiopanel.llm.words import column, find_words, pieces, text_bytes

PIECE = 4 << 20


class LongestMatch:
    """The automaton of a set of byte strings that holds every single byte."""

    def __init__(self, vocabulary):
        self.child: list[dict[int, int]] = [{}]
        depth, full = [0], [False]
        for entry in vocabulary:
            node = 0
            for byte in entry:
                down = self.child[node].get(byte)
                if down is None:
                    down = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    depth.append(depth[node] + 1)
                    full.append(False)
                node = down
            full[node] = True
        self.link, self.popped = [-1] * len(self.child), [0] * len(self.child)
        level = [(0, byte, down) for byte, down in self.child[0].items()]
        while level:  # breadth first: links go to shorter strings
            below = []
            for parent, byte, node in level:
                if full[node]:  # the whole string is an entry: it is taken off, nothing remains
                    self.link[node], self.popped[node] = 0, 1
                else:  # what the parent's pops leave, and then this byte
                    at, pops = self.link[parent], self.popped[parent]
                    while at >= 0 and byte not in self.child[at]:
                        pops += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.child[at][byte], pops
                below += [(node, b, n) for b, n in self.child[node].items()]
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of ``word``; None if some part of it starts no entry."""
        child, link, popped = self.child, self.link, self.popped
        node = total = 0
        for byte in word:
            down = child[node].get(byte)
            while down is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return None
                down = child[node].get(byte)
            node = down
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return None
        return total


def automaton(file: str | bytes) -> LongestMatch:
    """The automaton of a tokenizer file's vocabulary."""
    return LongestMatch(ByteBPE(file).tokens)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 piece: int = PIECE) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text."""
    kind, sent = dict(df.dtypes)[id_col], send_file(df.sparkSession, path)

    def run(batches):
        count = received(automaton, sent).count
        for batch in pieces(batches, "text", piece):
            data, off = text_bytes(column(batch, "text"))
            words = find_words(data, off)
            spans = np.empty(2 * len(words.starts) + 1, np.int64)  # words and the gaps between them
            spans[:-1:2], spans[1::2], spans[-1] = words.starts, words.ends, len(data)
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(spans) - 1, [
                None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data))])
            coded = texts.take(pa.array(np.arange(0, len(spans) - 1, 2))).dictionary_encode()
            each = np.array([count(b" " + w) for w in coded.dictionary.to_pylist()], np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(each[code] if len(code) else np.zeros(0, np.int64))])
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), pa.array(np.diff(words.first), pa.int64()),
                pa.array(np.diff(sums[words.first]), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_tokens long")
