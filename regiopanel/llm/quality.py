r"""Operator 7: quality rules with suffix-array repetition.

A text is a sequence of words. Its suffix array sorts all word suffixes; the longest common prefix
(LCP) of two neighbours is the length of a repeat, and an LCP interval of at least ``min_repeat``
words marks a maximal repeated substring at each of its suffixes. The union of those spans over
the number of words is the covered fraction, the largest LCP the longest repeat; the method's
verdict limits both.

The suffix arrays of the texts of one piece are built together by prefix doubling, with the text's
number in front of the first rank, so that suffixes of different texts never tie. Only suffixes
that still tie are sorted again, and ranks of each doubling give LCPs exactly. Work is local to a
task, memory follows ``PIECE`` (or the longest single text). Nothing is shuffled.

Base counts (words are runs of bytes other than 0x20 and 0x09 to 0x0D): ``n_words``, ``word_chars``
(code points in words), ``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines`` (``\n``-split
lines with a word that equal an earlier line), ``n_repeat_words`` (words in 8-word windows found
twice or more in the text, the first included). ``base_failed``: fewer than 20 words, or more than
30 % repeat words. ``kept``: the base holds and so does the verdict.

Defined results: null, empty and blank texts have no words, fail the base and are not kept; repeated
rows are judged each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.llm.ship import ship
from regiopanel.llm.words import SPACE, column, find_lines, find_words, pieces, rolling_spans, rolling_sums, span_hashes, text_bytes

PIECE = 1 << 20
#: Words in the windows of the base rule.
WINDOW = 8
#: Limits of the verdict: the shortest repeat that counts, the covered fraction of the words, and the
#: longest repeat as a fraction of the words.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.25, 0.2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, ... of values, equal for equal values."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])) if len(values) else 0
    return out


def repeats(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word position the longest repeat that starts there (the larger LCP with its neighbours
    in the suffix array of its text), and the suffix array. ``first`` has each text's first position."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    end = np.repeat(first[1:], count)
    rank = _dense(words)
    rank = text * n + rank if len(count) < (1 << 62) // max(n, 1) else _dense(text) * n + rank
    order = np.argsort(rank, kind="stable")
    size = 1
    at = rank[order]
    head = np.concatenate([[True], at[1:] != at[:-1]])  # first of its group of ties
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        suffix = order[slots]
        beyond = suffix + size
        second = np.where(beyond < end[suffix], rank[np.minimum(beyond, n - 1)], -1)
        key = rank[suffix] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[slots] = suffix[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = fresh
        rank[suffix[by]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        size *= 2
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    # No two neighbours agree in more than the last size (or they would still be tied): add its halves as long as the hashes of that many words agree.
    sums = rolling_sums(words.astype(np.uint64))
    last_left, last_right = end[order[:-1]], end[order[1:]]
    last_left = np.where(last_left == last_right, last_left, 0)  # of two texts: nothing in common
    while size > 1:
        size //= 2
        same = np.flatnonzero((left + size <= last_left) & (right + size <= last_right))
        a, b = left[same], right[same]
        same = same[rolling_spans(sums, a, a + size) == rolling_spans(sums, b, b + size)]
        lcp[same] += size
        left[same] += size
        right[same] += size
    longest = np.zeros(n, np.int64)
    if n > 1:
        longest[order[:-1]] = lcp
        longest[order[1:]] = np.maximum(longest[order[1:]], lcp)
    return longest, order


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words."""
    starts = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + longest[starts], -1)
    return np.cumsum(edge[:-1]) > 0


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[first])


def _duplicate_lines(data: np.ndarray, off: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    lines = find_lines(data, off)
    worded = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    full = worded[lines.ends] > worded[lines.starts]
    text = np.repeat(np.arange(len(off) - 1), np.diff(lines.first))[full]
    hashes = span_hashes(data, lines.starts[full], lines.ends[full])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    again = (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(text[1:][again], minlength=len(off) - 1)


def measure(texts: pa.Array, window: int = WINDOW, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of each text, by name."""
    data, off = text_bytes(texts)
    words = find_words(data, off)
    in_word = ~SPACE[data]
    hashes = span_hashes(data, words.starts, words.ends)
    longest, _ = repeats(hashes, words.first)
    n = np.diff(words.first)
    most = np.zeros(len(n), np.int64)
    if len(longest):
        np.maximum.at(most, np.repeat(np.arange(len(n)), n), longest)
    return {
        "n_words": n,
        "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), off),
        "n_symbols": _per_text(_SYMBOL[data], off),
        "n_dup_lines": _duplicate_lines(data, off, in_word),
        "n_repeat_words": _per_text(covered(longest, window), words.first),
        "n_covered": _per_text(covered(longest, min_repeat), words.first),
        "longest_repeat": most,
    }


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST,
            piece: int = PIECE) -> DataFrame:
    """Counts and verdicts of every whole text; a repeat shorter than ``min_repeat`` words breaks no limit."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(batches):
        for batch in pieces(batches, "text", piece):
            got = measure(column(batch, "text"), window, min_repeat)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(got[k], pa.int64()) for k in names)], ["doc_id", *names])

    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in names))
    n = F.col("n_words")
    fine = (F.col("n_covered") <= max_covered * n) & (
        (F.col("longest_repeat") < min_repeat) | (F.col("longest_repeat") <= max_longest * n))
    return (out.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
            .withColumn("kept", ~F.col("base_failed") & fine))
