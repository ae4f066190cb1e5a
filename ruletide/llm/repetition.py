"""Quality rules on repetition inside a text, from its suffix array over words.

Longest-common-prefix intervals of the suffix array are the maximal repeated word sequences of a text; the union of their
spans (of MIN_REPEAT words or more) over all words is the covered fraction, and the deepest interval the longest repeat. A
text fails if it is too short, if 3-word windows that occur twice or more hold over half its words, if repeats cover more
than MAX_COVERED of it, or if one repeat is longer than MAX_LONGEST of its words.

Many texts share one suffix array (their first words are told apart by text), built by prefix doubling that sorts only the
suffixes still tied. Nulls and texts without a word count zero words and fail the base rule. Other columns are ignored;
repeated rows are judged alike, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruletide.llm import textkit as tk

MIN_WORDS = 50
WINDOW = 3
WINDOW_SHARE = 50
MIN_REPEAT = 8
MAX_COVERED = 0.4
MAX_LONGEST = 0.15  # under half of MAX_COVERED, else it never decides: a repeat covers its own words
SYMBOLS = "#*$%&|<>"
DENSE = 1 << 21  # words up to which all ranks of a level are kept: 8 MB

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

SCHEMA = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, n_repeats long, base_failed boolean, kept boolean"


class Level:
    """Ranks of the suffixes by their first 2^k tokens; of a long text only those that shared their rank before, if they are few."""

    def __init__(self, rank: np.ndarray, tied: np.ndarray | None = None):
        self.at = None if tied is None or len(rank) < DENSE or 4 * len(tied) > len(rank) else np.sort(tied).astype(np.int32)
        self.rank = (rank if self.at is None else rank[self.at]).astype(np.int32)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes a and b, different ones, have one rank."""
        if self.at is None:
            return self.rank[a] == self.rank[b]
        i, j = (np.minimum(np.searchsorted(self.at, x), len(self.at) - 1) for x in (a, b))
        return (self.at[i] == a) & (self.at[j] == b) & (self.rank[i] == self.rank[j]) if len(self.at) else np.zeros(len(a), bool)


def suffix_array(tokens: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The suffix array of tokens, and the suffixes' ranks by their first 1, 2, 4, ... tokens.

    room: tokens from each position to the end of its text; a suffix stops there. Ranks are positions of the first suffix of
    a tie, so ties are equal ranks.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    levels, h = [], 1
    key = tokens[order]
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
    levels.append(Level(rank))
    tied = ~(new & np.concatenate((new[1:], [True]))) if n else new
    while tied.any():
        at = np.flatnonzero(tied)
        sub = order[at]
        follow = np.where(room[sub] > h, rank[np.minimum(sub + h, n - 1)], -1)
        key = rank[sub] * (n + 2) + follow + 1
        way = np.argsort(key, kind="stable")
        sub, key = sub[way], key[way]
        order[at] = sub
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[sub] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(Level(rank, sub))
        tied[at] = ~(new & np.concatenate((new[1:], [True])))
        h *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[Level], room: np.ndarray) -> np.ndarray:
    """For each two neighbours of the suffix array, how many first tokens they share."""
    lcp = np.zeros(max(0, len(order) - 1), np.int64)
    live = np.flatnonzero(levels[0].same(order[1:], order[:-1])) if len(order) > 1 else np.zeros(0, np.int64)
    a, b, got, last = order[live], order[live + 1], np.zeros(len(live), np.int64), len(order) - 1
    for k in reversed(range(len(levels))):
        h = 1 << k
        fits = np.flatnonzero((room[a] - got >= h) & (room[b] - got >= h))
        x, y = np.minimum(a[fits] + got[fits], last), np.minimum(b[fits] + got[fits], last)
        got[fits[levels[k].same(x, y)]] += h
    lcp[live] = got
    return lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and one position of every maximal repeat of `least` tokens or more.

    A repeat is an interval of the suffix array whose common prefixes are no shorter than its own and that no neighbour
    extends (so its occurrences are not all followed by one token); it is maximal if they are not all preceded by one token
    either. before: the token before each position, negative and different from each other at the beginnings of texts.
    """
    left = before[order]
    differs = np.concatenate(([0], np.cumsum(left[1:] != left[:-1]))) if len(order) else np.zeros(1, np.int64)
    length, where, stack = [], [], []  # stack: (prefix, first suffix) of the open intervals
    deep = np.flatnonzero(lcp >= least)

    def close(floor: int, end: int, first: int) -> int:
        """Close the open intervals deeper than floor; they end with suffix `end`. Returns where a new one of floor begins."""
        while stack and stack[-1][0] > floor:
            depth, first = stack.pop()
            if differs[end] > differs[first]:
                length.append(depth)
                where.append(first)
        return first

    last = -2
    for i, v in zip(deep.tolist(), lcp[deep].tolist(), strict=True):
        if i != last + 1:
            close(0, last + 1, 0)
        first = close(v, i, i)
        if not stack or stack[-1][0] < v:
            stack.append((v, first))
        last = i
    close(0, last + 1, 0)
    return np.array(length, np.int64), order[np.array(where, np.int64)] if where else np.zeros(0, np.int64)


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    reach = np.zeros(n, np.int64)
    reach[starts] = starts + lengths  # starts are distinct
    return np.maximum.accumulate(reach) > np.arange(n)


def repeats(tokens: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each position, the longest stretch from it that occurs elsewhere in its text; the suffix array and its prefixes."""
    order, levels = suffix_array(tokens, room)
    lcp = common_prefixes(order, levels, room)
    best = np.zeros(len(tokens), np.int64)
    if len(lcp):
        np.maximum.at(best, order[1:], lcp)
        np.maximum.at(best, order[:-1], lcp)
    return best, order, lcp


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts of each text of a column."""
    buf, off = tk.flat(column)
    texts = len(off) - 1
    starts, ends, doc = tk.words(buf, off)
    n = len(starts)
    n_words = np.bincount(doc, minlength=texts)
    first = np.concatenate(([0], np.cumsum(n_words)))
    room = first[doc + 1] - np.arange(n)
    word = tk.span_ids(buf, starts, ends).astype(np.int64)
    before = np.concatenate(([-1], word[:-1])) if n else word
    opens = np.flatnonzero(room == n_words[doc]) if n else np.zeros(0, np.int64)
    before[opens] = -1 - opens
    best, order, lcp = repeats(doc * (n + 1) + word, room)
    hit = np.flatnonzero(best >= WINDOW)
    windows = _covered(hit, np.full(len(hit), WINDOW), n)
    long = np.flatnonzero(best >= MIN_REPEAT)
    covered = _covered(long, best[long], n)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, doc, best)
    _, found = maximal_repeats(order, lcp, before, MIN_REPEAT)
    # lines: runs between newlines, empty ones have no word and never count
    l_start, l_end = tk.runs(buf != 0x0A, off)
    inner = np.searchsorted(starts, l_start)
    full = (inner < n) & (starts[np.minimum(inner, n - 1)] < l_end) if n else np.zeros(len(l_start), bool)
    line, l_doc = tk.span_ids(buf, l_start[full], l_end[full]), tk.owner(l_start[full], off)
    by = np.lexsort((line, l_doc))
    again = (line[by][1:] == line[by][:-1]) & (l_doc[by][1:] == l_doc[by][:-1])
    return {
        "n_words": n_words,
        "word_chars": tk.per_text(~tk.IS_SPACE[buf] & ((buf & 0xC0) != 0x80), off),
        "n_symbols": tk.per_text(_IS_SYMBOL[buf], off),
        "n_dup_lines": np.bincount(l_doc[by][1:][again], minlength=texts),
        "n_repeat_words": np.bincount(doc[windows], minlength=texts),
        "covered_words": np.bincount(doc[covered], minlength=texts),
        "longest_repeat": longest,
        "n_repeats": np.bincount(doc[found], minlength=texts),
    }


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "text", 2 << 20):
            m = measure(batch.column(1))
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > WINDOW_SHARE * m["n_words"])
            bad = (m["covered_words"] > MAX_COVERED * m["n_words"]) | (m["longest_repeat"] > MAX_LONGEST * m["n_words"])
            arrays = [batch.column(0), *(pa.array(v.astype(np.int64)) for v in m.values()), pa.array(failed), pa.array(~failed & ~bad)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *m, "base_failed", "kept"])


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, covered words, longest repeat, base_failed and kept."""
    tk.keep_batches_small(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_judge, SCHEMA)
