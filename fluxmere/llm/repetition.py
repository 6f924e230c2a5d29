"""Quality rules: repetition found through a suffix array over each text's words.

The suffixes of a text (as word sequences) are sorted by prefix doubling that refines only what is
not yet told apart; the kept ranks give the longest common prefix of neighbours. A position whose
longest common prefix with a neighbour is L starts a repeated substring of L words; the union of
these spans is the union of all maximal repeated substrings.

Defined results: null and empty texts have no words and fail the base rule; repeated rows get
equal results; text of any length is handled whole, its arrays take about 60 bytes a word.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, words

#: Characters counted as symbols, fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: The characters between words, fixed by the contract.
BLANKS = " \t\n\r\x0b\x0c"

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_spans_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
)


def repeat_lengths(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence from there that also starts elsewhere.

    ids: a number per word; equal numbers are equal words. The sequence ends at the end of ids.
    """
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    suffixes = np.argsort(ids, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(ids[suffixes[1:]], ids[suffixes[:-1]], out=fresh[1:])
    rank = np.full(n + 1, -1, np.int64)
    rank[suffixes] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    paired = ~fresh  # neighbours that share their first word
    levels, step = [], 1
    while True:
        levels.append(rank[:n].astype(np.int32))
        same = ~fresh
        open_ = same.copy()
        open_[:-1] |= same[1:]
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        at = suffixes[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        suffixes[slots] = at
        new = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        fresh[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        step *= 2
    right = np.flatnonzero(paired)
    i, j = suffixes[right - 1], suffixes[right]
    length = np.zeros(len(right), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + length, j + length
        inside = np.maximum(a, b) < n
        hit = np.zeros(len(right), bool)
        level = levels[k]
        hit[inside] = level[a[inside]] == level[b[inside]]
        length[hit] += 1 << k
    np.maximum.at(best, i, length)
    np.maximum.at(best, j, length)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def profile(texts: list, min_span: int, max_covered: float, max_longest: float) -> dict[str, list]:
    out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
    ids: list[int] = []
    bounds = [0]
    number = count()
    for text in texts:
        found = words(text)
        text = text or ""
        ids.extend(map({}.setdefault, found, number))  # a new dict for each text: no word is shared between texts
        ids.append(next(number))
        bounds.append(len(ids))
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        out["n_words"].append(len(found))
        out["word_chars"].append(len(text) - sum(map(text.count, BLANKS)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    lengths = repeat_lengths(np.asarray(ids, np.int64))
    sums = []
    for least in (3, min_span):
        at = np.flatnonzero(lengths >= least)
        sums.append(np.concatenate(([0], np.cumsum(covered(at, lengths[at], len(ids))))))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        n, repeated, spans, longest = out["n_words"][k], int(sums[0][b] - sums[0][a]), int(sums[1][b] - sums[1][a]), int(lengths[a:b].max())
        failed = n < 50 or 100 * repeated > 50 * n
        out["n_repeat_words"].append(repeated)
        out["n_spans_words"].append(spans)
        out["longest_repeat"].append(longest)
        out["base_failed"].append(failed)
        out["kept"].append(not failed and spans <= max_covered * n and not (longest >= min_span and longest > max_longest * n))
    return out


def repetition_rules(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_span: int = 8, max_covered: float = 0.3, max_longest: float = 0.2) -> DataFrame:
    """A row for each document: the base counts, the repeated spans and the verdict `kept`.

    min_span: repeated substrings of fewer words don't count against a text; max_covered: the share
    of words that such spans may cover; max_longest: the share of the words that the longest may have.
    """
    return map_texts(documents.select(id_column, text_column), id_column, text_column, lambda texts: profile(texts, min_span, max_covered, max_longest), SCHEMA)
