"""Sets of word shingles of whole texts, as arrays of 64-bit hashes."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cladeloom.llm.text import LOWER_VALUES, U64, mix, powers, ranges, rows_of, shingle_hash, word_hash, word_spans


@dataclass
class Sets:
    """Distinct shingles of each row, sorted: row i has hashes[edges[i]:edges[i + 1]]. first and second are
    a 128-bit digest of the set."""

    hashes: np.ndarray
    edges: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.edges)


def sort_rows(values: np.ndarray, edges: np.ndarray) -> None:
    """Sorts each row's values in place."""
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5, seed: int = 0) -> Sets:
    """Words are maximal runs without ASCII white space, A-Z lowered; a row with fewer than `width` words, but
    not none, has its whole sequence as the one shingle."""
    starts, ends, first = word_spans(buf, offsets)
    codes = word_hash(buf, starts, ends, LOWER_VALUES)
    words = np.diff(first)
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    row = rows_of(n)
    at = first[:-1][row] + ranges(n)
    whole = words[row] >= width
    h = np.zeros(len(at), U64)
    h[whole] = shingle_hash(codes, width)[at[whole]]
    up = powers(width + 2)[0]
    for j in range(width - 1):  # short rows
        of = ~whole & (words[row] > j)
        h[of] += codes[at[of] + j] * up[j + 1]
    h[~whole] = mix(h[~whole] + words[row[~whole]].astype(U64))
    edges = np.concatenate([[0], np.cumsum(n)])
    sort_rows(h, edges)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h = h[new]
    edges = np.concatenate([[0], np.cumsum(new)])[edges]
    sizes = np.diff(edges)
    digest = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))))])
        digest.append(mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(U64)))
    return Sets(h, edges, *digest)
