"""Substring dedup over words, by a compressed FM-index a shard."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from specloom.llm.passages import Passages, without_repeats
from specloom.llm.symbols import offsets, window_hash, words_of


#: Masks of the lowest 0 ... 63 bits.
LOW_BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit string in 64-bit words with the ones before each word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        low = self.words.take(word)
        low &= LOW_BITS.take(i & 63)
        ones = self.before.take(word)
        ones += np.bitwise_count(low)
        return ones


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and canonical code of each symbol: frequent symbols have short codes.

    What weighs no more than the two lightest together is paired before any new node, so all of it is at once. The least weight
    doubles in two rounds at most, which makes rounds as many as the logarithm of the text.
    """
    node = np.argsort(counts, kind="stable")
    weight, fresh, rounds = counts[node], len(counts), []
    while len(node) > 1:
        k = int(np.searchsorted(weight, weight[0] + weight[1], side="right")) // 2 * 2
        new = np.arange(fresh, fresh + k // 2)
        rounds.append((node[:k], np.repeat(new, 2)))
        weight, node = np.concatenate((weight[k:], weight[0:k:2] + weight[1:k:2])), np.concatenate((node[k:], new))
        order = np.argsort(weight, kind="stable")
        weight, node, fresh = weight[order], node[order], fresh + k // 2
    depth = np.zeros(fresh, np.int64)
    for children, parents in reversed(rounds):
        depth[children] = depth[parents] + 1
    lengths = np.maximum(depth[: len(counts)], 1)
    # the first code of a length follows the last one of the length before
    each, first = np.bincount(lengths), np.zeros(int(lengths.max()) + 1, np.int64)
    for n in range(1, len(first)):
        first[n] = (first[n - 1] + each[n - 1]) << 1
    order = np.argsort(lengths, kind="stable")
    codes = np.empty(len(counts), np.int64)
    codes[order] = first[lengths[order]] + np.arange(len(counts)) - offsets(each)[lengths[order]]
    return lengths, codes


class WaveletTree:
    """Rank of any symbol of a text. The tree has the shape of the symbols' Huffman code, so its bits are the text's entropy
    (and one bit a symbol at most); a level holds the bits of its nodes one after another."""

    def __init__(self, text: np.ndarray, counts: np.ndarray):
        self.lengths, codes = huffman(counts)
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray, np.ndarray]] = []
        prefix = np.zeros(len(text), np.int64)
        for level in range(int(self.lengths.max())):
            # a node's symbols keep the text's order
            keep = self.lengths[text] > level
            text = text[keep]
            prefix = codes[text] >> (self.lengths[text] - level)
            order = np.argsort(prefix * len(prefix) + np.arange(len(prefix)))
            text, prefix = text[order], prefix[order]
            bits = Bits(((codes[text] >> (self.lengths[text] - 1 - level)) & 1).astype(np.uint8))
            # of each symbol that goes deeper: where its node starts, the ones before that, and -1 if its own bit is zero, else 0
            deep = np.maximum(self.lengths - level, 0)
            start = np.searchsorted(prefix, codes >> deep).astype(np.int64)
            zeros = ((codes >> np.maximum(deep - 1, 0)) & 1) - 1
            self.levels.append((bits, start, bits.ones(start), zeros))

    def rank(self, symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each row of `ends`, how often each symbol comes among the first so many."""
        order = np.argsort(-self.lengths[symbol])  # those of long codes first, so that a level takes the front
        symbol, places = symbol[order], ends[:, order]
        deeper = np.cumsum(np.bincount(self.lengths[symbol], minlength=len(self.levels) + 1)[::-1])[::-1]
        for level, (bits, start, before, zeros) in enumerate(self.levels):
            s = symbol[: deeper[level + 1]]
            i = places[:, : len(s)]
            ones = bits.ones(start.take(s) + i)
            ones -= before.take(s)
            # where the own bit is one, the ones, else what is left of i without them: x ^ -1 is -x - 1
            zero = zeros.take(s)
            i &= zero
            i += (ones ^ zero) - zero
        out = np.empty_like(places)
        out[:, order] = places
        return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols or more, by doubling. Deeper ties don't matter to patterns of that length."""
    rank, length = text.astype(np.int64), 1
    order = np.argsort(rank)
    while length < depth:
        nxt = np.zeros(len(rank), np.int64)
        nxt[: len(rank) - length] = rank[length:] + 1
        pair = rank * (len(rank) + 3) + nxt
        order = np.argsort(pair)
        sorted_ = pair[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
        length *= 2
    return order


class FmIndex:
    """Backward search over texts that are joined by a separator, and the owner of each suffix in order."""

    def __init__(self, text: np.ndarray, owners: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        counts = np.bincount(text)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.tree = WaveletTree(text[order - 1], counts)
        self.owners = owners[order]

    def first_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least owner among suffixes low to high, high excluded. Ranges are equal or apart, so all together are no longer than the text."""
        at, back = np.unique(low, return_index=True, return_inverse=True)[1:]
        cuts = np.stack((low[at], high[at]), axis=1).ravel()
        return np.minimum.reduceat(np.append(self.owners, np.iinfo(np.int64).max), cuts)[::2][back]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position how far back from it, `length` at most, the text matches the index elsewhere than at itself, and the
        suffixes that begin with that match."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64)
        out, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(length):
            symbol = text[ends[live] - step]
            a, b = self.below[symbol], self.below[symbol + 1]
            if step:  # all suffixes that begin with the symbol, at first
                a, b = a + self.tree.rank(symbol, np.stack((low[live], high[live])))
            again = b - a > 1  # what comes once is the text itself
            live, a, b = live[again], a[again], b[again]
            low[live], high[live] = a, b
            out[live] += 1
        return out, low, high


def search(units: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """The least owner of each window of the texts of a shard, which stand one after another in `units`: each distinct text is streamed
    against the index of all, and intervals of matches of `length` are reported with the least owner; other windows are their own text's alone."""
    flat = np.unique(units, return_inverse=True)[1] + 1
    text = np.zeros(len(units) + len(sizes), np.int64)
    text[np.arange(len(units)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
    index = FmIndex(text, np.repeat(owners, sizes + 1), length)
    # texts that are equal symbol by symbol are found alike, so the first of them is streamed
    cuts, seen = offsets(sizes).tolist(), {}
    same = np.array([seen.setdefault(units[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], np.int64)
    asked = np.flatnonzero(same == np.arange(len(sizes)))
    n = sizes - length + 1
    place = offsets(n[asked])
    ends = np.arange(place[-1]) + np.repeat(offsets(sizes + 1)[asked] + length - 1 - place[:-1], n[asked])
    matched, low, high = index.matching_statistics(text, ends, length)
    found, least = matched >= length, np.zeros(len(ends), np.int64)
    if found.any():
        least[found] = index.first_owner(low[found], high[found])
    at = np.arange(n.sum()) + np.repeat(place[np.searchsorted(asked, same)] - offsets(n)[:-1], n)
    return np.where(found[at], least[at], np.repeat(owners, n))


WORDS = Passages(length=13, gram=5, symbols=words_of, grams=window_hash, numbers=np.asarray, unit=np.uint64, search=search, part_bytes=1 << 17)


def kept_words(raw: list[bytes], symbols: np.ndarray, counts: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
    at = offsets(counts)
    out = []
    for i, text in enumerate(raw):
        gone, kept = mask[at[i] : at[i + 1]], text.split()
        if gone.any():
            kept = compress(kept, (~gone).tolist())
        out.append((int(counts[i]), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])


def dedup_words(docs: DataFrame, p: Passages = WORDS) -> DataFrame:
    """One row a document: its words, those removed, and the hash of what is left.

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id.
    Null and empty texts have no words. Documents without doc_id have no place in the order: they lose and take
    nothing. Rows of one doc_id don't take from each other; equal rows are all returned. Columns besides
    doc_id and text are not read. An empty table gives no rows.
    """
    return without_repeats(docs, p, kept_words, "doc_id long, n_words long, n_removed long, kept_sha256 string", "fmindex")
