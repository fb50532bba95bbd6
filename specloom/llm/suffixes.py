"""Suffix-array dedup over bytes, by the difference-cover algorithm a shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from specloom.llm.passages import Passages, without_repeats
from specloom.llm.symbols import BYTE, byte_grams, eights, offsets


def packed(high: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """One number for each pair, in the pairs' order; low < size."""
    if int(high.max(initial=0)) * size < 2**62:
        return high * size + low
    return np.unique(high, return_inverse=True)[1] * size + low


def order_of(key: np.ndarray) -> np.ndarray:
    """The order of numbers from 0 on; where there is room for the place beside the number, plain sorting gives it sooner."""
    bits = max(1, len(key) - 1).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 62:
        return np.argsort(key)
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)


def named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and their numbers from 1 on in that order, equal ones for equal keys."""
    order = order_of(key)
    ranked = key[order]
    steps = np.ones(len(key), np.int64)
    np.cumsum(ranked[1:] != ranked[:-1], out=steps[1:])
    steps[1:] += 1
    return order, steps


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of a text of positive numbers, or those where the mask `wanted` is set, in order of their first `depth` symbols at least.

    Positions 1 and 2 modulo 3 are the difference cover: their triples are sorted and named, and unless the
    names tell all apart or reach `depth`, the text of names is sorted by recursion. Any two suffixes then compare by
    at most two symbols and the rank of covered ones, which sorts and merges the rest.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted((i for i in range(n) if wanted is None or wanted[i]), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 5, np.int64)
    t[:n] = text
    size = int(t.max()) + 1
    # positions of one kind are slices: kind 1, where a triple of zeros may end them, before kind 2
    ones, twos = len(range(1, n + (n % 3 == 1), 3)), len(range(2, n, 3))

    def symbols(deep: int) -> np.ndarray:
        return np.concatenate((t[1 + deep :: 3][:ones], t[2 + deep :: 3][:twos]))

    pair = packed(symbols(0), symbols(1), size)
    if size**3 * len(pair) > 2**60:  # names of pairs are shorter
        order, steps = named(pair)
        pair = np.empty_like(pair)
        pair[order] = steps
    order, steps = named(packed(pair, symbols(2), size))
    need = None
    if wanted is not None:  # ranks are asked for at the wanted positions, and one or two behind
        near = np.zeros(n + 5, bool)
        near[:n] = wanted
        near[1 : n + 1] |= wanted
        near[2 : n + 2] |= wanted
        need = np.concatenate((near[1::3][:ones], near[2::3][:twos]))
    if depth > 3 and steps[-1] < len(order):
        names = np.empty(len(order), np.int64)
        names[order] = steps
        order = suffix_array(names, -(-depth // 3), need)
    elif need is not None:
        order = order[need[order]]
    two = order >= ones
    covered = 3 * order + np.where(two, 2 - 3 * ones, 1)
    rank = np.zeros(n + 5, np.int64)
    rank[covered] = np.arange(1, len(order) + 1)
    keep = covered < n
    rest = np.arange(0, n, 3)
    if wanted is not None:  # the others have served as ranks
        keep[keep] = wanted[covered[keep]]
        rest = rest[wanted[::3]]
    covered, two = covered[keep], two[keep]
    m = len(order) + 2
    rest = rest[order_of(packed(t[rest], rank[rest + 1], m))]
    # merge: how many covered suffixes of each kind lie before each of the rest
    before = np.zeros(len(rest), np.int64)
    for deep, of in ((1, covered[~two]), (2, covered[two])):
        joint = np.concatenate((of, rest))
        head = t[joint] if deep == 1 else packed(t[joint], t[joint + 1], size)
        key = packed(head, rank[joint + deep], m)
        # where order is only known to `depth`, keys may fall among those that are alike that far
        before += np.searchsorted(np.maximum.accumulate(key[: len(of)]), key[len(of) :])
    before = np.maximum.accumulate(before)
    out = np.empty(len(covered) + len(rest), np.int64)
    places = np.arange(len(rest)) + before
    mask = np.ones(len(out), bool)
    mask[places] = False
    out[places] = rest
    out[mask] = covered
    return out


def search(units: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """The least owner of each window of the texts of a shard, which stand one after another in `units`.

    In the order of suffixes, equal windows are neighbours: adjacent prefixes are compared, eight bytes at a time.
    """
    n = sizes - length + 1
    base, first = offsets(sizes)[:-1], offsets(n)
    begins = np.arange(first[-1]) + np.repeat(base - first[:-1], n)  # of windows in `units`
    wanted = np.zeros(len(units), bool)
    wanted[begins] = True
    # a window ends with its text at the latest, so what comes after a text decides nothing
    at = suffix_array(units.astype(np.int64) + 1, length + 2, wanted)
    eight = eights(units)
    new = np.zeros(len(at), bool)
    new[:1] = True
    for i in [*range(0, length - 7, 8), length - 8]:
        there = eight[at + i]
        new[1:] |= there[1:] != there[:-1]
    least = np.minimum.reduceat(np.repeat(owners, sizes)[at], np.flatnonzero(new))
    found = np.empty(len(units), np.int64)
    found[at] = least[np.cumsum(new) - 1]
    return found[begins]


def bytes_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


BYTES = Passages(length=50, gram=20, symbols=bytes_of, grams=byte_grams, numbers=BYTE.take, unit=np.uint8, search=search)


def kept_bytes(raw: list[bytes], symbols: np.ndarray, counts: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
    at = offsets(counts)
    out = []
    for i, text in enumerate(raw):
        gone = mask[at[i] : at[i + 1]]
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
        runs = int((gone[1:] & ~gone[:-1]).sum()) + int(bool(len(gone)) and bool(gone[0]))
        out.append((len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_bytes(docs: DataFrame, p: Passages = BYTES) -> DataFrame:
    """One row a document: its bytes, those removed, in how many spans, and the hash of what is left.

    A byte goes if a string of 50 bytes over it also starts in a document with a smaller doc_id.
    Null and empty texts have no bytes. Documents without doc_id have no place in the order: they lose and take
    nothing. Rows of one doc_id don't take from each other; equal rows are all returned. Columns besides
    doc_id and text are not read. An empty table gives no rows.
    """
    return without_repeats(docs, p, kept_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "suffixes")
