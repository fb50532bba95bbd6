"""Texts as arrays of 64-bit symbols, many documents at a time.

A word's symbol is a hash of its bytes, a byte's symbol a fixed random number. Windows hash their
symbols by doubling. All arithmetic is modulo 2**64 on uint64 arrays; two different windows of a
corpus of 2**40 windows share a hash with a chance of about 2**-24 in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random number for each byte value, a large odd multiplier and its powers' inverse.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
MUL = U(0x9E3779B97F4A7C15)
INV = U(pow(int(MUL), -1, 2**64))
CHUNK_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def batches(frame: pd.DataFrame, limit: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """Slices of a batch with about `limit` characters of text each, one row at least."""
    if not len(frame):
        return
    sizes = frame["text"].str.len().fillna(0).to_numpy(np.int64) + 16
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for part in np.split(np.arange(len(frame)), cuts):
        yield frame.iloc[part[0] : part[-1] + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1); a task keeps those of a usual part of a batch."""
    if n > 4 * CHUNK_BYTES:
        return powers_to(base, n)
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = _powers[int(base)] = powers_to(base, max(n, CHUNK_BYTES))
    return kept[:n]


def powers_to(base: np.uint64, n: int) -> np.ndarray:
    """The same by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        top = U(int(out[done - 1]) * int(base) % 2**64)
        out[done : done + step] = out[:step] * top
        done += step
    return out[:n]


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def word_spans(buffer: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the joined bytes, and the words of each document.

    docs: offsets of the documents in the buffer, which has one blank after each document.
    """
    blank = BLANK[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.diff(np.searchsorted(starts, docs))


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes with a space after each, and their offsets."""
    buffer = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8)
    return buffer, offsets(np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw)))


def words_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in order, and the number of words of each document."""
    buffer, docs = joined(raw)
    starts, ends, counts = word_spans(buffer, docs)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    # sum of BYTE[b_j] * MUL**j over a word, divided by MUL**start
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTE[buffer] * powers(MUL, len(buffer)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INV, len(buffer))[starts] + (ends - starts).astype(np.uint64)), counts


def window_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position on; the last k-1 positions mean nothing."""
    n = len(symbols)
    out = np.zeros(n, np.uint64)
    if n >= k:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(MUL, n), out=sums[1:])
        out[: n - k + 1] = mix((sums[k:] - sums[:-k]) * powers(INV, n)[: n - k + 1] + U(k))
    return out


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each position on; the last w-1 positions have none."""
    length = 1
    while length < w:
        step = min(length, w - length)
        values = np.minimum(values[: max(0, len(values) - step)], values[step:])
        length += step
    return values


def byte_grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, 8 at least, from eight bytes at a time; the last k-1 places have none."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = eights(units)
    out = eight[:n] * BYTE[0]
    for j, i in enumerate([*range(8, k - 7, 8), *[k - 8] * (k % 8 > 0)], 1):
        out += eight[i : i + n] * BYTE[j]
    out ^= out >> U(32)
    out *= MUL
    out ^= out >> U(32)
    out *= MUL
    return out


def eights(units: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the last seven places have none."""
    return np.ascontiguousarray(np.ndarray((max(0, len(units) - 7),), "<u8", np.ascontiguousarray(units), 0, (1,)))


def starts_of_windows(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of k lies within its document, and the number of the document of each."""
    first = offsets(counts)[:-1]
    n = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    return np.arange(n.sum()) - np.repeat(offsets(n)[:-1] - first, n), doc


def covered(starts: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask of the positions that some window of k from `starts` covers."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated(hashes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each document, the symbols in windows of k that it holds twice or more."""
    at, doc = starts_of_windows(counts, k)
    if not len(at):
        return np.zeros(len(counts), np.int64)
    own = hashes[at] ^ mix(doc.astype(np.uint64) + U(1))
    order = np.argsort(own, kind="stable")
    own = own[order]
    same = own[1:] == own[:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    mask = covered(at[order[twice]], k, int(counts.sum()))
    return np.add.reduceat(np.concatenate((mask, [False])).astype(np.int64), offsets(counts)[:-1]) * (counts > 0)
