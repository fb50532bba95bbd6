"""Quality rules: simple counts, then bands of zstandard ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from specloom.llm.symbols import batches, repeated, window_hash, words_of


@dataclass(frozen=True)
class Bands:
    """Limits of the compressed share of a text, by its length in bytes.

    whole: (least bytes, lowest ratio, highest ratio); the last row that a text reaches counts. Short
    texts compress badly whatever they say, so their band is wide. chunk: the same for every fixed
    chunk; a text goes if more than `share` of its chunks lie outside. A tail of under half a chunk
    is judged with the chunk before it.
    """

    level: int = 3
    whole: tuple = ((0, 0.30, 2.0), (256, 0.30, 0.95), (1024, 0.28, 0.85), (4096, 0.25, 0.80), (16384, 0.20, 0.75))
    chunk_bytes: int = 4096
    chunk: tuple = (0.22, 0.80)
    share: float = 0.25


def verdict(text: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of chunks out of band, and whether the text stays. Nothing: (1, 0, True)."""
    if not text:
        return 1.0, 0.0, True
    whole = len(pack.compress(text)) / len(text)
    _, low, high = [b for b in bands.whole if len(text) >= b[0]][-1]
    n = max(1, (len(text) + bands.chunk_bytes // 2) // bands.chunk_bytes)
    out = 0
    if n > 1:
        for i in range(n):
            part = text[i * bands.chunk_bytes : (i + 1) * bands.chunk_bytes if i < n - 1 else len(text)]
            out += not bands.chunk[0] <= len(pack.compress(part)) / len(part) <= bands.chunk[1]
    share = out / n
    return whole, share, low <= whole <= high and share <= bands.share


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_chunks double"
#: Fixed values of the contract.
SYMBOLS, BLANKS, WINDOW, MIN_WORDS, REPEAT_PERCENT = "#*$%&|<>", " \t\n\x0b\x0c\r", 8, 20, 30


def measure(texts: list[str | None], bands: Bands, pack) -> pd.DataFrame:
    raw = [(t or "").encode() for t in texts]
    words, counts = words_of(raw)
    repeats = repeated(window_hash(words, WINDOW), counts, WINDOW)
    out = []
    for text, b, n, n_repeat in zip(texts, raw, counts.tolist(), repeats.tolist(), strict=True):
        text = text or ""
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        ratio, odd, good = verdict(b, bands, pack)
        failed = n < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n
        out.append((n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, failed, good and not failed, ratio, odd))
    return pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_chunks"])


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:  # noqa: B008
    """One row a document: its counts, `base_failed`, `kept`, and the ratios behind the verdict.

    A null or empty text has no words and fails. Repeated rows are judged each. Only doc_id and text
    are read, so other columns may have any name. An empty table gives no rows. Rows keep their
    partitions: no shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for frame in frames:
            for part in batches(frame):
                out = measure(part["text"].tolist(), bands, pack)
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:  # noqa: B008
    """The rows of docs that `quality` keeps, with all their columns and in their partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for frame in frames:
            for part in batches(frame):
                yield part[measure(part["text"].tolist(), bands, pack)["kept"].to_numpy(bool)]

    return docs.mapInPandas(run, docs.schema)
