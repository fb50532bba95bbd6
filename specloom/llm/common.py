"""What the operators of this subpackage share.

Words are runs of anything but ASCII white space, `WORD`. `bytes.split()` of the UTF-8 form cuts at
the same places, which is what the Python stages use.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from specloom.functions.scratch import Scratch, block_offsets, ranged

__all__ = ["WORD", "Scratch", "block_offsets", "n_words", "ranged", "whole_numbers", "without_null"]

#: The word of every contract, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def without_null(name: str) -> list[F.Column]:
    """A column of whole numbers, null as 0, and `_none`, whether it was null: beside a null, pandas makes floats of all numbers, which round those over 2**53."""
    return [F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name), F.col(name).isNull().alias("_none")]


def whole_numbers(numbers: pd.Series, none: pd.Series) -> pd.arrays.IntegerArray:
    """The column that `without_null` took apart."""
    return pd.arrays.IntegerArray(numbers.to_numpy(np.int64), none.to_numpy(bool))
