"""Importing text-encoded vectors and hashes as native columns."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

WORD_DIGITS = 16


def half_vector(c: Column, size: int | None = None) -> Column:
    """Base64 of 16-bit floats -> ``ARRAY<FLOAT>``; null when broken or of another size."""
    def run(raw: pd.Series) -> pd.Series:
        def one(data):
            if data is None or len(data) == 0 or len(data) % 2:
                return None
            vec = np.frombuffer(data, dtype="<f2").astype(np.float32)
            return vec if size is None or vec.size == size else None
        return raw.map(one)

    return F.pandas_udf(run, "array<float>")(F.try_to_binary(c, F.lit("base64")))


def hex_words(c: Column, words: int) -> Column:
    """Hexadecimal number -> that many 64-bit words, highest first; null when broken."""
    padded = F.lpad(c, words * WORD_DIGITS, "0")
    parts = [F.conv(F.substring(padded, i * WORD_DIGITS + 1, WORD_DIGITS), 16, -10).cast("bigint") for i in range(words)]
    return F.when(c.rlike("^[0-9a-fA-F]+$"), F.array(*parts))


def hex_long(c: Column) -> Column:
    return F.when(c.rlike("^[0-9a-fA-F]+$"), F.conv(c, 16, -10).cast("bigint"))
