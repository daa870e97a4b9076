"""BM25 as Column expressions. Lengths are kept in one byte by default; norms='exact' uses true lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def norm(length: Column) -> Column:
    """A length in one byte: floor(127 / sqrt(length)), 127 at most; 127 for an empty field."""
    return F.when(length <= 0, F.lit(127)).otherwise(F.least(F.lit(127), F.floor(127 / F.sqrt(length.cast("double"))))).cast("int")


def decoded(byte: Column) -> Column:
    """The length that a norm stands for; 0 (longer than 16,129) and 127 both stand for 1."""
    return F.when((byte == 0) | (byte == 127), F.lit(1.0)).otherwise(F.pow(F.lit(127.0) / byte, F.lit(2.0)))


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25(freq: Column, length: Column, df: Column, n: Column, average: Column, k1: float = K1, b: float = B, norms: str = "quantized") -> Column:
    """idf * f / (f + k1 (1 - b + b length / average)); no (k1 + 1) above."""
    own = decoded(norm(length)) if norms == "quantized" else length.cast("double")
    return idf(df, n) * freq / (freq + k1 * ((1 - b) + b * own / average))


def tf_idf(freq: Column, df: Column, n: Column) -> Column:
    """Extension: tf times idf."""
    return freq * idf(df, n)


def rank_features(values: dict[str, tuple[Column, float]], pivot: float | None = None) -> Column:
    """Extension: the sum of weight times feature over features (name -> column, weight); a missing or negative one adds 0.

    pivot: features saturate, x / (x + pivot).
    """
    out = F.lit(0.0)
    for x, weight in values.values():
        x = F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))
        out = out + F.lit(float(weight)) * (x / (x + F.lit(float(pivot))) if pivot else x)
    return out
