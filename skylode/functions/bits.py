"""Bit sets as array<long>, 64 bits a word, as Column expressions. A set may be shorter than its highest bit asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<bigint>"


def _word(bits: Column, w: Column) -> Column:
    return F.coalesce(F.get(bits, w.cast("int")), F.lit(0).cast("long"))


def _mask(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def of(positions: Column) -> Column:
    """The set of an array of positions from 0 on; nulls count for nothing."""
    at = F.filter(positions, lambda p: p.isNotNull())
    words = F.when(F.size(at) > 0, F.floor(F.array_max(at) / 64) + 1).otherwise(0).cast("int")
    every = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda w: F.aggregate(F.filter(at, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(_mask(p)))
    return F.transform(every, own).cast(EMPTY)


def positions(bits: Column) -> Column:
    """array<long>: the positions that are set, ascending."""
    each = F.transform(bits, lambda x, w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(x.bitwiseAND(_mask(b)) != 0, w.cast("long") * 64 + b)), lambda p: p.isNotNull()))
    return F.flatten(each)


def get(bits: Column, at: Column) -> Column:
    return _word(bits, F.floor(at / 64)).bitwiseAND(_mask(at)) != 0


def _with(bits: Column, at: Column, f) -> Column:
    w = F.floor(at / 64).cast("int")
    grown = F.concat(bits, F.array_repeat(F.lit(0).cast("long"), F.greatest(w + 1 - F.size(bits), F.lit(0))))
    return F.transform(grown, lambda x, i: F.when(i == w, f(x, _mask(at))).otherwise(x))


def put(bits: Column, at: Column) -> Column:
    return _with(bits, at, lambda x, m: x.bitwiseOR(m))


def clear(bits: Column, at: Column) -> Column:
    return _with(bits, at, lambda x, m: x.bitwiseAND(F.bitwise_not(m)))


def flip(bits: Column, at: Column) -> Column:
    return _with(bits, at, lambda x, m: x.bitwiseXOR(m))


def _each(a: Column, b: Column, f) -> Column:
    zero = F.lit(0).cast("long")
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def union(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseOR(y))


def intersection(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseAND(y))


def difference(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def symmetric_difference(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseXOR(y))


def cardinality(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda a, x: a + F.bit_count(x))


def intersects(a: Column, b: Column) -> Column:
    return cardinality(intersection(a, b)) > 0


def next_set(bits: Column, start: Column) -> Column:
    """The first set position from start on, null if there is none."""
    return F.array_min(F.filter(positions(bits), lambda p: p >= start))


def previous_set(bits: Column, start: Column) -> Column:
    """The last set position up to start, null if there is none."""
    return F.array_max(F.filter(positions(bits), lambda p: p <= start))
