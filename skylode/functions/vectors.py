"""Sparse vectors as array<struct<i int, w double>>, sorted by i, without zeros; all functions are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE = "array<struct<i:int,w:double>>"


def sparse(entries: Column) -> Column:
    """Sorted, zeros dropped; of entries with one index the last counts."""
    kept = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["i"])), lambda i: F.struct(i.alias("i"), F.element_at(F.filter(entries, lambda e: e["i"] == i), -1)["w"].cast("double").alias("w"))))
    return F.array_sort(F.filter(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("w"))), lambda e: e["w"] != 0)).cast(SPARSE)


def from_dense(dense: Column, threshold: float = 0.0) -> Column:
    """Components strictly above the threshold, by their place from 0."""
    every = F.transform(dense, lambda x, i: F.struct(i.cast("int").alias("i"), x.cast("double").alias("w")))
    return F.filter(every, lambda e: e["w"] > threshold).cast(SPARSE)


def to_dense(v: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: get(v, i))


def get(v: Column, index: Column) -> Column:
    return F.coalesce(F.get(F.filter(v, lambda e: e["i"] == index), F.lit(0))["w"], F.lit(0.0))


def contains(v: Column, index: Column) -> Column:
    return F.exists(v, lambda e: e["i"] == index)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, e: a + e["w"])


def l1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, e: a + F.abs(e["w"]))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))


def dot(a: Column, b: Column) -> Column:
    """Through a map of b, so in the length of both."""
    m = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.element_at(m, e["i"]), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def _by_weight(v: Column) -> Column:
    """By absolute weight, largest first, then index."""
    keyed = F.array_sort(F.transform(v, lambda e: F.struct((-F.abs(e["w"])).alias("k"), e["i"].alias("i"), e["w"].alias("w"))))
    return keyed


def prune_top_k(v: Column, k: int) -> Column:
    return F.array_sort(F.transform(F.slice(_by_weight(v), 1, k), lambda e: F.struct(e["i"].alias("i"), e["w"].alias("w")))).cast(SPARSE)


def prune_threshold(v: Column, least: Column) -> Column:
    return F.filter(v, lambda e: F.abs(e["w"]) >= least)


def prune_mass(v: Column, alpha: float) -> Column:
    """The heaviest entries that hold alpha of all absolute weight, and those that tie with the last of them."""
    if alpha >= 1:
        return v
    goal = l1(v) * alpha
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0.0).alias("least"))

    def step(acc, e):
        done = (acc["mass"] >= goal) & (acc["least"] > 0)
        return F.struct(F.when(done, acc["mass"]).otherwise(acc["mass"] - e["k"]).alias("mass"), F.when(done, acc["least"]).otherwise(-e["k"]).alias("least"))

    return prune_threshold(v, F.aggregate(_by_weight(v), start, step, lambda acc: acc["least"]))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda e: F.struct(e["i"].alias("i"), (e["w"] * by).alias("w"))).cast(SPARSE)


def normalize(v: Column) -> Column:
    return F.when(norm(v) > 0, scale(v, F.lit(1.0) / norm(v))).otherwise(v)
