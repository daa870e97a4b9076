"""What several operators share: reading of tables, batches, packed texts, joins that spread hot keys, and connected
components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, shared_folder, stored  # noqa: F401

#: Rows per Arrow batch for operators that take whole texts: with texts of a megabyte a batch stays near 256 MB.
TEXT_BATCH = 256

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: list[str], name: str) -> str:
    """name, or a longer one, that none of names is."""
    while name.lower() in (n.lower() for n in names):
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bounds the Arrow batches of whole texts that the Python workers get, until a query sets another size: plans run after
    the query that made them has returned, so there is no point at which to set it back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a text column as compressed bytes, null staying null: half as much for a shuffle to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            z = pa.array([None if t is None else own.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], z, *batch.columns[at + 1 :]], names=batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in df.schema]))


def unpack(z: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def unpacked(df: DataFrame, column: str = "text") -> DataFrame:
    """What packed() had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            t = pa.array([None if z is None else unpack(z).decode() for z in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], t, *batch.columns[at + 1 :]], names=batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == column else f.dataType) for f in df.schema]))


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: str = "8m"):
    """Within it, plans that run give the Python workers Arrow batches of up to so many rows and bytes."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


HUBS = 500


def to_least(e: DataFrame, n: int) -> DataFrame:
    """e (a, b, ...) with m, the smallest b of each a. n: the rows of e.

    An a with more than n / HUBS rows is a hub. There are fewer than HUBS of them, so they are broadcast and their rows
    stay where they are; all others meet their m in a join by a, in which no key has more rows than that.
    """
    m = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n"))
    hub = F.col("__n") > max(1, n // HUBS)
    hubs = F.broadcast(m.where(hub).select("a", "m"))
    rest = e.join(F.broadcast(m.where(hub).select("a")), "a", "left_anti").join(m.where(~hub).select("a", "m"), "a")
    return rest.unionByName(e.join(hubs, "a"))


SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hub, by: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), where right has one row a key and the condition hub holds for fewer than HUBS of them:
    those that have a large share of left's rows. These are dealt into SALTS parts by the columns ``by`` of left."""
    hubs = F.broadcast(right.where(hub).select(*keys, F.lit(True).alias("__hub")))
    salt = F.when(F.col("__hub"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int").alias("__salt")
    dealt = left.join(hubs, keys, "left").select(*left.columns, salt)
    every = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(hub, SALTS - 1).otherwise(0))))
    return dealt.join(every, [*keys, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long), by alternating large-star and small-star steps.

    Returns (id, component) for every id in an edge, component being the smallest id that is reachable. Each step
    joins every vertex only to the smallest of its neighbours, so no step emits pairs within a group, and the minimum
    is a partial aggregate, so a hub is combined before the shuffle. Each step is written to the shared folder; rounds
    go on until one changes nothing, which takes of the order of log^2 of the ids.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    while True:
        # Large star: every larger neighbour goes to the smallest id around.
        old = e
        e = stored(to_least(both(e), 2 * now[0]).select("a", "b", F.least("a", "m").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        # Small star: every smaller neighbour, and the vertex, go to the smallest one.
        star = e
        e = stored(to_least(e, now[0]).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        discard(old, star)
        last, now = now, e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == last:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
