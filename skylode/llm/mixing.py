"""Mixing sources to target weights over a curriculum that changes with time.

Each source has a weight schedule, linear in training time t from 0 to 1: it starts at ``ramp[0]`` and ends at
``ramp[1]`` times its mean. Its integral gives the share of the source's tokens that is due by t, W(t) = a t + (b - a)
t^2 / 2. A document whose tokens start at the fraction u of its source's demand is trained on at the t with W(t) = u.
Documents of a source are taken in the order of md5(doc_id), whole passes first, and the last pass ends inside a
document, where the target is met exactly.

Targets: the sources by code point (null last) weigh ``weights`` in turn and share ``budget`` times all sizes; no
target exceeds ``repeats`` times its source's size, the excess being shared again by weight until none does. That is
the level L with sum(min(repeats * size, L * weight)) = budget * all, found from the sources sorted by size / weight.

Cases: null and empty texts have size 0 and are taken 0 times; a null source is a source; repeated rows are documents
of their own, rows that share an id (or have none) come in the order of their sizes; an empty table gives an empty mix; a
text of any length is one row; mix() does not read other columns, resample() keeps all, whatever their names. Scale: a
source's running sum goes over two levels, so a source that holds a third of all rows is split into hash buckets of about
``bucket`` rows; only the table of sources, and for each source its bucket sums, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HUBS, spread_join, stored

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights=(5, 2, 1), budget: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """sources (source, source_size) -> source, source_size, weight, target."""
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sources.select("source", "source_size", w.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("level", F.col("cap") / F.col("weight"))
    up_to, all_of = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))).withColumn("rest", F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))).withColumn("wanted", F.sum("source_size").over(all_of) * F.lit(float(budget)))
    # The level, were this source the first that is not full; of those that their sources can bear the first, and largest, is true.
    t = t.withColumn("at", (F.col("wanted") - F.col("full")) / F.col("rest"))
    level = F.max(F.when(F.col("at") <= F.col("level"), F.col("at"))).over(all_of)
    return t.withColumn("L", level).select("source", "source_size", "weight", F.when(F.col("L").isNull() | (F.col("L") * F.col("weight") > F.col("cap")), F.col("cap")).otherwise(F.col("L") * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weights=(5, 2, 1), budget: float = 1.5, repeats: float = 2.0, ramps=((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)), bucket: int = 2000) -> DataFrame:
    """documents (doc_id, source, text) -> doc_id, source, size, source_size, target, taken, first_at, last_at.

    taken: words that the mix takes, repeats counted. first_at, last_at: when the first and the last pass over the
    document start, as training time from 0 to 1; null if it is not taken. Rows come sorted by first_at over ranges.
    """
    spark = documents.sparkSession
    sized = documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
    sized = stored(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(by_source, weights, budget, repeats)
    n = sized.count()
    buckets = max(1, -(-n // bucket))  # equal shares of the keys, in their order
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(float(1 << 32))).cast("long")
    kept = sized.withColumn("bucket", place).withColumn("slot", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    sums = kept.groupBy("slot", "bucket").agg(F.sum("size").alias("own"))
    w = Window.partitionBy("slot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("slot", "bucket", F.coalesce(F.sum("own").over(w), F.lit(0)).alias("ahead"))
    ranks = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ramp = F.element_at(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in ramps]), (ranks % len(ramps) + 1).cast("int"))
    goal = goal.select("source", "source_size", "target", ramp.alias("ramp"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("slot"))
    sums = sums.join(goal.drop("source"), "slot")
    w = Window.partitionBy("slot", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = kept.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0))).join(sums, ["slot", "bucket"]).withColumn("start", F.col("ahead") + F.col("inside"))
    whole = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    d = d.withColumn("whole", whole).withColumn("passes", passes).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("whole") - F.col("passes") * F.col("source_size") - F.col("start"))))
    d = d.withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    times = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)

    def at(done):
        u, a, b = done / F.col("whole"), F.col("ramp.a"), F.col("ramp.b")
        return F.when(F.col("taken") > 0, F.when(a == b, u / a).otherwise((F.sqrt(a * a + F.lit(2.0) * (b - a) * u) - a) / (b - a)))

    out = d.select("doc_id", "source", "size", "source_size", "target", "taken", at(F.col("start").cast("double")).alias("first_at"), at(((times - 1) * F.col("source_size") + F.col("start")).cast("double")).alias("last_at"))
    return out.orderBy("first_at", "doc_id")


def resample(documents: DataFrame, **how) -> DataFrame:
    """documents as the mix takes them, in training order over ranges; same columns.

    A document comes once for each pass over it; the last pass counts if it takes half of the document or more, so each
    source comes within half a document of its target. Rows that repeat an id are taken alike.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("none"))
    m = mix(documents, **how).where("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size")) + F.when(2 * (F.col("taken") % F.col("size")) >= F.col("size"), 1).otherwise(0)
    m = m.withColumn("copies", copies.cast("int")).where("copies > 0").groupBy(key("doc_id").alias("key")).agg(F.max("copies").alias("copies"), F.min("first_at").alias("first"), F.max("last_at").alias("last"), F.count("*").alias("rows"))
    m = stored(m, "taken")
    share = max(1, (m.agg(F.sum("rows")).first()[0] or 0) // HUBS)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), key("doc_id").alias("key"), F.xxhash64("text").alias("hash"))
    taken = spread_join(rows, m, ["key"], F.col("rows") > share, ["hash"]).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    at = F.when(F.col("copies") == 1, F.col("first")).otherwise(F.col("first") + (F.col("last") - F.col("first")) * (F.col("pass") - 1) / (F.col("copies") - 1))
    return taken.select("row", at.alias("at")).orderBy("at", "row.doc_id").select("row.*")
