"""Top-k search over sparse vectors: exact, over quantised blocks, and approximate with exact reranking.

vectors: (doc_id, v array<struct<i, w>>). The query is a dict; it goes into the plan as a map literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import running


def _literal(query: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for i, w in sorted(query.items()) for x in (int(i), float(w))])


def entries(vectors: DataFrame, query: dict[int, float]) -> DataFrame:
    """(doc_id, i, w) of the entries whose index the query has."""
    return vectors.select("doc_id", F.explode(F.filter("v", lambda e: e["i"].isin(list(query)))).alias("e")).select("doc_id", "e.i", "e.w")


def _none(vectors: DataFrame, k: int, query: dict) -> DataFrame | None:
    return vectors.select("doc_id", F.lit(0.0).alias("score")).limit(0) if k <= 0 or not query else None


def exact_scores(vectors: DataFrame, query: dict[int, float]) -> DataFrame:
    """A sum in each row, without explode or shuffle."""
    q = _literal(query)
    score = F.aggregate(F.filter("v", lambda e: e["i"].isin(list(query))), F.lit(0.0), lambda a, e: a + e["w"] * F.element_at(q, e["i"]))
    return vectors.select("doc_id", score.alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.where("score > 0").orderBy(F.round("score", 6).desc(), "doc_id").limit(k)


def search(vectors: DataFrame, query: dict[int, float], k: int) -> DataFrame:
    """Exact: the k best sums above 0, ties to the smaller id."""
    none = _none(vectors, k, query)
    return none if none is not None else top(exact_scores(vectors, query), k)


def bins(vectors: DataFrame, n: int) -> DataFrame:
    """(bin, value, low, high): equal-frequency bins of all positive weights; value is a bin's mean weight.

    Ranks come from counts of distinct weights, so the sort is over these and not over all entries.
    """
    w = vectors.select(F.explode("v").alias("e")).select(F.col("e.w").alias("w")).where("w > 0").groupBy("w").agg(F.count("*").alias("c"))
    every = w.agg(F.sum("c").alias("all"))
    w = running(w, "w", F.col("c"), "before").withColumn("upto", F.col("before") + F.col("c")).crossJoin(F.broadcast(every))  # one row
    per = F.greatest(F.floor(F.col("all") / n), F.lit(1))
    w = w.withColumn("bin", F.least(F.floor((F.col("upto") - 1) / per), F.lit(n - 1)).cast("int"))
    return w.groupBy("bin").agg((F.sum(F.col("w") * F.col("c")) / F.sum("c")).alias("value"), F.min("w").alias("low"), F.max("w").alias("high"))


def quantised(vectors: DataFrame, query: dict[int, float], k: int, n: int = 16, mode: str = "alpha_mass", alpha: float = 0.3, blocks: int = 10) -> DataFrame:
    """Approximate: each (index, bin) is a block that gains its bin's value times the query weight; only chosen blocks count.

    mode alpha_mass: the best blocks up to alpha of all gains; max_ratio: those at alpha of the best or more; top_k: the
    best ``blocks``. A document's score is the sum of its chosen blocks' gains.
    """
    none = _none(vectors, k, query)
    if none is not None:
        return none
    b = F.broadcast(bins(vectors, n))  # n rows
    own = entries(vectors, query).where("w > 0").join(b, F.col("w").between(F.col("low"), F.col("high"))).select("doc_id", "i", "bin", "value")
    gain = F.col("value") * F.element_at(_literal(query), F.col("i"))
    made = own.groupBy("i", "bin").agg(F.first("value").alias("value")).withColumn("gain", gain)
    order = Window.orderBy(F.desc("gain"), "i", "bin")  # at most n blocks an index of the query
    if mode == "top_k":
        chosen = made.withColumn("r", F.row_number().over(order)).where(F.col("r") <= blocks)
    elif mode == "max_ratio":
        chosen = made.withColumn("most", F.max("gain").over(Window.partitionBy())).where(F.col("gain") >= F.col("most") * alpha)
    elif mode == "alpha_mass":
        before = F.coalesce(F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        chosen = made.withColumn("before", before).withColumn("all", F.sum("gain").over(Window.partitionBy())).where(F.col("before") < F.col("all") * alpha)
    else:
        raise ValueError(f"no such mode: {mode!r}")
    return top(own.join(F.broadcast(chosen.select("i", "bin", "gain")), ["i", "bin"]).groupBy("doc_id").agg(F.sum("gain").alias("score")), k)


def reranked(vectors: DataFrame, query: dict[int, float], k: int = 10, first: int = 50, most: float = 3.0, levels: int = 256) -> DataFrame:
    """Approximate scores from weights quantised uniformly over [0, most]; the first ``first`` are scored exactly."""
    none = _none(vectors, k, query)
    if none is not None:
        return none
    q = _literal(query)
    level = lambda w: F.floor(F.least(F.greatest(w, F.lit(0.0)), F.lit(most)) / most * (levels - 1)) / (levels - 1) * most
    rough = F.aggregate(F.filter("v", lambda e: e["i"].isin(list(query))), F.lit(0.0), lambda a, e: a + level(e["w"]) * F.element_at(q, e["i"]))
    near = vectors.select("doc_id", "v", rough.alias("score")).where("score > 0").orderBy(F.round("score", 6).desc(), "doc_id").limit(first)
    return top(exact_scores(near, query), k)


def _selected(made: DataFrame, mode: str, alpha: float, blocks: int) -> DataFrame:
    """made (i, bin, gain, weight), a row a block: those that a mode chooses. Weights add up, gains order."""
    order = Window.orderBy(F.desc("gain"), "i", "bin")  # at most so many blocks as levels times indexes of the query
    if mode == "top_k":
        return made.withColumn("r", F.row_number().over(order)).where(F.col("r") <= blocks)
    if mode == "max_ratio":
        return made.withColumn("most", F.max("weight").over(Window.partitionBy())).where(F.col("weight") >= F.col("most") * alpha)
    if mode == "alpha_mass":
        before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return made.withColumn("r", F.row_number().over(order)).withColumn("before", before).withColumn("all", F.sum("weight").over(Window.partitionBy())).where((F.col("before") < F.col("all") * alpha) | (F.col("r") == 1))
    raise ValueError(f"no such mode: {mode!r}")


def _by_blocks(own: DataFrame, query: dict[int, float], scale: float, mode: str, alpha: float, blocks: int, whole: bool) -> DataFrame:
    """own (doc_id, i, bin, value) -> (doc_id, score), score the sum of the chosen blocks' whole-number gains.

    A block's gain is its value times the query's weight, times scale, cut to a whole number; whole: so is its weight.
    """
    mass = F.col("value") * F.element_at(_literal(query), F.col("i"))
    made = own.groupBy("i", "bin").agg(F.first("value").alias("value")).withColumn("gain", F.floor(mass * scale).cast("long")).withColumn("weight", F.col("gain").cast("double") if whole else mass)
    chosen = _selected(made, mode, alpha, blocks).select("i", "bin", "gain")
    return own.join(F.broadcast(chosen), ["i", "bin"]).groupBy("doc_id").agg(F.sum("gain").alias("score"))


def quantised_levels(vectors: DataFrame, query: dict[int, float], k: int, n: int = 16, mode: str = "alpha_mass", alpha: float = 0.3, blocks: int = 10, most: float = 3.0) -> DataFrame:
    """quantised(), with bins that a weight reaches through 256 levels of [0, most] and gains in whole thousandths.

    A weight above 0 is cut to its level; a level stands for that share of the largest weight there is, and its bin is
    the one whose bounds hold it (0, if none does). Query weights are above 0. The n bins are equal in frequency.
    """
    none = _none(vectors, k, query)
    if none is not None:
        return none
    known = sorted(bins(vectors, n).collect(), key=lambda r: r["bin"])  # n rows
    if not known:
        return vectors.select("doc_id", F.lit(0).cast("long").alias("score")).limit(0)
    largest = known[-1]["high"]
    bounds = [0.0, *[r["high"] for r in known[:-1]], largest * 1.001]

    def bin_of(level: int) -> int:
        w = level / 255.0 * largest
        return next((r["bin"] for r, lo, hi in zip(known, bounds, bounds[1:], strict=True) if lo <= w < hi), 0)

    table = F.array(*[F.lit(bin_of(level)) for level in range(256)])
    value = F.create_map(*[F.lit(x) for r in known for x in (r["bin"], float(r["value"]))])
    level = F.floor(F.least(F.lit(255.0), F.col("w") / most * 255.0)).cast("int")
    own = entries(vectors, query).where("w > 0").withColumn("bin", F.get(table, level)).withColumn("value", F.element_at(value, F.col("bin")))
    return _whole(_by_blocks(own.select("doc_id", "i", "bin", "value"), query, 1000.0, mode, alpha, blocks, False), k)


def _whole(scores: DataFrame, k: int) -> DataFrame:
    return scores.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def block_max(vectors: DataFrame, query: dict[int, float], k: int = 10, first: int = 50, most: float = 3.0, mode: str = "alpha_mass", alpha: float = 0.3) -> DataFrame:
    """Blocks of 256 uniform levels of [0, most] with whole-number gains choose ``first`` documents, which are scored exactly.

    Gains below 1 are 0, as are scores of documents that only such blocks hold; these are not among the first. Query
    weights are above 0.
    """
    none = _none(vectors, k, query)
    if none is not None:
        return none
    level = F.floor(F.least(F.greatest(F.col("w"), F.lit(0.0)), F.lit(most)) / most * 255.0).cast("int")
    own = entries(vectors, query).withColumn("bin", level).withColumn("value", F.col("bin") / 255.0 * most)
    near = _whole(_by_blocks(own.select("doc_id", "i", "bin", "value"), query, 1.0, mode, alpha, 0, True), first).select("doc_id")
    return top(exact_scores(vectors.join(F.broadcast(near), "doc_id", "left_semi"), query), k)


def forward(vectors: DataFrame, doc_id: int) -> DataFrame:
    """The vector of a document; an id that no document has is an error."""
    own = vectors.where(F.col("doc_id") == doc_id)
    if own.isEmpty():
        raise IndexError(f"no document {doc_id}")
    return own
