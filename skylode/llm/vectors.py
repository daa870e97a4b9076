"""Search by largest inner product: additive quantisation with an exact check, and shards of KD-trees; both are exact.

Both read vectors (vec_id, embedding) and a stated set of queries, and bring queries and candidates together in
blocks: candidates are dealt into shards and queries into blocks by a hash, each shard meets each block in one task of
bounded size, and only the best of each (query, shard) go on. What is repeated for the blocks was made once: codes with
their packed vectors, or a tree a shard. Nothing is broadcast but the codebooks, whose
size is fixed.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor, in the search
by codes, do zero vectors or rows without an id; shorter vectors count as filled up with zeros. Ties go to the smaller
vec_id. A query that has fewer candidates gets them all. Rows that repeat an id are candidates of their own; a query's
own id is never its candidate, and its smallest vector is what is asked. Empty tables give empty results; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD, BLOCK = 8192, 1024


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and v (the vector as it is) of the rows that take part. zero: whether zero vectors do."""
    v = vectors.select("vec_id", F.col("embedding").alias("v")).where("vec_id is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return v if zero else v.where(F.exists("v", lambda x: x != 0))


def dealt(n: int, q: int, shard: int, block: int, cores: int) -> tuple[int, int]:
    """Into how many shards and blocks n candidates and q queries go: bounded ones, and blocks for all cores."""
    shards = max(1, -(-n // shard))
    return shards, max(1, -(-q // block), min(-(-cores // shards), -(-q // 32)))


def _own(key: str, k: int, salt: int):
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(k)).cast("int")


def _all_of(k: int):
    return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))


def matrix(column, dim: int, dtype=np.float64) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    out = np.zeros((len(column), dim), dtype)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- additive quantisation -------------------------------------------------------------------------------------------


def train(sample: np.ndarray, books: int, size: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Full-dimensional codebooks (books, size, dim): k-means of what the books before leave of the sample."""
    rng = np.random.default_rng(seed)
    left, out = sample.copy(), []
    for _ in range(books):
        k = min(size, len(left))
        c = left[rng.choice(len(left), k, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)
            sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
            np.add.at(sums, near, left)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        left -= c[np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)]
        out.append(np.vstack([c, np.zeros((size - k, sample.shape[1]))]) if k < size else c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (rows, books) by beam search, in single precision."""
    x, books = x.astype(np.float32), books.astype(np.float32)
    n, dim = x.shape
    codes, left, rows = np.zeros((n, 1, 0), np.uint8), x[:, None, :], np.arange(n)[:, None]
    error = (x * x).sum(1)[:, None]
    for c in books:
        cost = (left.reshape(-1, dim) @ (-2 * c.T)).reshape(n, -1, len(c)) + (c * c).sum(1) + error[:, :, None]
        flat = cost.reshape(n, -1)
        top = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        error = np.take_along_axis(flat, top, 1)
        codes = np.concatenate([codes[rows, top // len(c)], (top % len(c)).astype(np.uint8)[:, :, None]], axis=2)
        left = left[rows, top // len(c)] - c[top % len(c)]
    return codes[np.arange(n), np.argmin(error, axis=1)]


def looked_up(codes: np.ndarray, tables: np.ndarray, rows: int = 2048) -> np.ndarray:
    """(rows, queries): each row's sum of one table entry a code. tables: (books, size, queries)."""
    out = np.zeros((len(codes), tables.shape[2]), np.float32)
    buffer = np.empty((rows, tables.shape[2]), np.float32)
    for a in range(0, len(codes), rows):
        part = out[a : a + rows]
        own = buffer[: len(part)]
        for j, table in enumerate(tables):
            np.take(table, codes[a : a + rows, j], axis=0, out=own, mode="clip")
            part += own
    return out


NEAREST = "query_id long, rank int, vec_id long, score double"
#: Of the rounding of looked-up scores in single precision, as a share of the norms that are added up.
ROUNDING = 1e-5


def length(x: np.ndarray) -> np.ndarray:
    """Norms of rows, without overflow."""
    most = np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-300)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row's product with y, added up from the first component on, so equal rows have equal scores."""
    out = np.zeros(len(x))
    for part in (x * y).T:
        out += part
    return out


class Shard:
    """Candidates by their codes, and the search for a query's best among them."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, x: np.ndarray):
        self.ids, self.row, self.codes, self.scale, self.error, self.x = ids, row, codes, scale, error, x
        self.checked = 0  # exact products of all searches

    def search(self, books: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best rows, with their exact products, ties to the smaller id.

        The ``rerank`` rows whose looked-up scores are best are checked first. A row's product is above its looked-up
        score by the query's norm times the row's error at most, so the rest goes on in the order of this bound, in
        pieces, until it is below the kth product found.
        """
        for a in range(0, len(queries), 16):
            y = queries[a : a + 16]
            norm = np.maximum(length(y), 1e-300)
            y = y / norm[:, None]  # a query's norm bears on no order
            tables = np.ascontiguousarray((books @ y.T).astype(np.float32))
            for i, sums in enumerate(looked_up(self.codes, tables).T):
                yield self._best(sums * self.scale, y[i], queries[a + i], own[a + i], k, rerank)

    def _best(self, score: np.ndarray, unit: np.ndarray, y: np.ndarray, own: int, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        near, exact = np.zeros(0, np.int64), np.zeros(0)

        def check(rows: np.ndarray) -> float:
            """The kth product relative to the query's norm, once these rows are in."""
            nonlocal near, exact
            self.checked += len(rows)
            near, exact = np.append(near, rows), np.append(exact, products(self.x[rows], y))
            best = np.lexsort((self.row[near], self.ids[near], -exact))[:k]
            near, exact = near[best], exact[best]
            return (self.x[near[-1]] @ unit) if len(near) == k else -np.inf

        bound = np.where(self.ids != own, score + self.error, -np.inf)
        few = min(rerank, len(score))
        first = np.argpartition(np.where(self.ids != own, score, -np.inf), len(score) - few)[len(score) - few :]
        kth = check(first[self.ids[first] != own])
        bound[first] = -np.inf
        rest = np.flatnonzero((bound >= kth) & (bound > -np.inf))
        rest = rest[np.argsort(-bound[rest], kind="stable")]
        for a in range(0, len(rest), 4096):
            if bound[rest[a]] < kth:
                break
            kth = check(rest[a : a + 4096])
        return near, exact


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, books: int = 32, size: int = 256, beam: int = 4, rerank: int = 100, sample: int = 8192, shard: int = 1 << 25, block: int = 1 << 24) -> DataFrame:
    """The k nearest for the rows whose vec_id is divisible by every: query_id, rank, vec_id, score.

    Directions (vectors over their norm) are what is quantised. The codebooks are fitted on ``sample`` rows, the first
    by a hash of their id; every row is encoded as its codes, the factor that gives their sum the row's norm, and its
    error, the norm of what this leaves of the row. ``shard`` and ``block`` are bytes of vectors in double precision. The product with a query is then that factor times the sum of one
    table entry a code, give or take the error times the query's norm; the tables hold the query's products with all
    code words. An exact check follows where a shard meets a block of queries: of the ``rerank`` best rows by this, and
    of all others that, by their error, could be above the kth product. So what the codebooks do not resolve, such as
    groups of near copies or rows unlike the sample, costs more checks and loses no neighbour.
    """
    spark = vectors.sparkSession
    v = usable(vectors, zero=False)
    rows = v.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("v").collect()
    dim = (v.agg(F.max(F.size("v"))).first()[0] or 0) if rows else 0
    if not rows:
        return spark.createDataFrame([], NEAREST)
    x = matrix([r["v"] for r in rows], dim)
    x /= length(x)[:, None]
    shared = spark.sparkContext.broadcast(train(x, books, size))
    single = v.schema["v"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        sizes = np.linalg.norm(words, axis=2)
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                x = matrix(batch.column(1).to_pylist(), dim)
                norm = length(x)
                unit = x / norm[:, None]
                codes = encode(unit, words, beam)
                made = sum(words[j][codes[:, j]] for j in range(len(words)))
                scale = 1 / np.maximum(np.linalg.norm(made, axis=1), 1e-15)
                added = sum(sizes[j][codes[:, j]] for j in range(len(words)))
                error = np.linalg.norm(unit - made * scale[:, None], axis=1) + ROUNDING * (1 + added * scale)
                packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm * scale), pa.array(norm * error)], names=["vec_id", "v", "row", "codes", "scale", "error"])

    numbered = stored(v.repartition(F.col("vec_id")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    coded = stored(numbered.mapInArrow(index, "vec_id long, v binary, row long, codes binary, scale double, error double"), "codes")
    asked = stored(numbered.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "asked")
    shards, blocks = dealt(coded.count(), asked.count(), max(1, shard // (8 * dim)), max(1, block // (8 * dim)), spark.sparkContext.defaultParallelism)
    candidates = coded.select("vec_id", "v", "row", "codes", "scale", "error", _own("row", shards, 2).alias("shard"), _all_of(blocks).alias("block"))
    queries = asked.select("query_id", "q", _own("query_id", blocks, 1).alias("block"), _all_of(shards).alias("shard"))

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "row": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "row": "int64"})
        if not len(c) or not len(q):
            return none
        codes = np.frombuffer(b"".join(c["codes"]), np.uint8).reshape(len(c), -1).astype(np.intp)
        x = np.frombuffer(b"".join(c["v"]), kind).reshape(len(c), dim).astype(np.float64)
        own = Shard(c["vec_id"].to_numpy(), c["row"].to_numpy(), codes, c["scale"].to_numpy(), c["error"].to_numpy(), x)
        asked = q["query_id"].to_numpy()
        near, score = zip(*own.search(shared.value, matrix(q["q"], dim), asked, k, rerank), strict=True)
        at = np.concatenate(near)
        return pd.DataFrame({"query_id": np.repeat(asked, [len(n) for n in near]), "vec_id": own.ids[at], "row": own.row[at], "score": np.concatenate(score)})

    keys = ["shard", "block"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, row long, score double")
    return best(found, k)


# --- KD-trees --------------------------------------------------------------------------------------------------------


class Tree:
    """A KD-tree of integer vectors: median splits of the widest side, tight boxes, leaves of up to ``leaf`` rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 64):
        self.nodes = []  # two children, or None with ids and vectors
        lows, highs = [], []

        def build(rows: np.ndarray) -> int:
            me, own = len(self.nodes), x[rows]
            lo, hi = own.min(0), own.max(0)
            self.nodes.append(None)
            lows.append(lo)
            highs.append(hi)
            axis = int(np.argmax(hi - lo))
            if len(rows) <= leaf or hi[axis] == lo[axis]:
                rows = rows[np.argsort(ids[rows], kind="stable")]
                self.nodes[me] = (None, ids[rows], x[rows])
            else:
                half = len(rows) // 2
                rows = rows[np.argsort(x[rows, axis], kind="stable") if x.dtype == object else np.argpartition(x[rows, axis], half)]
                self.nodes[me] = (build(rows[:half]), build(rows[half:]))
            return me

        build(np.arange(len(ids)))
        self.low, self.high = np.stack(lows), np.stack(highs)
        self.opened = self.searched = 0  # leaves that all searches looked into; searches

    def bounds(self, y: np.ndarray) -> np.ndarray:
        """For each node the largest product that a vector in its box can have with y."""
        return np.maximum(y, 0) @ self.high.T + np.minimum(y, 0) @ self.low.T

    def search(self, y: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) that score at least ``least``, by a best-first walk over the boxes.

        least is the kth score known from elsewhere; the walk raises it to its own kth score and ends at the first box
        whose bound is below it. Boxes that could only tie are opened too, since a smaller vec_id may be inside.
        """
        bound = self.bounds(y)
        queue, top = [(-int(bound[0]), 0)], []
        self.searched += 1
        while queue:
            b, node = heapq.heappop(queue)
            if -b < least:
                break
            kids = self.nodes[node]
            if kids[0] is not None:
                for kid in kids:
                    if bound[kid] >= least:
                        heapq.heappush(queue, (-int(bound[kid]), kid))
                continue
            self.opened += 1
            score = kids[2] @ y
            for i in np.flatnonzero(score >= least):
                if kids[1][i] != own:
                    item = (int(score[i]), -int(kids[1][i]))
                    if len(top) < k:
                        heapq.heappush(top, item)
                    elif item > top[0]:
                        heapq.heapreplace(top, item)
            if len(top) == k:
                least = max(least, top[0][0])
        return top


WIDE = 2.0**53


def exact_top(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, shard: int = SHARD, block: int = BLOCK, leaf: int = 64) -> DataFrame:
    """The k best rows by the inner product of floor(scale * component): query_id, rank, vec_id, score (long).

    Each shard has a KD-tree, which is built once and stored. A first round searches for each query the one shard that
    its own hash names; the kth score found there is a lower bound that goes with the query to all other shards.
    Products below 2^53 are summed as doubles, others as integers without bound; a score among the best that does not
    fit a long raises OverflowError.
    """
    spark = vectors.sparkSession
    x = F.transform("v", lambda x: F.when(F.abs(x.cast("double") * scale) < WIDE, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    v = stored(usable(vectors, zero=True).select("vec_id", x.alias("v"), F.monotonically_increasing_id().alias("row")), "integers")
    told = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    dim = told["dim"] or 0
    wide = (told["most"] or 0.0) ** 2 * dim >= WIDE
    asked = stored(v.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "asked")
    shards, blocks = dealt(told["n"], asked.count(), shard, block, spark.sparkContext.defaultParallelism)

    def integers(column) -> np.ndarray:
        x = matrix(column, dim)
        return np.array([[int(c) for c in r] for r in x], object).reshape(x.shape) if wide else x

    def build(c: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(c["vec_id"].to_numpy(), integers(c["v"]), leaf)
        return pd.DataFrame({"shard": [int(c["shard"].iloc[0])], "tree": [pickle.dumps(tree, 5)]})

    trees = stored(v.select("vec_id", "v", _own("row", shards, 2).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, tree binary"), "trees")
    rows = trees.select("shard", "tree", _all_of(blocks).alias("block"))
    queries = asked.select("query_id", "q", _own("query_id", blocks, 1).alias("block"), _all_of(shards).alias("shard"))
    keys = ["shard", "block"]

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(c) and len(q):
            tree = pickle.loads(c["tree"].iloc[0])
            for qid, own, least in zip(q["query_id"], integers(q["q"]), q["least"], strict=True):
                out += [(qid, -i, s) for s, i in tree.search(own, qid, k, least)]
        if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in out):
            raise OverflowError("a score does not fit 64 bits")
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    schema = "query_id long, vec_id long, score long"
    queries = queries.withColumn("home", _own("query_id", shards, 5))
    first = queries.where("shard = home").withColumn("least", F.lit(float("-inf")))
    near = stored(best(rows.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInPandas(search, schema), k), "near")
    kth = F.min("score").cast("double")
    if wide:  # a score beyond 2^53 may be rounded up on its way
        kth = kth - F.abs(kth) * F.lit(2.0**-50)
    known = near.groupBy("query_id").agg(F.when(F.count("*") >= k, kth).otherwise(float("-inf")).alias("known"))
    rest = queries.where("shard <> home").join(known, "query_id", "left").withColumn("least", F.coalesce("known", F.lit(float("-inf")))).drop("known")
    found = rows.groupBy(*keys).cogroup(rest.groupBy(*keys)).applyInPandas(search, schema)
    return best(found.unionByName(near.drop("rank")), k)
