"""N-gram Jaccard self-join with signature trees: documents whose 5-word shingle sets overlap by 75 % or more.

1. A pass over the texts hashes shingles (63 bits) and identifies sets (128 bits); equal sets become one vertex, and the
   text of one row is kept for each.
2. Candidates. In any order of all hashes, two sets that link share one of the n - ceil(t n) + 1 first hashes of each
   (prefix filter, t = 3/4). The order here is by how many sets hold a hash, counted in one set of SAMPLE and rounded to
   levels, then by hash: a passage in many texts then stands in no prefix but of sets that hold little else, and after
   what only a group of copies holds. The levels are a table of cells that grows with the hashes counted, up to FREQUENT.
   The sets that hold a prefix hash stand in a row by size. In rows of up to SHORT sets pairs are counted over all
   hashes, and pairs go that cannot reach the overlap with all that lies beyond the prefixes. In longer rows no pair is
   made: sets are tied to the first of their run of close sizes, which can tie too much, but never too little. Rows of
   hashes that are known to be hot stay where they are, each set tied to two classes of sizes. So every link lies inside
   a component of these candidates, a block, whatever the levels are: those only decide what it costs.
3. A block is dealt in tiles of bounded size. A signature tree over a tile holds in its nodes the OR of their sets'
   bitmaps, the range of sizes and the largest number of hashes that share a bit. A dual traversal, level by level, drops
   node pairs whose bitmaps and sizes allow no overlap that is large enough; pairs of sets that remain, and that no link
   joins yet, are counted exactly. Three rounds of it: each tile with itself; the smallest ids of what the tiles
   connected, likewise; then, only in blocks that are still in parts, all pairs of tiles, dealt again so that a part of
   many sets has tiles of its own, which never meet each other. A block of n near copies thus costs about n, not n^2.

Cases: null, empty and blank texts have no shingles and link with nothing; fewer than five words are one shingle;
repeated rows are equal sets; rows with shingles that share an id are linked; a row without an id is compared like any
other and takes the smallest id of its component, null if none has one. Copies, however many, are one row after a partial
aggregate. An empty table gives an empty result; a text of any length is one set; other columns are kept by keep_one and
may have any name but those that begin with ``__``, and are left out by join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, discard, packed, stored, to_least, unpack, unpacked
from .hashing import distinct, mix, shingle_sets

SHORT, TILE, LEAF, FAN, ENTRIES = 32, 256, 16, 8, 50_000
#: Hashes of a tile, about. Cells of the table of levels, at most (one byte each); how many sets of the sample, one in
#: SAMPLE, must hold a hash for it to have a level; it is hot if more than one in HOT sets of the sample do, about.
TILE_HASHES, FREQUENT, OFTEN, SAMPLE, HOT = 1 << 22, 1 << 25, 4, 4, 500
#: Where all pairs of tiles meet, a block of more than WIDE tiles has tiles up to WIDE times as large.
WIDE = 8
#: Cells for each hash that has a level, so that few others fall on them; cells that a task sends to the driver at once.
CELLS, PIECE = 8, 1 << 16
PART = 1 << 20


def least_overlap(a, b):
    """The smallest overlap that links sets of sizes a and b: 100 * overlap >= 75 * union."""
    return -(-3 * (a + b) // 7)


def numbered(documents: DataFrame) -> DataFrame:
    """documents -> doc_id, packed text, all other columns as __rest, a number __row that no other row has, and a hash of
    the text; stored, so that the numbers stay."""
    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("__rest")
    return stored(packed(documents.select("doc_id", "text", rest, F.monotonically_increasing_id().alias("__row"), F.xxhash64("text").alias("__hash"))), "numbered")


def sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes, 63 bits each, of the shingles of packed texts; about PART bytes are hashed at a time."""
    held, size = [], 0

    def work():
        yield from shingle_sets(held, bits=63)
        held.clear()

    for z in texts:
        held.append(unpack(z).lower())
        size += len(held[-1])
        if size >= PART:
            yield from work()
            size = 0
    if held:
        yield from work()


def prefix_size(n):
    """The hashes of a set of n of which one at least is shared with every set that it links with."""
    return n - -(-3 * n // 4) + 1


def identified(rows: DataFrame) -> DataFrame:
    """What numbered() gives -> __row, __hash, doc_id, n, k1, k2 (both null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2 = [], [], []
            for s in sets(batch.column(3).to_pylist()):
                key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s))
                k1.append(int(key[0]) if len(s) else None)
                k2.append(int(key[1]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in (n, k1, k2))], names=["__row", "__hash", "doc_id", "n", "k1", "k2"])

    return rows.select("__row", "__hash", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "__row long, __hash long, doc_id long, n long, k1 long, k2 long")


def prefixes(texts: DataFrame, levels: np.ndarray, hot: int) -> DataFrame:
    """texts (v, text) -> entries (s, n, v, hot), one a prefix hash, in the order of levels (of which a hash has that of its
    cell), then of hashes. Hashes of level hot or more are hot."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            v, n, p, out, hots = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for own, s in zip(batch.column(0).to_pylist(), sets(batch.column(1).to_pylist()), strict=True):
                level = table[s % np.uint64(len(table))]
                v.append(own)
                n.append(len(s))
                p.append(prefix_size(len(s)) if len(s) else 0)
                at = np.argsort(level, kind="stable")[: p[-1]]
                out.append(s[at])
                hots.append(level[at] >= hot)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(n, np.int64), p)), pa.array(np.repeat(np.array(v, np.int64), p)), pa.array(np.concatenate(hots))], names=["s", "n", "v", "hot"])

    return texts.select("v", "text").mapInArrow(run, "s long, n long, v long, hot boolean")


def frequent(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many sets of a sample hold the hashes that OFTEN or more of them hold: levels by cell (hash modulo their number),
    four to a doubling, the highest of the cell's hashes, 0 without such a hash; and the level from which a hash is hot.

    However many hashes there are, none is left out: beyond FREQUENT cells they share them, and a rare hash in the cell of
    a frequent one only comes later in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.concatenate([np.zeros(0, np.uint64), *sets(batch.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], names=["s"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, at, level = (batch.column(i).to_numpy() for i in range(3))
            for k in np.unique(piece):
                own = piece == k
                np.maximum.at(held.setdefault(int(k), np.zeros(PIECE, np.uint8)), at[own], level[own].astype(np.uint8))
        for k, levels in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([levels.tobytes()], pa.binary())], names=["piece", "levels"])

    spark = texts.sparkSession
    sample = texts.where(F.pmod(F.xxhash64("v", F.lit(9)), F.lit(SAMPLE)) == 0)
    counts = stored(sample.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN), "frequent")
    cells = max(1, min(FREQUENT, CELLS * counts.count()))
    cell, level = F.col("s") % cells, F.floor(F.log2("c") * 4).cast("int")
    dealt = counts.select(F.floor(cell / PIECE).alias("piece"), (cell % PIECE).alias("at"), level.alias("level"))
    table = np.zeros(-(-cells // PIECE) * PIECE, np.uint8)
    with batches_of(spark, ENTRIES):
        for r in dealt.repartition("piece").mapInArrow(pieces, "piece long, levels binary").collect():
            table[r["piece"] * PIECE :][:PIECE] = np.frombuffer(r["levels"], np.uint8)
    discard(counts)
    many = max(SHORT, sample.count() // HOT)
    return table[:cells], math.floor(math.log2(many + 1) * 4)


def _classes(s: np.ndarray, n: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each entry to its class of sizes in its row and to the next one: sets whose sizes are as 3 to 4 or
    closer have a class in common. Classes are negative numbers, so none is a set."""
    at = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.uint64)
    node = lambda c: (-1 - (mix(s.view(np.uint64) + mix(c)) >> np.uint64(1)).astype(np.int64))
    return np.concatenate([v, v]), np.concatenate([node(at), node(at + np.uint64(1))])


def row_edges(short: int):
    """Entries (s, n, v, hot) sorted by s, n, v -> for rows of up to ``short`` sets their pairs (a, b, n of a, n of b), a below
    b; for longer ones, with null sizes, each set with the first of its run of close sizes; for hot ones with its classes.

    A row is never held whole: of a long one only the last size and the first of the run are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = (none, none, none)  # entries of the last row so far, if it may still be short
        long_s = last_n = first = None  # the last row, if it is long, its last size and the first of its run

        def ties(s, n, v, own):
            """Of entries in long rows (own): the set that each is tied to."""
            nonlocal long_s, last_n, first
            s, n, v = s[own], n[own], v[own]
            if not len(s):
                return none, none
            go_on = np.concatenate([[long_s is not None and s[0] == long_s and 4 * last_n >= 3 * n[0]], (s[1:] == s[:-1]) & (4 * n[:-1] >= 3 * n[1:])])
            at = np.maximum.accumulate(np.where(go_on, -1, np.arange(len(s))))
            to = np.where(at >= 0, v[at], 0 if first is None else first)
            long_s, last_n, first = s[-1], n[-1], to[-1]
            return v, to

        def work(s, n, v, last: bool):
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(at, len(s)))
            many = size > short
            many[0] |= long_s is not None and s[0] == long_s
            own = np.repeat(many, size)
            row = np.repeat(np.arange(len(at)), size)
            if not last and not many[-1]:  # goes on in the next batch
                rest = slice(at[-1], None)
                keep, few = (s[rest], n[rest], v[rest]), ~own & (row < len(at) - 1)
            else:
                keep, few = (none, none, none), ~own
            out = [[none], [none], [none], [none]]
            for d in range(1, short):
                i = np.flatnonzero(few[:-d] & (row[:-d] == row[d:])) if len(s) > d else none
                if not len(i):
                    break
                i = i[(4 * n[i] >= 3 * n[i + d]) & (v[i] != v[i + d])]
                up = v[i] < v[i + d]
                for c, x, y in zip(out, (v[i], v[i + d], n[i], n[i + d]), (v[i + d], v[i], n[i + d], n[i]), strict=True):
                    c.append(np.where(up, x, y))
            a, b = ties(s, n, v, own)
            other = a != b
            gap = pa.nulls(int(other.sum()), pa.int64())
            columns = [[np.concatenate(out[0]), np.maximum(a, b)[other]], [np.concatenate(out[1]), np.minimum(a, b)[other]], [np.concatenate(out[2]), gap], [np.concatenate(out[3]), gap]]
            return keep, pa.RecordBatch.from_arrays([pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in c]) for c in columns], names=["a", "b", "n_a", "n_b"])

        for batch in batches:
            s, n, v = (batch.column(i).to_numpy() for i in range(3))
            hot = batch.column(3).to_numpy(zero_copy_only=False)
            if hot.any():
                a, b = _classes(s[hot], n[hot], v[hot])
                gap = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), gap, gap], names=["a", "b", "n_a", "n_b"])
                s, n, v = s[~hot], n[~hot], v[~hot]
            s, n, v = (np.concatenate(x) for x in zip(held, (s, n, v), strict=True))
            if len(s):
                held, out = work(s, n, v, False)
                yield out
        if len(held[0]):
            yield work(*held, True)[1]

    return run


class Tree:
    """A signature tree over sets: levels from the root's to the sets' own, each with bitmaps, sizes and surplus."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]).bit_length(), sets[i][0], len(sets[i])))
        self.order = np.array(order)
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(order):
            at = (sets[i] % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(maps[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        n = np.array([len(sets[i]) for i in order])
        surplus = n - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, n, n, surplus)]
        self.spread = []
        fan = LEAF
        while len(self.levels[0][0]) > 1:
            maps, lo, hi, surplus = self.levels[0]
            cut = np.arange(0, len(maps), fan)
            self.levels.insert(0, (np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(surplus, cut)))
            self.spread.insert(0, (fan, len(maps)))
            fan = FAN


def _may(a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs (i of level a, j of level b) can hold two sets that overlap enough."""
    ok = (4 * a[2][i] >= 3 * b[1][j]) & (4 * b[2][j] >= 3 * a[1][i])
    i, j = i[ok], j[ok]
    common = np.bitwise_count(a[0][i] & b[0][j]).sum(1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
    ok[ok] = np.minimum(common, np.minimum(a[2][i], b[2][j])) >= least_overlap(a[1][i], b[1][j])
    return ok


def pairs(x: Tree, y: Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that the dual traversal leaves, as numbers in the lists the trees were made from; same: x is y."""
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q, i, j = stack.pop()
        if len(i) > 8192:
            stack += [(p, q, i[k : k + 8192], j[k : k + 8192]) for k in range(0, len(i), 8192)]
            continue
        ok = _may(x.levels[p], y.levels[q], i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        done_x, done_y = p == len(x.levels) - 1, q == len(y.levels) - 1
        if done_x and done_y:
            if same:
                i, j = i[i < j], j[i < j]
            yield x.order[i], y.order[j]
            continue
        # Trees of other heights are opened one side at a time, the higher first.
        left_x, left_y = len(x.levels) - p, len(y.levels) - q
        if not done_x and left_x >= left_y:
            fan, n = x.spread[p]
            kid = i[:, None] * fan + np.arange(fan)
            i, j, p = kid.ravel(), np.repeat(j, fan), p + 1
            i, j = i[i < n], j[i < n]
        if not done_y and left_y >= left_x:
            fan, n = y.spread[q]
            kid = j[:, None] * fan + np.arange(fan)
            i, j, q = np.repeat(i, fan), kid.ravel(), q + 1
            i, j = i[j < n], j[j < n]
        if same and p == q:
            i, j = i[i <= j], j[i <= j]
        stack.append((p, q, i, j))


def links(ids: list[int], own: list[np.ndarray], parts: list[int], tiles: list[int], i: int, j: int) -> list[tuple[int, int]]:
    """What the links between tile i and tile j (within the tile, if they are one) join of the parts that the sets are in:
    (part, smallest part joined to it). Sets of one part need no link."""
    if len(ids) < 2:
        return []
    bits = min(1 << 15, 1 << max(8, (2 * max(map(len, own))).bit_length()))
    left, right = np.flatnonzero(np.array(tiles) == i), np.flatnonzero(np.array(tiles) == j)
    if not len(left) or not len(right):
        return []
    x = Tree([own[k] for k in left], bits)
    y = x if i == j else Tree([own[k] for k in right], bits)
    names, label = np.unique(np.array(parts), return_inverse=True)
    label = label.copy()
    every, rows = np.sort(np.concatenate(own)), None
    words = distinct(every[1:][every[1:] == every[:-1]])  # what one set alone holds is in no overlap
    if len(ids) * len(words) <= 1 << 29:  # bitmaps without shared bits, up to 64 MB: then their AND is the overlap
        rows = np.zeros((len(ids), -(-len(words) // 64)), np.uint64)
        for k, s in enumerate(own if len(words) else ()):
            at = np.searchsorted(words, s)
            at = at[words[np.minimum(at, len(words) - 1)] == s]
            np.bitwise_or.at(rows[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    size = np.array([len(s) for s in own])
    first = label.copy()
    for a, b in pairs(x, y, i == j):
        a, b = left[a], right[b]
        step = max(1, min(256, (1 << 21) // max(1, 1 if rows is None else rows.shape[1])))
        for k in range(0, len(a), step):
            open_ = label[a[k : k + step]] != label[b[k : k + step]]
            p, q = a[k : k + step][open_], b[k : k + step][open_]
            if not len(p):
                continue
            over = np.bitwise_count(rows[p] & rows[q]).sum(1) if rows is not None else np.array([len(np.intersect1d(own[u], own[v], assume_unique=True)) for u, v in zip(p, q, strict=True)])
            good = 100 * over >= 75 * (size[p] + size[q] - over)
            for u, v in zip(p[good], q[good], strict=True):
                if label[u] != label[v]:
                    label[label == label[v]] = label[u]
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, label, names[first])
    joined = np.unique(np.stack([names[first], least[label]], axis=1), axis=0)
    return [(int(a), int(b)) for a, b in joined if a != b]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, tile, v, part, packed text), sorted by block, i, j -> joined parts (a, b), b the smaller."""
    key, ids, own, parts, tiles = None, [], [], [], []
    out: list[tuple[int, int]] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    for batch in batches:
        c = [batch.column(k).to_pylist() for k in range(6)]
        for row, s in enumerate(sets(batch.column(6).to_pylist())):
            k = (c[0][row], c[1][row], c[2][row])
            if k != key:
                if ids:
                    out += links(ids, own, parts, tiles, key[1], key[2])
                key, ids, own, parts, tiles = k, [], [], [], []
            if len(s):
                ids.append(c[4][row])
                own.append(s)
                parts.append(c[5][row])
                tiles.append(c[3][row])
        if out:
            yield made()
            out = []
    if ids:
        out += links(ids, own, parts, tiles, key[1], key[2])
    yield made()


def _tiles(rows, size, wide=1):
    """How many tiles, of up to wide * TILE sets, so many sets with so many hashes in all make."""
    return F.greatest(F.ceil(rows / (TILE * wide)), F.ceil(size / TILE_HASHES)).cast("int")


def _sized(blocks: DataFrame) -> DataFrame:
    """blocks (v, n, block, ...) with the number of tiles of each block."""
    return blocks.join(blocks.groupBy("block").agg(_tiles(F.count("*"), F.sum("n")).alias("tiles")), "block")


def _within(texts: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """blocks (v, block, tiles) -> (a, b): each v that links of its tile join to a smaller one, with the smallest of them."""
    dealt = blocks.select("v", "block", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int").alias("tile"))
    met = texts.select("v", "text").join(dealt, "v").select("block", F.col("tile").alias("i"), F.col("tile").alias("j"), "tile", "v", F.col("v").alias("part"), "text")
    return stored(met.repartition("block", "i").sortWithinPartitions("block", "i").mapInArrow(_verify, "a long, b long"), name)


def _across(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (v, n, block, part, tiles), each of several parts -> joined parts (a, b), from all pairs of tiles.

    A part of more than half a tile has tiles of its own, numbered from ``at`` on; the others share those from 0 on. A text
    is sent, and hashed again, once for each tile that its own meets, so a block of many tiles is dealt in fewer, wider
    ones: about WIDE of them, until they are WIDE times as wide.
    """
    wide = F.least(F.lit(WIDE), F.ceil(F.max("tiles") / WIDE)).alias("wide")
    parts = blocks.groupBy("block", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), wide)
    large = (F.col("rows") > F.col("wide") * (TILE // 2)) | (F.col("size") > TILE_HASHES // 2)
    shared = parts.groupBy("block").agg(F.coalesce(_tiles(F.sum(F.when(~large, F.col("rows"))), F.sum(F.when(~large, F.col("size"))), F.max("wide")), F.lit(0)).alias("shared"), F.collect_list(F.when(large, F.struct(F.col("part"), _tiles(F.col("rows"), F.col("size"), F.col("wide")).alias("tiles")))).alias("own"))
    # Of a block, one entry a large part: it names the part of every tile, null for shared ones.
    plan = shared.select("block", "shared", F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("shared")), F.flatten(F.transform(F.array_sort("own"), lambda x: F.array_repeat(x["part"], x["tiles"])))).alias("pure"))
    d = blocks.join(plan, "block")
    first, n = F.array_position("pure", F.col("part")) - 1, F.size(F.filter("pure", lambda x: x == F.col("part")))
    d = d.withColumn("tile", F.when(n > 0, first + F.pmod(F.xxhash64("v"), F.greatest(n, F.lit(1)))).otherwise(F.pmod(F.xxhash64("part"), F.greatest("shared", F.lit(1)))).cast("int"))
    own = F.get("pure", F.col("tile"))
    d = d.select("v", "part", "block", "tile", F.filter(F.transform("pure", lambda x, k: F.when(own.isNull() | x.isNull() | (x != own), k)), lambda k: k.isNotNull()).alias("others"))
    d = texts.select("v", "text").join(d, "v").select("*", F.explode("others").alias("other"))
    met = d.select("block", F.least("tile", "other").cast("int").alias("i"), F.greatest("tile", "other").cast("int").alias("j"), "tile", "v", "part", "text")
    return stored(met.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_verify, "a long, b long"), "links")


def _renamed(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """labels (v, part, ...) with each part replaced by what joined (a, b) names it."""
    j = joined.select(F.col("a").alias("part"), F.col("b").alias("__to"))
    return labels.join(j, "part", "left").withColumn("part", F.coalesce("__to", "part")).drop("__to")


def linked_sets(rows: DataFrame, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What numbered() gives -> its sets; vertices, one for each set (v, the lowest __row that has it; first, the row to
    keep: that with the smallest id, null last); labels (v, part): what links join has one part, sets without a link and
    without a candidate have no row. by_id: sets that share an id are linked."""
    d = stored(identified(rows), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", "__row")
    vertices = stored(d.where("k1 is not null").groupBy("k1", "k2").agg(F.min("__row").alias("v"), F.min(first).alias("first"), F.min("n").alias("n")), "vertices")
    texts = stored(rows.select(F.col("__row").alias("v"), "text").join(vertices.select("v"), "v", "left_semi"), "texts")
    levels, hot = frequent(texts)
    with batches_of(rows.sparkSession, ENTRIES, "2m"):
        entries = prefixes(texts, levels, hot).repartition(F.when(F.col("hot"), F.xxhash64("v")).otherwise(F.col("s")))
        pairs_ = stored(entries.sortWithinPartitions("s", "n", "v").mapInArrow(row_edges(SHORT), "a long, b long, n_a long, n_b long"), "pairs")
    counted = pairs_.where("n_a is not null").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    # What may be shared beyond the prefixes, of the set whose prefix ends first: at most the larger rest of the two.
    most = F.col("shared") + F.greatest(F.floor(F.col("n_a") * 3 / 4 + 0.75), F.floor(F.col("n_b") * 3 / 4 + 0.75)) - 1
    candidates = counted.where(most >= F.ceil((F.col("n_a") + F.col("n_b")) * 3 / 7)).select("a", "b").union(pairs_.where("n_a is null").select("a", "b"))
    blocks = components(candidates).where("id >= 0").select(F.col("id").alias("v"), F.col("component").alias("block"))
    blocks = stored(_sized(blocks.join(vertices.select("v", "n"), "v")), "blocks")
    few = stored(texts.join(blocks.select("v"), "v"), "block-texts")  # what has a candidate
    discard(texts, pairs_)
    texts = few
    joined = _within(texts, blocks, "within")
    labels = stored(_renamed(blocks.withColumn("part", F.col("v")), joined), "labels")
    edges = rows.sparkSession.createDataFrame([], "a long, b long")
    several = labels.where("tiles > 1")
    if not several.isEmpty():
        again = _within(texts, _sized(several.where("v = part").drop("tiles")), "parts-within")
        labels = stored(_renamed(labels, again), "labels")
        several = labels.where("tiles > 1")
        parts = several.groupBy("block").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("block")
        edges = _across(texts, several.join(parts, "block", "left_semi"))
    labels = labels.select("v", "part")
    if by_id:
        some = d.where("k1 is not null and doc_id is not null")
        twice = some.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "k2") for f in (F.min, F.max)]).where("min_k1 <> max_k1 or min_k2 <> max_k2")
        named = some.select("doc_id", "k1", "k2").join(twice.select("doc_id"), "doc_id", "left_semi").distinct().join(vertices.select("k1", "k2", "v"), ["k1", "k2"]).select("doc_id", "v")
        named = stored(named.join(labels, "v", "left").select("doc_id", "v", F.coalesce("part", "v").alias("part")), "named")
        if not named.isEmpty():
            labels = labels.union(named.join(labels, "v", "left_anti").select("v", "part").distinct())
            edges = edges.union(named.join(named.groupBy("doc_id").agg(F.min("part").alias("b")), "doc_id").select(F.col("part").alias("a"), "b"))
    if not edges.isEmpty():
        labels = _renamed(labels, components(edges).toDF("a", "b")).select("v", "part")
    discard(texts)
    return d, vertices, labels


def join(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id; one row a row."""
    d, vertices, labels = linked_sets(numbered(documents.select("doc_id", "text")), by_id=True)
    named = vertices.select("v", "k1", "k2", "first.doc_id").join(labels, "v", "left").withColumn("part", F.coalesce("part", "v"))
    named = to_least(named.select("k1", "k2", F.col("part").alias("a"), F.col("doc_id").alias("b")), vertices.count()).select("k1", "k2", F.col("m").alias("least"))
    out = d.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of near copies, that with the smallest id; same columns.

    Groups are of texts alone: rows with one id and unrelated texts all stay, and rows without an id are copies like any
    other, kept only where no row of the group has an id. Rows without shingles all stay.
    """
    rows = numbered(documents)
    d, vertices, labels = linked_sets(rows, by_id=False)
    groups = vertices.select("v", "first").join(labels, "v", "left").groupBy(F.coalesce("part", "v").alias("c")).agg(F.min("first").alias("first"))
    kept = groups.select("first.__row").union(d.where("k1 is null").select("__row"))
    out = unpacked(rows.join(kept, "__row", "left_semi"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"__rest.`{c}`") for c in documents.columns])
