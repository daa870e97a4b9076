"""Exact removal of byte strings that occur more than once, with two-stage suffix sorting.

A byte goes if it lies in a string of ``length`` bytes (a window) that also starts anywhere else, in its own document
or another; matches never cross documents, overlaps count, and all is judged on the input.

1. Anchors. The smallest of the hashed ``gram``-byte strings in a window (the leftmost, if equal) is the window's
   anchor: equal windows have equal anchors at the same offset. Windows in a row with one anchor form a context; each
   window is in exactly one. Contexts whose anchor's hash stands only once in all documents are left out.
2. Equal contexts are counted (a partial aggregate, so copies are one row before the shuffle); all their windows repeat.
3. Different contexts with one anchor hash may share windows. One of each goes, with its bytes, to the task that its
   anchor hash names, where contexts are joined into buffers and suffix-sorted: only suffixes smaller than their
   successors are sorted directly, all others are induced by scanning the buckets in order. Neighbours among the
   windows with a common prefix of ``length`` bytes repeat. The contexts of an anchor with more than ``hot`` different
   ones are first cut into pieces of ``STEP`` windows (of one, beyond ``hottest``) by their distance from the anchor, which
   go by the hash of what these windows have in common; equal windows still meet, and no task gets them all. Equal pieces
   repeat throughout: a task sends one of them, and one is sorted.
4. The ranges go back to every occurrence of their context, and are merged in each document.

No key has more than a small share of the rows of a task: anchors and contexts that many texts share are spread.

Hashes: an anchor and a context have 64 bits each and are only compared together (128 bits); bytes decide in 3.

Cases: a null or empty text has no bytes and loses none; texts shorter than a window lose none; rows that repeat an id
and its text repeat each other; the same id with other texts is another document; a text of any length is cut into
overlapping pieces of ``PIECE`` bytes for hashing. Removed runs may cut a character, so kept parts are bytes. An empty
table gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import HUBS, spread_join, stored

LENGTH, GRAM, HOT, HOTTEST, STEP = 200, 48, 256, 1 << 16, 8
PIECE, BUFFER, SORTED = 1 << 22, 1 << 22, 1 << 20
_POS = 24  # bits of a position within a buffer; the other 40 are the hash's
U = np.uint64


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values (prefix and suffix minima of blocks)."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For all contexts: text number, first window, windows, distance of the anchor from it, anchor and context hash."""
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []

    def work() -> None:
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        sizes = np.array([len(x[2]) for x in held])
        ends = np.cumsum(sizes)
        if len(data) >= length:
            s = hashing.sums(data)
            at = np.arange(len(data) - gram + 1)
            grams = hashing.spans(s, at, at + gram)
            least = sliding_least(grams >> U(_POS) << U(_POS) | at.astype(U), length - gram + 1)
            anchor = (least & U((1 << _POS) - 1)).astype(np.int64)
            owner = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
            good = np.arange(len(anchor)) + length <= ends[owner]
            first = good.copy()
            first[1:] &= (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~good[:-1]
            lo = np.flatnonzero(first)
            stop = np.ones(len(anchor) + 1, bool)
            stop[:-1] = first | ~good
            stops = np.flatnonzero(stop)
            hi = stops[np.searchsorted(stops, lo, side="right")]  # one past the context's last window
            own = owner[lo]
            begin = (ends - sizes)[own]
            texts_of, bases = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            out.append((texts_of[own], lo - begin + bases[own], hi - lo, anchor[lo] - lo, grams[anchor[lo]].view(np.int64), hashing.spans(s, lo, hi + length - 1).view(np.int64)))
        held.clear()

    total = 0
    for number, text in enumerate(texts):
        for base in range(0, max(len(text) - length + 1, 0), PIECE):
            piece = text[base : base + PIECE + length - 1]
            if total + len(piece) > 2 * BUFFER and held:
                work()
                total = 0
            held.append((number, base, piece))
            total += len(piece)
    if held:
        work()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data in the order of their suffixes, exact up to depth bytes (longer ties stand in any order)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is smaller than its successor if the next byte that differs is larger; the last is larger than nothing.
    rises = np.zeros(n, bool)
    change = np.flatnonzero(data[:-1] != data[1:])
    nxt = np.searchsorted(change, np.arange(n))
    inside = nxt < len(change)
    at = change[nxt[inside]]
    rises[inside] = data[at] < data[at + 1]
    direct = np.flatnonzero(rises)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    direct = direct[np.argsort(np.ascontiguousarray(view[direct]).view(f"S{depth}").ravel(), kind="stable")]
    starts = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        new = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        induced = [new] if len(new) else []
        while len(new):  # runs of one byte induce within their own bucket
            before = new[new > 0] - 1
            new = before[(data[before] == c) & ~rises[before]]
            if len(new):
                induced.append(new)
        bucket = np.concatenate([*induced, direct[starts[c] : starts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~rises[before] & (data[before] > c)]
        if len(before):
            byte = data[before]
            order = np.argsort(byte, kind="stable")
            values, cut = np.unique(byte[order], return_index=True)
            for v, part in zip(values, np.split(before[order], cut[1:]), strict=True):
                waiting[v].append(part)
    return np.concatenate(out)


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of the suffixes at a and b has length bytes, eight compared at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    alive = np.arange(len(a))
    for off in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[a[alive] + off] == words[b[alive] + off]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each part the ranges of window starts whose window also starts elsewhere in these parts."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(parts)), sizes)
    good = np.arange(len(data)) + length <= ends[owner]
    order = suffix_order(data, length)
    order = order[good[order]]
    twin = same_prefix(data, order[:-1], order[1:], length)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[order[:-1][twin]] = 1
    mark[order[1:][twin]] = 1
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    # Runs of marked windows never go on from one part to the next: a part's last bytes start no window.
    edge = np.diff(np.concatenate([[0], mark]))
    for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        base = ends[owner[lo]] - sizes[owner[lo]]
        out[owner[lo]].append((int(lo - base), int(hi - base)))
    return out


_KEY = "doc long, th long"


def _key(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("th"), F.col("doc_id"), text.alias("text"))


def anchors(documents: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, at, n, off, h, c = contexts([t.as_py().encode() for t in batch.column(2)], length, gram)
            rows = pa.array(number, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(off, pa.int32()), pa.array(h, pa.int64()), pa.array(c, pa.int64())], names=["doc", "th", "at", "n", "off", "h", "c"])

    return _key(documents).select("doc", "th", "text").mapInArrow(run, f"{_KEY}, at int, n int, off int, h long, c long")


def packed(documents: DataFrame) -> DataFrame:
    """doc, th, doc_id and the text's bytes, packed, so that a shuffle by key moves half as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([own.compress(t.as_py().encode()) for t in batch.column(3)], pa.binary())], names=["doc", "th", "doc_id", "z"])

    return _key(documents).select("doc", "th", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{_KEY}, doc_id long, z binary")


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if len(z) else b""


def find(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, hottest: int = HOTTEST) -> DataFrame:
    """documents (doc_id, text) -> doc, th and ranges: array<struct<s, e>> of window starts that repeat."""
    every = anchors(documents, length, gram)
    twice = stored(every.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "twice")
    share = max(1, (twice.agg(F.sum("m")).first()[0] or 0) // HUBS)
    known = stored(spread_join(every, twice.select("h", "m"), ["h"], F.col("m") > share, ["doc", "th", "at"], "left_semi"), "anchors")
    groups = stored(known.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("doc", "th", "at", "n", "off")).alias("one")), "contexts")
    mixed = groups.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = max(1, groups.count() // HUBS)
    step = F.when(F.col("kinds") > hottest, 1).when(F.col("kinds") > hot, STEP).otherwise(0)
    one = spread_join(groups, mixed, ["h"], F.col("kinds") > kinds, ["c"]).select("h", "c", "one.*", step.alias("step"))
    wanted = one.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "c", "at", "n", "off", "step")).alias("wanted"))
    kind = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ["key", "d", "h", "c", "shift", "n", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(packed text, wanted) -> pieces; a piece without data repeats throughout."""
        seen: dict[bytes, tuple | None] = {}  # of pieces of hot anchors: the first, until a second one comes
        for batch in batches:
            out: list[tuple] = []
            for z, rows in zip(batch.column(0), batch.column(1), strict=True):
                text = _unpack(z.as_py())
                for r in rows.as_py():
                    a, n, step = r["at"], r["n"], r["step"]
                    if not step:
                        out.append((r["h"], 0, r["h"], r["c"], 0, n, text[a : a + n - 1 + length]))
                        continue
                    # Window w is off - w bytes before the anchor; step distances make a piece.
                    bounds = sorted({0, n, *(w for w in range(1, n) if (r["off"] - w) % step == step - 1)})
                    for lo, hi in zip(bounds, bounds[1:]):
                        own = text[a + lo : a + hi - 1 + length]
                        side = (r["off"] - lo) // step
                        start = a + r["off"] - side * step  # from here on all windows of such a piece agree
                        core = hashlib.blake2b(text[start : start + length - step + 1], digest_size=8, salt=side.to_bytes(4, "little"), key=r["h"].to_bytes(8, "little", signed=True)).digest()
                        whole = hashlib.blake2b(own, digest_size=16, key=core).digest()
                        key, d = int.from_bytes(core, "little", signed=True), int.from_bytes(whole[:8], "little", signed=True)
                        told = (r["h"], r["c"], lo, hi - lo, None)
                        if whole not in seen:
                            if len(seen) >= 1 << 20:
                                seen.clear()  # equal pieces then meet where they are sorted
                            seen[whole] = told
                            out.append((key, d, *told[:-1], own))
                            continue
                        first, seen[whole] = seen[whole], None
                        out += [(key, d, *x) for x in (first, told) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kind)], names=names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, sorted by key and d -> ranges of windows that repeat."""
        rows: list[tuple] = []
        ready: list[tuple] = []  # ranges of pieces that equal another one
        size, last, twin = 0, None, False

        def work() -> pa.RecordBatch:
            found = [(h, c, s + shift, e + shift) for (_, _, h, c, shift, _, _), ranges in zip(rows, repeated([r[6] for r in rows], length), strict=True) for s, e in ranges] if rows else []
            found += ready
            rows.clear()
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "c", "s", "e"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                _, _, h, c, shift, n, data = row
                if data is None:
                    ready.append((h, c, shift, shift + n))
                elif rows and row[:2] == rows[-1][:2] and data == rows[-1][6]:
                    ready.append((h, c, shift, shift + n))
                    if not twin:
                        ready.append((rows[-1][2], rows[-1][3], rows[-1][4], rows[-1][4] + n))
                    twin = True
                else:
                    if row[0] != last and size >= SORTED:
                        yield work()
                        size = 0
                    rows.append(row)
                    size, last, twin = size + len(data), row[0], False
                if len(ready) >= 1 << 16:
                    held, rows[:] = rows[:], []
                    yield work()
                    rows[:] = held
        if rows or ready:
            yield work()

    pieces = packed(documents).select("doc", "th", "z").join(wanted, ["doc", "th"])
    pieces = pieces.select("z", "wanted").mapInArrow(cut, "key long, d long, h long, c long, shift int, n int, data binary")
    dealt = pieces.repartition(F.when(F.col("data").isNull(), F.xxhash64("h", "c", "shift")).otherwise(F.col("key"))).sortWithinPartitions("key", "d")
    ranges = dealt.mapInArrow(sort, "h long, c long, s int, e int")
    shared = ranges.groupBy("h", "c").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("one.n").alias("e")))
    table = groups.join(shared, ["h", "c"], "left").select("h", "c", "m", F.when(F.col("m") > 1, whole).otherwise(F.col("ranges")).alias("ranges")).where("ranges is not null")
    hits = spread_join(known.select("h", "c", "doc", "th", "at"), stored(table, "ranges"), ["h", "c"], F.col("m") > share, ["doc", "th", "at"])
    moved = F.transform("ranges", lambda r: F.struct((F.col("at") + r["s"]).alias("s"), (F.col("at") + r["e"]).alias("e")))
    return hits.select("doc", "th", moved.alias("r")).groupBy("doc", "th").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def merged(ranges: Iterable[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Ranges of window starts -> maximal removed runs of bytes."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e - 1 + length)
        else:
            out.append([s, e - 1 + length])
    return [(a, b) for a, b in out]


def remove(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, hottest: int = HOTTEST, form: str = "digest") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (form 'digest'), or doc_id, removed (array<struct<s, e>>, in
    bytes) and kept (binary) (form 'bytes'); one row a row."""
    ranges = find(documents, length, gram, hot, hottest)
    joined = packed(documents).join(ranges, ["doc", "th"], "left").select("doc_id", "z", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for z, r in zip(batch.column(1), batch.column(2), strict=True):
                text, kept, at = _unpack(z.as_py()), [], 0
                gone = merged(((x["s"], x["e"]) for x in r.as_py() or ()), length)
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                told = (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()) if form == "digest" else ([{"s": a, "e": b} for a, b in gone], kept)
                for c, v in zip(cols, told):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string()) if form == "digest" else (pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary())
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256") if form == "digest" else ("removed", "kept")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if form == "digest" else "doc_id long, removed array<struct<s:bigint,e:bigint>>, kept binary")
