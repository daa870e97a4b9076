"""An index as plain Parquet tables under one folder, with versions.

Each batch is a segment with docs, postings (field, term, doc_id, len, freq, positions) and term statistics. Postings
and statistics lie in buckets by a checksum of the term, each in files of its own and sorted by term, so a term query opens
the files of one bucket and the row groups of its term. A version is one small JSON file that names segments and tombstones with their counts;
it is written under another name and renamed, so a reader sees a version whole or not at all, and a writer that dies
leaves nothing in the way. Deletes are tombstones (segment, doc_id) with the term statistics of what they delete; merges
drop them for good.

A batch's postings are made where its rows are: a document's terms are cut, sorted and grouped within its Arrow batch,
so the only shuffle is the one that brings terms to their bucket.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import index_terms
from ..functions.scoring import norm
from ..plans.compile import Modes, Stats, over_postings
from ..plans.query import Phrase, Query, Term, leaves
from ..scratch import spread
from .search import finite, ranked

POSTINGS = "field string, term string, doc_id long, len int, freq int, positions array<int>"
TERMS = "field string, term string, df long, ttf long"
#: Bytes of stored documents for each bucket and for each file of a bucket; buckets at most.
BUCKET_BYTES, FILE_BYTES, MOST_BUCKETS = 32 << 20, 256 << 20, 4096
#: Rows of the Arrow batches that postings are cut from, and the tokens that are sorted at once (a document's at least).
BATCH_ROWS, BATCH_TOKENS = 128, 1 << 18
#: Rows of a join that meet in one task, and deleted rows that are broadcast.
JOIN_ROWS, FEW_DEAD = 1 << 19, 1 << 17


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes add up to ``most`` at most; a larger row is a run of its own."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, "right")))
        yield a, b
        a = b


def postings_of(df: DataFrame, key: str, field: str, terms=index_terms) -> DataFrame:
    """(doc_id, field, term, len, freq, positions) of one text column, without a shuffle; len is the field's length."""

    def cut(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        words = batch.column(1).flatten().dictionary_encode()  # null lists have no words
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(doc * max(1, len(words.dictionary)) + code, kind="stable")
        doc, code, at = doc[order], code[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(first, len(doc)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(doc[first])),
                pa.array([field], pa.string()).take(pa.array(np.zeros(len(first), np.int64))),
                words.dictionary.take(pa.array(code[first])),
                pa.array(sizes[doc[first]].astype(np.int32)),
                pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))),
            ],
            names=["doc_id", "field", "term", "len", "freq", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in pieces(sizes, BATCH_TOKENS):
                yield cut(batch.slice(a, b - a), sizes[a:b])

    kind = df.schema[key].dataType.simpleString()
    texts = spread(df.select(F.col(key).alias("doc_id"), F.col(field).alias("t")), "doc_id")
    # Left set, as the plan may run later: a worker's memory must not depend on how many rows its task has.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return texts.select("doc_id", terms(F.col("t")).alias("t")).mapInArrow(run, f"doc_id {kind}, field string, term string, len int, freq int, positions array<int>")


def lengths_of(df: DataFrame, key: str, field: str, terms=index_terms) -> DataFrame:
    n = F.coalesce(F.size(terms(F.col(field))), F.lit(0))
    return df.select(F.col(key).alias("doc_id"), F.lit(field).alias("field"), n.alias("len"), norm(n).alias("norm"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("freq").alias("ttf"))


def field_stats(lengths: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents, documents with the field, tokens and postings of each field."""
    a = lengths.groupBy("field").agg(F.count("*").alias("max_doc"), F.count_if(F.col("len") > 0).alias("doc_count"), F.sum("len").alias("sum_ttf"))
    b = postings.groupBy("field").agg(F.count("*").alias("sum_df"), F.countDistinct("term").alias("terms"))
    return a.join(b, "field", "left").select("field", "max_doc", "doc_count", "sum_ttf", F.coalesce("sum_df", F.lit(0)).alias("sum_df"), F.coalesce("terms", F.lit(0)).alias("terms"))


def seek_ceil(stats: DataFrame, field: str, term: str) -> DataFrame:
    """The first term of a field that is not below ``term``."""
    return stats.where((F.col("field") == field) & (F.col("term") >= term)).orderBy("term").limit(1)


def seek_exact(stats: DataFrame, field: str, term: str) -> DataFrame:
    """The row of a term, none if the field does not have it."""
    return stats.where((F.col("field") == field) & (F.col("term") == term))


def terms_after(stats: DataFrame, field: str, term: str | None, n: int) -> DataFrame:
    """The next n terms of a field after ``term`` (from the first on, if None), in order."""
    own = stats.where(F.col("field") == field)
    return (own if term is None else own.where(F.col("term") > term)).orderBy("term").limit(n)


#: The name of a file: its number is that of the task that wrote it.
NUMBER = re.compile(r"part-(\d+)-")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of up to so many rows, in parts of JOIN_ROWS by its keys. Parts that Spark makes have so many bytes as they are
    packed, and ids pack so well that one part may have tens of millions of rows."""
    return df if rows <= JOIN_ROWS else df.repartition(-(-rows // JOIN_ROWS), *keys)


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


# --- versions --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """A segment, or a tombstone (with the segments it is about): its rows, its bytes and, by field, docs with it and tokens."""

    name: str
    docs: int
    size: int = 0
    buckets: int = 1
    files: int = 1  # of a bucket's postings
    fields: dict = field(default_factory=dict, hash=False, compare=False)
    schema: str = ""
    about: tuple[str, ...] = ()


@dataclass(frozen=True)
class Version:
    number: int
    segments: tuple[Part, ...] = ()
    tombstones: tuple[Part, ...] = ()
    batches: tuple[tuple[str, int], ...] = ()  # the last batch of each source that is in

    def text(self) -> str:
        part = lambda p: {**vars(p), "about": list(p.about)}
        return json.dumps({"number": self.number, "segments": [part(p) for p in self.segments], "tombstones": [part(p) for p in self.tombstones], "batches": dict(self.batches)})

    @classmethod
    def read(cls, text: str) -> Version:
        d = json.loads(text)
        part = lambda p: Part(**{**p, "about": tuple(p["about"])})
        return cls(d["number"], tuple(map(part, d["segments"])), tuple(map(part, d["tombstones"])), tuple(d["batches"].items()))


class Overtaken(RuntimeError):
    """Another writer committed what this commit cannot be joined with."""


class Folder:
    """The files of an index, through Hadoop's file systems, so the folder may be in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def fs(self):
        return self.at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        fs = self.fs
        return [s.getPath().getName() for s in fs.listStatus(self.at(folder))] if fs.exists(self.at(folder)) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Whether the file is new: it is written elsewhere and renamed, which fails if another writer was first."""
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs, goal = self.fs, self.at(name)
        fs.mkdirs(goal.getParent())
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, goal, none)
        except Exception:
            if fs.exists(goal):
                fs.delete(draft, False)
                return False
            raise
        return True


# --- reading ---------------------------------------------------------------------------------------------------------


class Snapshot:
    """One version of an index; what is committed later does not change it."""

    def __init__(self, spark: SparkSession, path: str, version: Version, text: tuple[str, ...], modes: Modes, deletes: str):
        self.spark, self.path, self.version, self.text, self.modes, self.deletes = spark, path, version, text, modes, deletes
        self.folder = Folder(spark, path)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    @property
    def dead(self) -> DataFrame | None:
        parts = [f"{self.path}/tombstones/{t.name}/ids" for t in self.version.tombstones if t.docs]
        return self.spark.read.schema("segment string, doc_id long").parquet(*parts) if parts else None

    def _live(self, df: DataFrame, rows: int) -> DataFrame:
        """df, of up to so many rows, without deleted ones."""
        dead = self.dead
        if dead is None or self.deletes != "immediate":
            return df
        gone, keys = sum(t.docs for t in self.version.tombstones), ("segment", "doc_id")
        if gone <= FEW_DEAD:
            return df.join(F.broadcast(dead), list(keys), "left_anti")
        if max(rows, gone) <= JOIN_ROWS:
            return df.join(dead, list(keys), "left_anti")
        # An anti join would be pushed into the union of the segments, and all their joins would run in one task at once.
        dead = dealt(dead, max(rows, gone), *keys).distinct().withColumn("__dead", F.lit(True))
        return dealt(df, max(rows, gone), *keys).join(dead.hint("shuffle_hash"), list(keys), "left").where("__dead is null").drop("__dead")

    @property
    def stored(self) -> DataFrame:
        """All rows with the segment they are in, deleted ones too."""
        tables = [self.spark.read.schema(T.StructType.fromJson(json.loads(s.schema))).parquet(f"{self.path}/segments/{s.name}/docs").withColumn("segment", F.lit(s.name)) for s in self.version.segments]
        if not tables:
            return self._empty(", ".join(["doc_id long", *(f"`{c}` string" for c in self.text), "segment string"]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

    @property
    def docs(self) -> DataFrame:
        return self._live(self.stored, self.max_doc()).drop("segment")

    def _buckets(self, parts: Iterable[Part], kind: str, table: str, terms: list[str] | None) -> list[tuple[str, list[str]]]:
        """For each part the files of a table that hold these terms (all of its files, if None). A file has its number in its name."""
        out = []
        for p in parts:
            files = p.files if table == "postings" else 1
            wanted = None if terms is None else {bucket_of(t, p.buckets) * files + i for t in terms for i in range(files)}
            names = [(n, NUMBER.match(n)) for n in self.folder.names(f"{kind}/{p.name}/{table}")]
            out.append((p.name, sorted(f"{self.path}/{kind}/{p.name}/{table}/{n}" for n, m in names if m and (wanted is None or int(m[1]) in wanted))))
        return [(n, x) for n, x in out if x]

    def postings(self, field: str, terms: list[str] | None = None) -> DataFrame:
        """(field, term, doc_id, len, freq, positions) of the given terms of a field, of all its terms if None."""
        tables = [self.spark.read.schema(POSTINGS).parquet(*paths).withColumn("segment", F.lit(name)) for name, paths in self._buckets(self.version.segments, "segments", "postings", terms)]
        every = reduce(DataFrame.unionByName, tables) if tables else self._empty(f"{POSTINGS}, segment string")
        every = every.where(F.col("field") == field)
        rows = self.max_doc() * len(terms) if terms is not None else sum(s.fields.get(field, {}).get("sum_ttf", 0) for s in self.version.segments)
        return self._live(every if terms is None else every.where(F.col("term").isin(terms)), rows).drop("segment")

    def terms(self, field: str, terms: list[str] | None = None) -> DataFrame:
        """(field, term, df, ttf) of the live documents, from the statistics of segments and tombstones; nothing is counted."""
        tables = [self.spark.read.schema(TERMS).parquet(*paths) for _, paths in self._buckets(self.version.segments, "segments", "terms", terms)]
        if self.deletes == "immediate":
            gone = [self.spark.read.schema(TERMS).parquet(*paths) for _, paths in self._buckets(self.version.tombstones, "tombstones", "terms", terms)]
            tables += [t.select("field", "term", (-F.col("df")).alias("df"), (-F.col("ttf")).alias("ttf")) for t in gone]
        every = reduce(DataFrame.unionByName, tables) if tables else self._empty(TERMS)
        every = every.where(F.col("field") == field)
        every = every if terms is None else every.where(F.col("term").isin(terms))
        return every.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf")).where("df > 0")

    def max_doc(self) -> int:
        return sum(s.docs for s in self.version.segments)

    def num_docs(self) -> int:
        return self.max_doc() - sum(t.docs for t in self.version.tombstones)

    def _seen(self) -> int:
        return self.num_docs() if self.deletes == "immediate" else self.max_doc()

    def field_stats(self, field: str) -> dict[str, int]:
        """Documents with the field and its tokens, of the live documents."""
        gone = self.version.tombstones if self.deletes == "immediate" else ()
        return {k: sum(p.fields.get(field, {}).get(k, 0) for p in self.version.segments) - sum(p.fields.get(field, {}).get(k, 0) for p in gone) for k in ("doc_count", "sum_ttf")}

    def statistics(self, query: Query) -> Stats:
        """What scores need: numbers of the version, and one small read of the query's terms."""
        wanted = [(q.field, t) for q in leaves(query) if isinstance(q, (Term, Phrase)) for t in ([q.text] if isinstance(q, Term) else q.terms)]
        stats = Stats(self._seen())
        for f in {f for f, _ in wanted}:
            terms = sorted({t for g, t in wanted if g == f})
            if f in self.text:
                stats.tokens[f] = self.field_stats(f)["sum_ttf"]
                stats.df |= {(f, r["term"]): r["df"] for r in self.terms(f, terms).collect()}
            else:
                stats.df |= {(f, r["v"]): r["n"] for r in self.docs.select(F.col(f).cast("string").alias("v")).where(F.col("v").isin(terms)).groupBy("v").agg(F.count("*").alias("n")).collect()}
        return stats

    def hits(self, query: Query) -> DataFrame:
        query = query.normalise()
        return finite(over_postings(query, self, self.statistics(query), self.modes))

    def match(self, query: Query) -> DataFrame:
        return self.docs.join(over_postings(query.normalise(), self, None, self.modes).select("doc_id"), "doc_id", "left_semi")

    def search(self, query: Query, k: int, start: int = 0, after=None, after_mode: str = "keyset") -> DataFrame:
        return ranked(self.hits(query), k, start, after, after_mode)

    def count(self, query: Query) -> int:
        """Of one term of a text field, its kept statistics; else a count of the matches."""
        query = query.normalise()
        if isinstance(query, Term) and query.field in self.text:
            row = self.terms(query.field, [query.text]).first()
            return row["df"] if row else 0
        return over_postings(query, self, None, self.modes).count()

    def fetch(self, hits: DataFrame) -> DataFrame:
        """The stored columns of hits."""
        return hits.join(self.docs, "doc_id")


# --- writing ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    """What a writer has not committed yet, as a change to whatever version is the latest when it does."""

    added: tuple[Part, ...] = ()
    tombstones: tuple[Part, ...] = ()
    removed: tuple[str, ...] = ()
    known: tuple[str, ...] = ()  # the tombstones that what replaces the removed segments has taken in
    batches: tuple[tuple[str, int], ...] = ()

    def on(self, v: Version) -> Version:
        names, gone = {s.name for s in v.segments}, set(self.removed)
        late = [t.name for t in v.tombstones if t.name not in self.known and gone & set(t.about)]
        about = {a for t in self.tombstones for a in t.about}
        if not gone <= names or late or not about - {a.name for a in self.added} <= names - gone:
            raise Overtaken("a segment that this commit replaces or deletes from was changed by another one")
        segments = (*(s for s in v.segments if s.name not in gone), *self.added)
        left = {s.name for s in segments}
        tombstones = tuple(t for t in (*v.tombstones, *self.tombstones) if left & set(t.about))
        return Version(v.number + 1, segments, tombstones, tuple((dict(v.batches) | dict(self.batches)).items()))


class Index:
    """A folder to write to. key names the id column; text the columns that are cut into terms."""

    def __init__(self, spark: SparkSession, path: str, text: tuple[str, ...] = ("text",), key: str = "doc_id", mode: str = "create_or_append", modes: Modes = Modes(), deletes: str = "immediate", terms=index_terms, codec: str = "zstd"):
        self.spark, self.path, self.text, self.key, self.modes, self.deletes, self.terms, self.codec = spark, path.rstrip("/"), tuple(text), key, modes, deletes, terms, codec
        self.folder, self.pending = Folder(spark, path), Change()
        if mode not in ("create", "append", "create_or_append"):
            raise ValueError(f"no such mode: {mode!r}")
        there = self._latest() is not None
        if mode == "append" and not there:
            raise FileNotFoundError(f"no index at {path}")
        if mode == "create" and there:
            self.folder.fs.delete(self.folder.at(""), True)
        if self._latest() is None:
            self.folder.publish(self._file(0), Version(0).text())

    def writer(self) -> Index:
        """Another writer of this index, without what is pending here."""
        return Index(self.spark, self.path, self.text, self.key, "append", self.modes, self.deletes, self.terms, self.codec)

    @staticmethod
    def _file(number: int) -> str:
        return f"versions/{number:08d}.json"

    def _latest(self) -> int | None:
        return max((int(n[:-5]) for n in self.folder.names("versions") if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def version(self, number: int | None = None) -> Version:
        return Version.read(self.folder.read(self._file(self._latest() if number is None else number)))

    def _tables(self, docs: DataFrame, place: str, files: int, buckets: int) -> dict:
        """Writes postings and term statistics of stored documents; returns, by field, the documents that have it and its tokens.

        A task writes one file, of the bucket that its number names; a bucket's postings may be in several files, dealt by
        document, so that a frequent term is in all of them.
        """
        told, bucket = {}, F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(buckets)).cast("int")
        for i, f in enumerate(self.text):
            p = postings_of(docs, "doc_id", f, self.terms).select("field", "term", F.col("doc_id").cast("long").alias("doc_id"), "len", "freq", "positions")
            number = bucket * files + F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int")
            mode, seen = "append" if i else "errorifexists", Observation()
            # Observed in the stage that writes, where a task that runs again counts once. The shares freq / len of a
            # document add up to 1.
            p = p.repartitionById(buckets * files, number).sortWithinPartitions("term", "doc_id").observe(seen, F.sum("freq").alias("sum_ttf"), F.sum(F.col("freq") / F.col("len")).alias("docs"))
            p.write.option("compression", self.codec).mode(mode).parquet(f"{self.path}/{place}/postings")
            there = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{place}/postings").where(F.col("field") == f)
            stats = there.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("freq").alias("ttf"))
            stats.repartitionById(buckets, bucket).sortWithinPartitions("term").write.option("compression", self.codec).mode(mode).parquet(f"{self.path}/{place}/terms")
            told[f] = {"doc_count": round(seen.get["docs"] or 0), "sum_ttf": seen.get["sum_ttf"] or 0}
        return told

    def _segment(self, df: DataFrame) -> Part:
        name = uuid.uuid4().hex
        place = f"segments/{name}"
        docs = df.withColumnRenamed(self.key, "doc_id") if self.key != "doc_id" else df
        seen = Observation()
        spread(docs, "doc_id").observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", self.codec).parquet(f"{self.path}/{place}/docs")
        docs = self.spark.read.schema(docs.schema).parquet(f"{self.path}/{place}/docs")
        size = self.folder.size(f"{place}/docs")
        buckets = min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))
        files = max(1, -(-size // (FILE_BYTES * buckets)))
        told = self._tables(docs, place, files, buckets)
        return Part(name, seen.get["n"], self.folder.size(place), buckets, files, told, docs.schema.json())

    def add(self, df: DataFrame, source: str | None = None, batch: int = 0) -> Index:
        """Writes a batch as a segment; commit() makes it seen. A batch of a source that was committed before is not
        added again, so a retry changes nothing."""
        if source is not None:
            if dict(self.version().batches).get(source, -1) >= batch:
                return self
            self.pending = replace(self.pending, batches=(*self.pending.batches, (source, batch)))
        self.pending = replace(self.pending, added=(*self.pending.added, self._segment(df)))
        return self

    def _snapshot(self, version: Version, deletes: str) -> Snapshot:
        return Snapshot(self.spark, self.path, version, self.text, self.modes, deletes)

    def delete(self, query: Query) -> Index:
        """Deletes what matches in the committed segments; batches that are still pending are not touched."""
        v = self.version()
        every = self._snapshot(replace(v, tombstones=(*v.tombstones, *self.pending.tombstones)), "immediate")
        if not v.segments:
            return self
        # Distinct keys in an inner join: a semi join would be pushed into the union of the segments.
        n = every.max_doc()
        keys = dealt(over_postings(query.normalise(), every, None, self.modes).select("doc_id"), n, "doc_id").distinct()
        keys = keys.hint("shuffle_hash") if n > JOIN_ROWS else keys
        name = uuid.uuid4().hex
        place = f"tombstones/{name}"
        rows = dealt(every._live(every.stored, n), n, "doc_id").join(keys, "doc_id").select("segment", "doc_id", *self.text)
        rows.write.parquet(f"{self.path}/{place}/rows")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{place}/rows")
        counts = {r["segment"]: r["count"] for r in rows.groupBy("segment").count().collect()}  # a row a segment
        if counts:
            rows.select("segment", "doc_id").write.parquet(f"{self.path}/{place}/ids")
            size = self.folder.size(f"{place}/rows")
            buckets = min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))
            told = self._tables(rows, place, 1, buckets)
            self.pending = replace(self.pending, tombstones=(*self.pending.tombstones, Part(name, sum(counts.values()), 0, buckets, 1, told, "", tuple(sorted(counts)))))
        self.folder.fs.delete(self.folder.at(f"{place}/rows"), True)
        return self

    def update(self, query: Query, df: DataFrame) -> Index:
        return self.delete(query).add(df)

    def commit(self) -> int:
        """Makes all pending batches, deletes and merges one new version, on top of what others committed meanwhile;
        raises Overtaken if these took away what this one builds on. Returns the version's number."""
        while True:
            v = self.version()
            if self.pending == Change():
                return v.number
            new = self.pending.on(v)
            if self.folder.publish(self._file(new.number), new.text()):
                self.pending = Change()
                return new.number

    def rollback(self) -> Index:
        self.pending = Change()
        return self

    def merge(self, groups: Iterable[Iterable[str]]) -> int:
        """Each group of segments becomes one, without its deleted rows; one commit. Pending batches are committed first."""
        self.commit()
        v = self.version()
        change = Change(known=tuple(t.name for t in v.tombstones))
        for names in map(set, groups):
            own = tuple(s for s in v.segments if s.name in names)
            if len(own) != len(names):
                raise Overtaken(f"no such segments: {sorted(names - {s.name for s in own})}")
            live = self._snapshot(replace(v, segments=own), "immediate").docs
            made = self._segment(live)
            change = replace(change, removed=(*change.removed, *sorted(names)), added=(*change.added, *((made,) if made.docs else ())))
        self.pending = change
        return self.commit()

    def compact(self, most: int = 1) -> int:
        """Merges until ``most`` segments or fewer are left and no deleted row is; pending batches are committed first.

        The largest segments stay as they are, if nothing was deleted from them; the smallest are merged into one. Without
        a need for it nothing is written.
        """
        if most < 1:
            raise ValueError("most must be above 0")
        self.commit()
        v = self.version()
        holed = {a for t in v.tombstones for a in t.about}
        order = sorted(v.segments, key=lambda s: (s.size, s.name))
        surplus = len(order) - most
        small = [s.name for s in order[: surplus + 1]] if surplus > 0 else []
        groups = ([small] if small else []) + [[s.name] for s in order if s.name in holed and s.name not in small]
        return self.merge(groups) if groups else v.number

    def merge_tiers(self, planner) -> list[list[str]]:
        """Merges what a planner (sizes by name -> groups of names) asks for; returns the groups."""
        self.commit()
        groups = planner.plan({s.name: s.size for s in self.version().segments})
        if groups:
            self.merge(groups)
        return groups

    def open(self, number: int | None = None) -> Snapshot:
        return self._snapshot(self.version(number), self.deletes)

    def reopen(self, old: Snapshot) -> Snapshot:
        """old itself if nothing was committed since."""
        return old if old.version.number == self._latest() else self.open()
