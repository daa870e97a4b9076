"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: over a bounded sample of labelled rows, words and word beginnings are counted by the label of
their documents, and those that toxic documents use far more often become entries, weighted by their log odds. A text's
features are densities of these entries, how near they stand to the second person, rates of capitals and punctuation,
and signs of obfuscation (letters parted or replaced by symbols). The trees are fitted on one part of the sample and
calibrated by isotonic regression on the rest. Only text goes into a score.

Cases: a null or empty text has all features 0 and gets a score like any other; a document with several labels counts
as toxic if one says so; null labels do not count, nor do labels of other values than 0 and 1; of rows that repeat a
labelled id one is learned from, the first by a hash of its text; without both classes in the sample every score is the
base rate (0 without labels). Rows stay as they are, repeated or not; an empty table gives an empty result; a text of any
length is one row. reject() keeps all columns, whatever their names; score() those in ``keep``, which may not hold score.
Scale: the sample (``sample`` ids at most, the first by a hash) and the lexicon (``entries`` at most) are bounded, and so
is all that is broadcast or collected; the sample is stored once, and scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import stored

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
PUNCTUATION, SYMBOLS, DIGITS = b"!?", b"@#$%&*^~_|", b"0123456789"
OBFUSCATED = re.compile(r"[^\W\d_][@#$%&*^~._|0-9-]{1,3}[^\W\d_]")
# Second-person words of the corpus's languages.
SECOND = frozenset("you your yours yourself u ur tu toi te vous votre vos ton ta tes du dich dir dein deine ihr euch euer usted ustedes tú ti vosotros".split())
NEAR = 6
FEATURES = ("words", "density", "hits", "distinct", "strongest", "weight", "stem_density", "stem_hits", "stem_strongest", "second", "near", "capitals", "punctuation", "symbols", "digits", "obfuscated", "hidden")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


class Lexicon:
    """Entries with their weights: whole words, and beginnings of longer words."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words, raw = WORD.findall(low), text.encode()
        n, size = max(1, len(words)), max(1, len(raw))
        get, stem = self.words.get, self.stems.get
        hits = [i for i, w in enumerate(words) if w in self.words]
        at = [get(words[i]) for i in hits]
        stems = [max(x) for w in set(words) if len(w) > 4 and (x := [v for k in STEMS if (v := stem(w[:k]))])] if self.stems else []
        second = [i for i, w in enumerate(words) if w in SECOND] if hits else []
        near = 0
        if second:
            own = np.array(second)
            near = sum(int(np.abs(own - i).min() <= NEAR) for i in hits)
        parted = OBFUSCATED.findall(low)
        hidden = 0
        if parted:
            hidden = sum(1 for w in set(re.findall(r"\S+", low)) if not w.isalpha() and get(re.sub(r"[\W\d_]", "", w)) and w.strip(".,;:!?\"'()$%&*#") not in self.words)
        return [
            math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), math.log1p(len({words[i] for i in hits})), max(at, default=0.0), math.log1p(sum(at)),
            len(stems) / n, math.log1p(len(stems)), max(stems, default=0.0), len(second) / n, math.log1p(near),
            (size - len(raw.translate(None, UPPER))) / size, (size - len(raw.translate(None, PUNCTUATION))) / size, (size - len(raw.translate(None, SYMBOLS))) / size,
            (size - len(raw.translate(None, DIGITS))) / size, len(parted) / n, math.log1p(hidden),
        ]


def learn_lexicon(sample: DataFrame, entries: int, least: int = 3, odds: float = 2.0) -> Lexicon:
    """sample (text, toxic). Entries stand in ``least`` toxic documents or more, at log odds of ``odds`` or more."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                words, y = set(WORD.findall((text.as_py() or "").lower())), int(toxic.as_py())
                for key in [(w, False) for w in words] + list({(w[:k], True) for w in words for k in STEMS if len(w) > k}):
                    seen.setdefault(key, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["entry", "stem", "bad", "good"])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon({}, {})
    c = sample.select("text", "toxic").mapInArrow(parts, "entry string, stem boolean, bad long, good long").groupBy("entry", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    c = c.withColumn("odds", F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))).where((F.col("bad") >= least) & (F.col("odds") >= odds))
    rows = c.orderBy(F.desc(F.col("odds") * F.log1p("bad")), "entry", "stem").limit(entries).collect()
    return Lexicon({r["entry"]: r["odds"] for r in rows if not r["stem"]}, {r["entry"]: r["odds"] for r in rows if r["stem"]})


class Scorer:
    def __init__(self, lexicon: Lexicon, model: boosting.Boosted):
        self.lexicon, self.model = lexicon, model

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts])
        return np.clip(self.model.predict(x), 0.0, 1.0) if len(x) else np.zeros(0)


def train(documents: DataFrame, labels: DataFrame, sample: int = 16_000, entries: int = 20_000) -> Scorer:
    """Fits on labelled rows that are not held out: up to ``sample`` of them, the first by a hash of doc_id.

    Half of them make the lexicon, the other half trees and calibration, so the trees see how far the lexicon holds for
    texts it was not made from.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(sample).withColumn("part", part)
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # of up to `sample` pairs of numbers
    rows = rows.groupBy("doc_id", "toxic", "part").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    rows = stored(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.col("part").cast("long").alias("part"), "first.text"), "labelled")
    lexicon = learn_lexicon(rows.where("part < 2"), entries)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "part", "x"])

    got = rows.where("part >= 2").select("doc_id", "toxic", "part", "text").mapInArrow(measure, "doc_id long, toxic int, part long, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y, p = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([float(r["toxic"]) for r in got]), np.array([r["part"] for r in got])
    model = boosting.fit(x[p == 2], y[p == 2]) if (p == 2).any() else boosting.Boosted(start=-30.0)
    if (p == 3).any() and len(model.trees):
        boosting.calibrate(model, x[p == 3], y[p == 3])
    return Scorer(lexicon, model)


def _scored(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """rows (row, text) -> row, score."""
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value.scores([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def reject(documents: DataFrame, scorer: Scorer, least: float = 0.7) -> DataFrame:
    """documents without those that score ``least`` or more; same columns."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text")
    return _scored(rows, scorer).where(F.col("score") < least).select("row.*")


def score(documents: DataFrame, scorer: Scorer, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 is likelier) to the columns in keep."""
    keep = list(keep)
    if "score" in keep:
        raise ValueError("the column score is added")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    return _scored(rows, scorer).select("row.*", "score")
