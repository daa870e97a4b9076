"""Searches: hits, ranked pages, counts and aggregations over what matches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.analysis import index_terms
from ..plans.compile import Modes, Stats, frequency, over_rows
from ..plans.query import Bool, Fuzzy, Phrase, Query, Range, Term, Wildcard, leaves
from ..scratch import spread, stored


#: Leaves that look at the terms of a text.
CUT = (Term, Phrase, Wildcard, Fuzzy)


@dataclass(frozen=True)
class After:
    """The last hit of the page before."""

    score: float
    doc_id: int


def _demanded(query: Query, text: tuple[str, ...]) -> list[Query]:
    """Clauses over plain columns that every hit must match."""
    if isinstance(query, Range) or isinstance(query, Term) and query.field not in text:
        return [query]
    if isinstance(query, Bool) and not (query.must and query.should):
        return [x for q in (*query.must, *query.filter) for x in _demanded(q, text)]
    return []


class Corpus:
    """A DataFrame to search: its key, its text columns and how they are cut into terms."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: tuple[str, ...] = ("text",), terms: Callable[[Column], Column] = index_terms, modes: Modes = Modes()):
        self.key, self.text, self.modes = key, tuple(text), modes
        self.docs = df
        self.tokens = {c: terms(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c) for c in self.text}

    def _prepared(self, used: set[str], query: Query | None = None) -> tuple[DataFrame, dict[str, Column]]:
        """Rows with their terms. What the query demands of plain columns goes first, where it reaches the scan.

        A text is cut once a row, however many clauses ask: the optimizer would copy the cutting into a filter on its
        result and into every use, but it never copies what counts as non-deterministic, as a row number does.
        """
        df = self.docs
        for clause in _demanded(query, self.text) if query is not None else ():
            df = df.where(over_rows(clause, df, {}, None, self.modes)[0])
        df = spread(df, self.key) if used else df
        for c in sorted(used):
            terms = F.coalesce(self.tokens[c], F.array().cast("array<string>"))
            df = df.withColumn(f"__terms_{c}", F.when(F.monotonically_increasing_id() >= 0, terms))
        return df, {c: F.col(f"__terms_{c}") for c in used}

    def match(self, query: Query) -> DataFrame:
        """The rows that match, with all their columns and no score."""
        query = query.normalise()
        used = {q.field for q in leaves(query) if isinstance(q, CUT) and q.field in self.text}
        df, tokens = self._prepared(used, query)
        return df.where(over_rows(query, df, tokens, None, self.modes)[0]).select(*self.docs.columns)

    def _measured(self, query: Query) -> tuple[DataFrame, Stats, dict[Query, tuple[Column, Column]]]:
        """The rows that match a query with terms, as key and what each leaf counts in them, and the statistics of all rows.

        One pass over the texts: the counts of a row decide whether it is kept, and the numbers that scores need of all
        rows (documents, tokens, documents of each term) are observed as the rows go by. What is kept, a few numbers a
        hit, is stored, so nothing is cut or counted again.
        """
        own = list(dict.fromkeys(leaves(query)))
        wanted = list(dict.fromkeys(Term(q.field, t) for q in own if isinstance(q, (Term, Phrase)) for t in ([q.text] if isinstance(q, Term) else q.terms)))
        fields = sorted({q.field for q in own if isinstance(q, CUT) and q.field in self.text})
        plain = sorted({q.field for q in own if hasattr(q, "field")} - set(fields) - {self.key})
        df = spread(self.docs.select(*[f"`{c}`" for c in (self.key, *fields, *plain)]), self.key)
        tokens = {c: F.col(f"__terms_{c}") for c in fields}
        for c in fields:  # cut once a row: the optimizer never copies what counts as non-deterministic, as a row number does
            terms = F.coalesce(self.tokens[c], F.array().cast("array<string>"))
            df = df.withColumn(f"__terms_{c}", F.when(F.monotonically_increasing_id() >= 0, terms))
        counted = [q for q in dict.fromkeys([*own, *wanted]) if isinstance(q, (Term, Phrase))]
        ranges = [q for q in own if isinstance(q, (Range, Wildcard, Fuzzy))]
        columns = [frequency(q, df, tokens)[0] for q in counted] + [over_rows(q, df, tokens, None, self.modes)[0].cast("int") for q in ranges]
        known = {q: (F.col(f"__f{i}"), F.col(f"__n_{q.field}") if q.field in tokens else F.lit(1)) for i, q in enumerate([*counted, *ranges])}
        df = df.select(self.key, *[F.size(tokens[c]).alias(f"__n_{c}") for c in fields], *[c.alias(f"__f{i}") for i, c in enumerate(columns)])
        seen = Observation()
        sums = [F.coalesce(F.sum(f"__n_{c}"), F.lit(0)).alias(f"n_{c}") for c in fields]
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), *sums, *[F.count_if(known[q][0] > 0).alias(f"df_{i}") for i, q in enumerate(wanted)])
        # Not a constant, even where no row can match: an empty plan would observe nothing.
        keep = F.when(F.monotonically_increasing_id() >= 0, over_rows(query, df, {}, None, self.modes, known)[0])
        kept = stored(df.where(keep), "hits")
        got = seen.get
        return kept, Stats(got["n"], {c: got[f"n_{c}"] for c in fields}, {(q.field, q.text): got[f"df_{i}"] for i, q in enumerate(wanted)}), known

    def hits(self, query: Query) -> DataFrame:
        """(key, score) of every row that matches. These scores are finite; for others there is finite()."""
        query = query.normalise()
        if any(isinstance(q, CUT) for q in leaves(query)):
            df, stats, known = self._measured(query)
            return df.select(self.key, over_rows(query, df, {}, stats, self.modes, known)[1].cast("double").alias("score"))
        df, _ = self._prepared(set(), query)
        matches, score = over_rows(query, df, {}, Stats(0), self.modes)
        return df.where(matches).select(self.key, score.cast("double").alias("score"))

    def search(self, query: Query, k: int, start: int = 0, after: After | None = None, after_mode: str = "keyset") -> DataFrame:
        return ranked(self.hits(query), k, start, after, after_mode, self.key)

    def count(self, query: Query) -> DataFrame:
        return self.match(query).agg(F.count("*").alias("hits"))

    def max_score(self, query: Query, k: int) -> DataFrame:
        """The best score of the first k hits; NaN without hits."""
        return self.search(query, k).agg(F.coalesce(F.max("score"), F.lit(float("nan"))).alias("max_score"))


class FilterCache:
    """Extension: the keys that match a filter, stored when it is first asked for; the ``most`` last used ones are kept."""

    def __init__(self, corpus: Corpus, most: int = 32):
        self.corpus, self.most, self.kept, self.hits, self.misses = corpus, most, {}, 0, 0

    def keys(self, query: Query) -> DataFrame:
        query = query.normalise()
        self.hits, self.misses = self.hits + (query in self.kept), self.misses + (query not in self.kept)
        own = self.kept.pop(query, None)
        self.kept[query] = stored(self.corpus.match(query).select(self.corpus.key), "filter") if own is None else own
        while len(self.kept) > self.most:
            del self.kept[next(iter(self.kept))]
        return self.kept[query]

    def match(self, query: Query) -> DataFrame:
        return self.corpus.docs.join(self.keys(query), self.corpus.key, "left_semi")

    def clear(self) -> None:
        self.kept.clear()


def finite(hits: DataFrame) -> DataFrame:
    return hits.where(~F.isnan("score") & (F.abs("score") < float("inf")))


def ranked(hits: DataFrame, k: int, start: int = 0, after: After | None = None, after_mode: str = "keyset", key: str = "doc_id", places: int = 6) -> DataFrame:
    """k hits by score, then key, from ``start`` on. after_mode 'reference' goes by the key alone.

    Scores are compared at ``places`` decimals, so that equal scores tie on every engine.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    order = F.round("score", places)
    if after is not None:
        past = F.col(key) > after.doc_id
        hits = hits.where(past if after_mode == "reference" else (order < round(after.score, places)) | ((order == round(after.score, places)) & past))
    page = hits.orderBy(order.desc(), F.col(key).asc())
    return page.offset(start).limit(k) if start else page.limit(k)


def total(hits: DataFrame) -> DataFrame:
    """The exact number of hits, and how it relates to the true one."""
    return hits.agg(F.count("*").alias("total"), F.lit("EQUAL_TO").alias("relation"))


# --- aggregations ----------------------------------------------------------------------------------------------------


def histogram(df: DataFrame, column: str, lower: float, interval: float, buckets: int) -> DataFrame:
    """Counts of [lower, lower + interval * buckets) in equal buckets, empty ones too."""
    if interval <= 0 or buckets <= 0:
        raise ValueError("interval and buckets must be above 0")
    v = F.col(column).cast("double")
    own = df.where(v.isNotNull() & ~F.isnan(v) & (v >= lower) & (v < lower + interval * buckets)).groupBy(F.floor((v - lower) / interval).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return every.join(F.broadcast(own), "bucket", "left").select("bucket", (F.lit(float(lower)) + F.col("bucket") * float(interval)).alias("lower"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def date_histogram(df: DataFrame, column: str, lower: float, upper: float, interval: float, most: int) -> DataFrame:
    """The first ``most`` non-empty buckets of [lower, upper): key and n. date_histogram_with_total also tells the rows."""
    if interval <= 0:
        raise ValueError("interval must be above 0")
    v = F.col(column).cast("double")
    inside = v.isNotNull() & ~F.isnan(v) & (v >= lower) & (v < upper)
    key = F.floor((v - lower) / interval) * interval + lower
    return df.where(inside).groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy("key").limit(most)


def date_histogram_with_total(df: DataFrame, column: str, lower: float, upper: float, interval: float, most: int) -> DataFrame:
    """date_histogram with the number of all rows beside each bucket, those without a value too; one row with a null key
    where no bucket has any. One pass: a row outside the buckets counts under no key."""
    if interval <= 0:
        raise ValueError("interval must be above 0")
    v = F.col(column).cast("double")
    key = F.when(v.isNotNull() & ~F.isnan(v) & (v >= lower) & (v < upper), F.floor((v - lower) / interval) * interval + lower)
    every = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))  # a row a bucket
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_hits"))
    shown = every.where("key is not null").orderBy("key").limit(most)
    return total.join(shown, F.lit(True), "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "total_hits")


def facets(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def observed(df: DataFrame, name: str, **measures: Column):
    """df and an Observation of measures that is filled as a side effect of the next action on df."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in measures.items()]), seen
