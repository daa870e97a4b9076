"""Queries to plans, two ways.

Over plain rows (``over_rows``) a query becomes two Columns, whether a row matches and its score, so a search is one
scan with a projection and a top-k, without a join or shuffle, however many clauses there are. Over the tables of an
index (``over_postings``) each leaf reads its own postings (partition and row-group pruning by term), clauses are
unioned, and one aggregation by document decides; MUST_NOT is an anti join.

Two switches (see README): must_should 'boost' (MUST decides, SHOULD adds) or 'reference' (one of 1 + min_should among
the MUST part and the SHOULD clauses), and filter_scores (whether FILTER clauses add their score).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .query import Bool, Boost, Fuzzy, MatchAll, Phrase, Query, Range, Term, Wildcard


@dataclass(frozen=True)
class Modes:
    norms: str = "quantized"
    must_should: str = "boost"
    filter_scores: bool = False
    k1: float = scoring.K1
    b: float = scoring.B


@dataclass
class Stats:
    """Documents, tokens of each text field, and documents of each leaf's terms."""

    n: int
    tokens: dict[str, int] = field(default_factory=dict)
    df: dict[tuple[str, str], int] = field(default_factory=dict)

    def average(self, name: str) -> float:
        return self.tokens.get(name, 0) / self.n if self.n and self.tokens.get(name, 0) else 50.0


def range_matches(c: Column, q: Range, fractional: bool) -> Column:
    ok = c.isNotNull()
    if fractional:
        ok = ok & ~F.isnan(c)
    if q.lower is not None:
        ok = ok & ((c >= F.lit(q.lower)) if q.include_lower else (c > F.lit(q.lower)))
    if q.upper is not None:
        ok = ok & ((c <= F.lit(q.upper)) if q.include_upper else (c < F.lit(q.upper)))
    return ok


def _bool(q: Bool, must, should, must_not, filters, modes: Modes) -> tuple[Column, Column]:
    """The rule of boolean queries, from (matches, score) Columns of its clauses."""
    no, zero = F.lit(False), F.lit(0.0)
    each = lambda xs: reduce(lambda a, b: a & b, [m for m, _ in xs])
    total = lambda xs: reduce(lambda a, b: a + b, [F.when(m, s).otherwise(0.0) for m, s in xs], zero)
    hits = reduce(lambda a, b: a + b, [m.cast("int") for m, _ in should], F.lit(0))
    if not (must or should or filters):
        return no, zero
    scored = list(must) + (list(filters) if modes.filter_scores else [])
    if must and should and modes.must_should == "reference":
        part = each(must) & (each(filters) if filters else F.lit(True))
        ok, score = (part.cast("int") + hits) >= 1 + q.min_should, F.when(part, total(scored)).otherwise(0.0) + total(should)
    else:
        least = q.min_should if must or filters else max(1, q.min_should)
        ok = hits >= least if should or q.min_should else F.lit(True)
        for side in (must, filters):
            ok = ok & each(side) if side else ok
        score = total(scored) + total(should)
    for m, _ in must_not:
        ok = ok & ~m
    return ok, score


def term_matches(q: Wildcard | Fuzzy, term: Column) -> Column:
    return F.regexp_like(term, F.lit(q.regex())) if isinstance(q, Wildcard) else F.levenshtein(term, F.lit(q.text)) <= q.edits


def frequency(q: Term | Phrase, df: DataFrame, tokens: dict[str, Column]) -> tuple[Column, Column]:
    """How often a leaf stands in each row's field, and the field's length."""
    if isinstance(q, Phrase):
        if q.field not in tokens:
            raise TypeError(f"no text field: {q.field!r}")
        spots = [positions(tokens[q.field], t, p) for t, p in zip(q.terms, q.positions, strict=True)]
        return F.coalesce(F.size(reduce(F.array_intersect, spots)), F.lit(0)) if spots else F.lit(0), F.size(tokens[q.field])
    if q.field in tokens:
        # Built-in array functions stay in generated code, unlike a lambda a token.
        return F.size(tokens[q.field]) - F.size(F.array_remove(tokens[q.field], q.text)), F.size(tokens[q.field])
    c = F.col(q.field)
    many = dict(df.dtypes)[q.field].startswith("array")
    freq = F.size(F.filter(c, lambda t: t.cast("string") == q.text)) if many else (c.cast("string") == q.text).cast("int")
    return F.coalesce(freq, F.lit(0)), F.lit(1)


def over_rows(q: Query, df: DataFrame, tokens: dict[str, Column], stats: Stats | None, modes: Modes, known: dict[Query, tuple[Column, Column]] | None = None) -> tuple[Column, Column]:
    """(matches, score) of a query for each row. tokens: the terms of each text field; stats: None if scores do not matter;
    known: leaves whose frequency and length df has as columns already."""
    known = known or {}
    if isinstance(q, Boost):
        m, s = over_rows(q.query, df, tokens, stats, modes, known)
        return m, s * F.lit(float(q.factor))
    if isinstance(q, MatchAll):
        return F.lit(True), F.lit(1.0)
    if isinstance(q, (Range, Wildcard, Fuzzy)) and q in known:
        return known[q][0] > 0, F.lit(1.0)
    if isinstance(q, (Wildcard, Fuzzy)):
        one = F.coalesce(term_matches(q, F.col(q.field).cast("string")), F.lit(False)) if q.field not in tokens else F.exists(tokens[q.field], lambda t: term_matches(q, t))
        return one, F.lit(1.0)
    if isinstance(q, Range):
        kind = dict(df.dtypes)[q.field]
        c = F.col(q.field)
        if kind.startswith("array"):
            return F.coalesce(F.exists(c, lambda x: range_matches(x, q, "double" in kind or "float" in kind)), F.lit(False)), F.lit(1.0)
        return F.coalesce(range_matches(c, q, kind in ("double", "float")), F.lit(False)), F.lit(1.0)
    if isinstance(q, Bool):
        sides = [[over_rows(x, df, tokens, stats, modes, known) for x in side] for side in (q.must, q.should, q.must_not, q.filter)]
        return _bool(q, *sides, modes)
    if not isinstance(q, (Term, Phrase)):
        raise TypeError(f"cannot compile {q!r}")
    if stats is None and isinstance(q, Term) and q not in known:  # a search ends at the first match
        if q.field in tokens:
            return F.coalesce(F.array_contains(tokens[q.field], F.lit(q.text)), F.lit(False)), F.lit(0.0)
        if not dict(df.dtypes)[q.field].startswith("array"):
            return F.coalesce(F.col(q.field).cast("string") == q.text, F.lit(False)), F.lit(0.0)
    freq, length = known[q] if q in known else frequency(q, df, tokens)
    if stats is None:
        return freq > 0, F.lit(0.0)
    df_ = min((stats.df.get((q.field, t), 0) for t in ([q.text] if isinstance(q, Term) else q.terms)), default=0)
    average = stats.average(q.field) if q.field in stats.tokens else 1.0
    return freq > 0, scoring.bm25(freq, length, F.lit(df_), F.lit(stats.n), F.lit(average), modes.k1, modes.b, modes.norms)


def positions(tokens: Column, term: str, offset: int) -> Column:
    """Where a phrase would start if this term stood at its place in it."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == term, i - offset)), lambda i: i.isNotNull())


def _moved(places: Column, offset: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(offset))


def over_postings(q: Query, index, stats: Stats | None, modes: Modes) -> DataFrame:
    """(doc_id, score) of the documents that match. index has docs and postings(field, terms), which bring their field's length."""
    if isinstance(q, Boost):
        return over_postings(q.query, index, stats, modes).withColumn("score", F.col("score") * float(q.factor))
    if isinstance(q, MatchAll):
        return index.docs.select("doc_id", F.lit(1.0).alias("score"))
    if isinstance(q, (Wildcard, Fuzzy)) and q.field in index.text:
        # The few terms that match are found among the statistics, then their postings are read.
        terms = index.terms(q.field).where(term_matches(q, F.col("term"))).select("term")
        return index.postings(q.field).join(terms, "term", "left_semi").select("doc_id", F.lit(1.0).alias("score")).distinct()
    if isinstance(q, (Range, Wildcard, Fuzzy)) or isinstance(q, Term) and q.field not in index.text:
        m, s = over_rows(q, index.docs, {}, stats, modes)
        return index.docs.where(m).select("doc_id", s.alias("score"))
    if isinstance(q, (Term, Phrase)):
        terms = [q.text] if isinstance(q, Term) else list(dict.fromkeys(q.terms))
        rows = index.postings(q.field, terms)
        if isinstance(q, Term):
            hits = rows.select("doc_id", "freq", "len")
        else:  # one group a document, of at most one row a term
            at = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.max("len").alias("len")).where(F.size("at") == len(terms))
            spots = [_moved(F.element_at("at", F.lit(t)), o) for t, o in zip(q.terms, q.positions, strict=True)]
            hits = at.select("doc_id", F.size(reduce(F.array_intersect, spots)).alias("freq"), "len").where("freq > 0")
        if stats is None:
            return hits.select("doc_id", F.lit(0.0).alias("score"))
        df_ = min((stats.df.get((q.field, t), 0) for t in terms), default=0)
        return hits.select("doc_id", scoring.bm25(F.col("freq"), F.col("len"), F.lit(df_), F.lit(stats.n), F.lit(stats.average(q.field)), modes.k1, modes.b, modes.norms).alias("score"))
    if not isinstance(q, Bool):
        raise TypeError(f"cannot compile {q!r}")
    clauses, found = [], []
    for side, queries in (("must", q.must), ("should", q.should), ("filter", q.filter)):
        for x in queries:
            clauses.append(side)
            found.append(over_postings(x, index, stats, modes).select("doc_id", F.lit(len(clauses) - 1).alias("clause"), "score"))
    if not found:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    every = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(*[F.max(F.when(F.col("clause") == i, F.col("score"))).alias(f"s{i}") for i in range(len(clauses))])
    got = {side: [(F.col(f"s{i}").isNotNull(), F.coalesce(F.col(f"s{i}"), F.lit(0.0))) for i, c in enumerate(clauses) if c == side] for side in ("must", "should", "filter")}
    ok, score = _bool(q, got["must"], got["should"], [], got["filter"], modes)
    out = every.where(ok).select("doc_id", score.alias("score"))
    for x in q.must_not:
        out = out.join(over_postings(x, index, None, modes).select("doc_id"), "doc_id", "left_anti")
    return out
