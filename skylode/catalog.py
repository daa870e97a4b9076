"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis, bits, scoring
from .functions import vectors as sv
from .operators import columns, index, lifecycle, search, sparse
from .plans.compile import Modes
from .plans.query import Bool, Boost, Fuzzy, MatchAll, Phrase, Range, Term, Wildcard
from .scratch import shared_folder
from .sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, **modes) -> search.Corpus:
    return search.Corpus(table(spark, sf_dir, "documents"), modes=Modes(**modes))


def shown(page: DataFrame) -> DataFrame:
    return page.select("doc_id", F.round("score", 4).alias("score"))


# --- SQL that several oracles share ------------------------------------------------------------------------------------

TOK = r"tok AS (SELECT *, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}'']*'), []::VARCHAR[]) AS t FROM documents)"
LEN = "CASE WHEN nb IN (0, 127) THEN 1.0::DOUBLE ELSE pow(127.0::DOUBLE / nb, 2) END"


def bm25_sql(words: list[str], body: str, extra: str = "", norms: str = "quantized", phrases: dict[str, tuple[list[str], list[int]]] | None = None) -> str:
    """CTEs up to s, with columns f_WORD and s_WORD (score, 0 without a match) for words and phrases, then body."""
    phrases = phrases or {}
    every = list(dict.fromkeys([*words, *[w for ws, _ in phrases.values() for w in ws]]))
    freq = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f_{w}" for w in every)
    for name, (ws, offs) in phrases.items():
        cond = " AND ".join(f"t[i + {o}] = '{w}'" for w, o in zip(ws, offs, strict=True))
        freq += f", len(list_filter(range(1, len(t) + 1), lambda i: {cond})) AS f_{name}"
    dfs = ", ".join(f"count(*) FILTER (f_{w} > 0) AS df_{w}" for w in every)
    length = LEN if norms == "quantized" else "n_t::DOUBLE"
    k = f"(1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ({length}) / (ttf::DOUBLE / n)))"
    score = [f"CASE WHEN f_{w} > 0 THEN ln(1 + (n - df_{w} + 0.5::DOUBLE) / (df_{w} + 0.5::DOUBLE)) * f_{w} / (f_{w} + {k}) ELSE 0.0::DOUBLE END AS s_{w}" for w in every]
    for name, (ws, _) in phrases.items():
        df = f"least({', '.join(f'df_{w}' for w in ws)})"
        score.append(f"CASE WHEN f_{name} > 0 THEN ln(1 + (n - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)) * f_{name} / (f_{name} + {k}) ELSE 0.0::DOUBLE END AS s_{name}")
    return f"""WITH {TOK},
d AS (SELECT * EXCLUDE (t), len(t) AS n_t, CASE WHEN len(t) = 0 THEN 127 ELSE least(127, floor(127 / sqrt(len(t)::DOUBLE)))::INTEGER END AS nb, {freq} FROM tok),
st AS (SELECT count(*) AS n, sum(n_t) AS ttf, {dfs} FROM d),
s AS (SELECT d.*, {', '.join(score)} FROM d, st){extra}
{body}"""


def page_sql(where: str, score: str, k: int = 10, offset: int = 0) -> str:
    return f"SELECT doc_id, round({score}, 4) AS score FROM s WHERE {where} ORDER BY round({score}, 6) DESC, doc_id LIMIT {k}" + (f" OFFSET {offset}" if offset else "")


THE, OF, AND, WITH, THIS = (Term("text", w) for w in ("the", "of", "and", "with", "this"))

# --- terms, booleans, ranges -------------------------------------------------------------------------------------------


@query(bm25_sql(["the"], page_sql("f_the > 0", "s_the")))
def term_bm25_topk(spark, d):
    return shown(corpus(spark, d).search(THE, 10))


@query(bm25_sql(["with"], page_sql("f_with > 0", "s_with", 20), norms="exact"))
def term_bm25_exact_norms(spark, d):
    return shown(corpus(spark, d, norms="exact").search(WITH, 20))


@query(f"WITH {TOK} SELECT count(*) AS hits FROM tok WHERE list_contains(t, 'the')")
def term_count(spark, d):
    return corpus(spark, d).count(THE)


@query("SELECT count(*) AS hits FROM documents")
def match_all_count(spark, d):
    return corpus(spark, d).count(MatchAll())


@query(bm25_sql(["the", "with"], page_sql("f_the > 0 AND f_with > 0", "s_the + s_with")))
def bool_and(spark, d):
    return shown(corpus(spark, d).search(Bool(must=(THE, WITH)), 10))


@query(bm25_sql(["the", "of", "this"], page_sql("f_the + f_of + f_this > 0", "s_the + s_of + s_this")))
def bool_or(spark, d):
    return shown(corpus(spark, d).search(Bool(should=(THE, OF, THIS)), 10))


@query(bm25_sql(["the", "this"], page_sql("f_the > 0 AND f_this = 0", "s_the")))
def bool_not(spark, d):
    return shown(corpus(spark, d).search(Bool(must=(THE,), must_not=(THIS,)), 10))


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(t, 'the') AND NOT list_contains(t, 'this')")
def bool_not_match(spark, d):
    return corpus(spark, d).match(Bool(must=(THE,), must_not=(THIS,))).select("doc_id")


@query(f"WITH {TOK} SELECT 'only must_not' AS query, 0::BIGINT AS hits UNION ALL SELECT 'with match all', count(*) FROM tok WHERE NOT list_contains(t, 'this')")
def bool_only_must_not(spark, d):
    """Without a positive clause nothing matches."""
    docs, none = corpus(spark, d), Bool(must_not=(THIS,))
    counts = [docs.count(q).select(F.lit(name).alias("query"), "hits") for name, q in (("only must_not", none), ("with match all", Bool(must=(MatchAll(),), must_not=(THIS,))))]
    return counts[0].union(counts[1])


@query(bm25_sql(["the"], page_sql("f_the > 0 AND n_chars BETWEEN 500 AND 3000", "s_the")))
def bool_filter(spark, d):
    return shown(corpus(spark, d).search(Bool(must=(THE,), filter=(Range("n_chars", 500, 3000),)), 10))


@query(bm25_sql(["the"], page_sql("f_the > 0 AND n_chars BETWEEN 500 AND 3000", "s_the + 1.0")))
def bool_filter_scored(spark, d):
    return shown(corpus(spark, d, filter_scores=True).search(Bool(must=(THE,), filter=(Range("n_chars", 500, 3000),)), 10))


@query(bm25_sql(["the", "of", "with", "this"], page_sql("(f_the > 0)::INT + (f_of > 0)::INT + (f_with > 0)::INT + (f_this > 0)::INT >= 3", "s_the + s_of + s_with + s_this")))
def bool_min_should(spark, d):
    return shown(corpus(spark, d).search(Bool(should=(THE, OF, WITH, THIS), min_should=3), 10))


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'of')")
def bool_min_should_all(spark, d):
    return corpus(spark, d).match(Bool(should=(THE, OF), min_should=2)).select("doc_id")


@query(f"WITH {TOK} SELECT 3 AS least, 0::BIGINT AS hits UNION ALL SELECT 2, count(*) FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'of')")
def bool_min_should_above(spark, d):
    """More clauses asked for than there are: nothing matches."""
    docs = corpus(spark, d)
    counts = [docs.count(Bool(should=(THE, OF), min_should=n)).select(F.lit(n).alias("least"), "hits") for n in (3, 2)]
    return counts[0].union(counts[1])


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'licen.e.*'))) > 0")
def wildcard(spark, d):
    return corpus(spark, d).match(Wildcard("text", "licen?e*")).select("doc_id")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: levenshtein(x, 'public') <= 1)) > 0")
def fuzzy(spark, d):
    return corpus(spark, d).match(Fuzzy("text", "public", 1)).select("doc_id")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(t, 'the') AND n_chars BETWEEN 200 AND 900")
def cached_filter(spark, d):
    cache = search.FilterCache(corpus(spark, d))
    cache.keys(Bool(must=(THE, Range("n_chars", 200, 900))))
    return cache.match(Bool(must=(THE, Range("n_chars", 200, 900)))).select("doc_id")


@query("SELECT c_custkey, round(2.0 * greatest(c_acctbal, 0)::DOUBLE / (greatest(c_acctbal, 0)::DOUBLE + 1000.0) + 0.5 * c_nationkey / (c_nationkey + 1000.0), 6) AS score FROM customer")
def rank_features(spark, d):
    score = scoring.rank_features({"balance": (F.col("c_acctbal"), 2.0), "nation": (F.col("c_nationkey"), 0.5)}, pivot=1000.0)
    return table(spark, d, "customer").select("c_custkey", F.round(score, 6).alias("score"))


@query(bm25_sql(["the", "of", "this"], page_sql("f_the > 0", "s_the + s_of + s_this")))
def bool_must_should(spark, d):
    return shown(corpus(spark, d).search(Bool(must=(THE,), should=(OF, THIS)), 10))


@query(bm25_sql(["the", "of", "this"], page_sql("f_the > 0 OR f_of > 0 OR f_this > 0", "s_the + s_of + s_this", 40)))
def bool_must_should_reference(spark, d):
    return shown(corpus(spark, d, must_should="reference").search(Bool(must=(THE,), should=(OF, THIS)), 40))


@query(bm25_sql(["the", "of", "with", "this"], page_sql("f_the > 0 AND (f_of > 0 OR f_with > 0) AND f_this = 0", "s_the + s_of + s_with")))
def bool_nested(spark, d):
    return shown(corpus(spark, d).search(Bool(must=(THE, Bool(should=(OF, WITH))), must_not=(THIS,)), 10))


_PAIR = {"of_the": (["of", "the"], [0, 1])}


@query(bm25_sql([], page_sql("f_of_the > 0", "s_of_the"), phrases=_PAIR))
def phrase_exact(spark, d):
    return shown(corpus(spark, d).search(Phrase("text", ("of", "the")), 10))


@query(bm25_sql([], page_sql("f_gap > 0", "s_gap"), phrases={"gap": (["the", "of"], [0, 2])}))
def phrase_gap(spark, d):
    return shown(corpus(spark, d).search(Phrase("text", ("the", "of"), (0, 2)), 10))


@query(bm25_sql([], page_sql("f_gpl > 0", "s_gpl"), phrases={"gpl": (["general", "public", "license"], [0, 1, 2])}))
def phrase_three(spark, d):
    return shown(corpus(spark, d).search(Phrase("text", ("general", "public", "license")), 10))


@query(bm25_sql(["mit"], page_sql("f_mit > 0", "s_mit")))
def phrase_single_term(spark, d):
    return shown(corpus(spark, d).search(Phrase("text", ("mit",)), 10))


def _orders(spark, d):
    return search.Corpus(table(spark, d, "orders"), key="o_orderkey", text=())


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def range_long_incl(spark, d):
    return _orders(spark, d).match(Range("o_custkey", 100, 200)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey > 100 AND o_custkey < 200")
def range_long_excl(spark, d):
    return _orders(spark, d).match(Range("o_custkey", 100, 200, False, False)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000.5 AND 20000.25")
def range_double(spark, d):
    return _orders(spark, d).match(Range("o_totalprice", 1000.5, 20000.25)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000.0")
def range_half_open(spark, d):
    return _orders(spark, d).match(Range.at_least("o_totalprice", 400000.0, include=False)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 77")
def range_exact(spark, d):
    return _orders(spark, d).match(Range.exact("o_custkey", 77)).select("o_orderkey")


@query("SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_custkey BETWEEN 10 AND 900 ORDER BY o_orderkey LIMIT 25")
def range_constant_score(spark, d):
    return _orders(spark, d).search(Range("o_custkey", 10, 900), 25).withColumnRenamed("o_orderkey", "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000")
def term_and_range(spark, d):
    return _orders(spark, d).match(Bool(must=(Term("o_orderstatus", "F"), Range("o_totalprice", 1000.0, 50000.0)))).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def in_list(spark, d):
    return search.Corpus(table(spark, d, "events"), key="event_id", text=()).match(Bool(should=(Term("event_type", "error"), Term("event_type", "purchase")))).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'view'")
def not_equal(spark, d):
    return search.Corpus(table(spark, d, "events"), key="event_id", text=()).match(Bool(must=(MatchAll(),), must_not=(Term("event_type", "view"),))).select("event_id")


@query(r"SELECT page_id FROM pages WHERE list_contains(regexp_extract_all(lower(html), '[\p{L}\p{N}][\p{L}\p{N}'']*'), 'div')")
def contains_word(spark, d):
    return search.Corpus(table(spark, d, "pages"), key="page_id", text=("html",)).match(Term("html", "div")).select("page_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3 AND c_acctbal >= 0")
def multi_filter(spark, d):
    q = Bool(must=(Term("c_mktsegment", "BUILDING"), Range.at_least("c_acctbal", 0.0)), must_not=(Term("c_nationkey", "3"),))
    return search.Corpus(table(spark, d, "customer"), key="c_custkey", text=()).match(q).select("c_custkey")


# --- pages, totals, aggregations ---------------------------------------------------------------------------------------


@query(bm25_sql(["the"], page_sql("f_the > 0", "s_the", 10, 10)))
def topk_page2(spark, d):
    return shown(corpus(spark, d).search(THE, 10, start=10))


@query(bm25_sql(["the"], "SELECT doc_id, round(s_the, 4) AS score FROM s WHERE f_the > 0 AND (round(s_the, 6) < 0.3 OR (round(s_the, 6) = 0.3 AND doc_id > 5)) ORDER BY round(s_the, 6) DESC, doc_id LIMIT 10"))
def search_after(spark, d):
    return shown(corpus(spark, d).search(THE, 10, after=search.After(0.3, 5)))


@query(bm25_sql(["the"], "SELECT doc_id, round(s_the, 4) AS score FROM s WHERE f_the > 0 AND doc_id > 200 ORDER BY round(s_the, 6) DESC, doc_id LIMIT 10"))
def search_after_reference(spark, d):
    return shown(corpus(spark, d).search(THE, 10, after=search.After(0.3, 200), after_mode="reference"))


@query(bm25_sql(["the", "of"], "SELECT count(*) AS total, 'EQUAL_TO' AS relation FROM s WHERE f_the + f_of > 0"))
def total_hits(spark, d):
    return search.total(corpus(spark, d).hits(Bool(should=(THE, OF))))


@query(bm25_sql(["the", "of"], "SELECT round(max(s_the + s_of), 4) AS max_score FROM s WHERE f_the + f_of > 0"))
def max_score(spark, d):
    return corpus(spark, d).max_score(Bool(should=(THE, OF)), 10).select(F.round("max_score", 4).alias("max_score"))


@query("SELECT b.i AS bucket, 1000.0::DOUBLE + b.i * 2500.0::DOUBLE AS lower, count(o_orderkey) AS n FROM range(40) b(i) LEFT JOIN orders ON floor((o_totalprice - 1000) / 2500) = b.i AND o_totalprice >= 1000 AND o_totalprice < 101000 GROUP BY b.i")
def histogram_fixed(spark, d):
    return search.histogram(table(spark, d, "orders"), "o_totalprice", 1000.0, 2500.0, 40)


@query("SELECT floor((epoch(ts)::DOUBLE - 1704067200) / 86400) * 86400 + 1704067200 AS key, count(*) AS n FROM events WHERE event_type = 'purchase' AND epoch(ts) >= 1704067200 AND epoch(ts) < 1705276800 GROUP BY 1 ORDER BY 1 LIMIT 10")
def date_histogram(spark, d):
    hits = search.Corpus(table(spark, d, "events"), key="event_id", text=()).match(Term("event_type", "purchase"))
    return search.date_histogram(hits.withColumn("at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6), "at", 1704067200.0, 1705276800.0, 86400.0, 10)


@query("SELECT floor((epoch(ts)::DOUBLE - 1704067200) / 86400) * 86400 + 1704067200 AS key, count(*) AS n, (SELECT count(*) FROM events WHERE event_type = 'error') AS total_hits FROM events WHERE event_type = 'error' AND epoch(ts) >= 1704067200 AND epoch(ts) < 1705276800 GROUP BY 1 ORDER BY 1 LIMIT 5")
def date_histogram_total(spark, d):
    hits = search.Corpus(table(spark, d, "events"), key="event_id", text=()).match(Term("event_type", "error"))
    return search.date_histogram_with_total(hits.withColumn("at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6), "at", 1704067200.0, 1705276800.0, 86400.0, 5)


@query(f"WITH {TOK} SELECT lang, count(*) AS n FROM tok WHERE list_contains(t, 'the') GROUP BY lang")
def facet_counts(spark, d):
    return search.facets(corpus(spark, d).match(THE), "lang")


@query(f"WITH {TOK} SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, min(n_chars) AS low, max(n_chars) AS high, avg(n_chars) AS mean FROM tok WHERE list_contains(t, 'of') GROUP BY source")
def search_then_aggregate(spark, d):
    return corpus(spark, d).match(OF).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.avg("n_chars").alias("mean"))


# --- index tables ------------------------------------------------------------------------------------------------------

_POST = f"WITH {TOK}, w AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM tok), po AS (SELECT doc_id, term, count(*) AS freq, list(p ORDER BY p) AS positions FROM w GROUP BY ALL)"


def _documents(spark, d):
    return table(spark, d, "documents")


@query(_POST + " SELECT doc_id, term, freq::INTEGER AS freq, array_to_string(positions, ' ') AS positions FROM po")
def postings(spark, d):
    return index.postings_of(_documents(spark, d), "doc_id", "text").select("doc_id", "term", "freq", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(_POST + " SELECT term, count(*) AS df, sum(freq)::BIGINT AS ttf FROM po GROUP BY term")
def term_stats(spark, d):
    return index.term_stats(index.postings_of(_documents(spark, d), "doc_id", "text")).drop("field")


@query(_POST + " SELECT 'text' AS field, (SELECT count(*) FROM documents) AS max_doc, (SELECT count(*) FROM tok WHERE len(t) > 0) AS doc_count, sum(freq)::BIGINT AS sum_ttf, count(*) AS sum_df, count(DISTINCT term) AS terms FROM po")
def collection_stats(spark, d):
    docs = _documents(spark, d)
    return index.field_stats(index.lengths_of(docs, "doc_id", "text"), index.postings_of(docs, "doc_id", "text"))


@query(f"WITH {TOK} SELECT doc_id, len(t)::INTEGER AS len, CASE WHEN len(t) = 0 THEN 127 ELSE least(127, floor(127 / sqrt(len(t)::DOUBLE)))::INTEGER END AS norm FROM tok")
def doc_norms(spark, d):
    return index.lengths_of(_documents(spark, d), "doc_id", "text").drop("field")


@query(_POST + " SELECT term, count(*) AS df, sum(freq)::BIGINT AS ttf FROM po WHERE term >= 'thesis' GROUP BY term ORDER BY term LIMIT 1")
def terms_seek_ceil(spark, d):
    return index.seek_ceil(index.term_stats(index.postings_of(_documents(spark, d), "doc_id", "text")), "text", "thesis").drop("field")


@query(f"WITH {TOK}, d AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'license')) AS f FROM tok) SELECT doc_id, round(f * ln(1 + ((SELECT count(*) FROM d) - (SELECT count(*) FROM d WHERE f > 0) + 0.5::DOUBLE) / ((SELECT count(*) FROM d WHERE f > 0) + 0.5::DOUBLE)), 4) AS score FROM d WHERE f > 0")
def tf_idf(spark, d):
    docs = _documents(spark, d).select("doc_id", F.size(F.filter(analysis.index_terms(F.col("text")), lambda t: t == "license")).alias("f"))
    n = docs.agg(F.count("*").alias("n"), F.count_if(F.col("f") > 0).alias("df")).first()
    return docs.where("f > 0").select("doc_id", F.round(scoring.tf_idf(F.col("f"), F.lit(n["df"]), F.lit(n["n"])), 4).alias("score"))


# --- analysis ----------------------------------------------------------------------------------------------------------


def _said(spark, d):
    return table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item_id"), "text")


def _analyzed(spark, d, name):
    tokens = _said(spark, d).select("item_id", F.posexplode(analysis.ANALYZERS[name](F.col("text"))).alias("n", "t"))
    return tokens.select("item_id", "t.position", F.col("t.text").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))


def _tokens_sql(pattern: str, word: str = "") -> str:
    """CTE u: every match of pattern with its byte offsets, and its position among those that hold ``word``."""
    held = f"WHERE regexp_matches(raw, '{word}')" if word else ""
    return f"""WITH b AS (SELECT conv_id || '-' || turn AS item_id, regexp_extract_all(text, '{pattern}') AS t, list_transform(string_split_regex(text, '{pattern}'), lambda x: strlen(x)) AS g FROM conversations WHERE text <> ''),
n AS (SELECT item_id, unnest(t) AS raw, generate_subscripts(t, 1) AS i, g, list_transform(t, lambda x: strlen(x)) AS s FROM b),
o AS (SELECT item_id, raw, i, (list_sum(g[1:i]) + coalesce(list_sum(s[1:i - 1]), 0))::INTEGER AS start FROM n),
u AS (SELECT item_id, raw, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INTEGER AS position, start, (start + strlen(raw))::INTEGER AS "end" FROM o {held})"""


_SPACED = _tokens_sql(r"[^ \t\n\x0B\f\r]+")
# Words: ' . : join letters, ' . , ; join digits.
_WORDS = _tokens_sql(r"(?:[\p{L}\p{M}](?:[''’.:·]\p{L})+|\p{N}(?:[''’.,;]\p{N})+|[\p{L}\p{N}\p{M}_])+", r"[\p{L}\p{N}]")
_FOLDED = "replace(strip_accents(lower(raw)), 'ß', 'ss')"
_STOP = ", ".join(f"'{w}'" for w in analysis.ENGLISH_STOP_WORDS)


@query(_SPACED + ' SELECT item_id, position, raw AS term, start, "end" FROM u')
def analyze_whitespace(spark, d):
    return _analyzed(spark, d, "whitespace")


@query("SELECT conv_id || '-' || turn AS item_id, 0 AS position, text AS term, 0 AS start, strlen(text)::INTEGER AS \"end\" FROM conversations WHERE text <> ''")
def analyze_keyword(spark, d):
    return _analyzed(spark, d, "keyword")


@query(_SPACED + ' SELECT item_id, position, lower(raw) AS term, start, "end" FROM u')
def analyze_simple(spark, d):
    return _analyzed(spark, d, "simple")


@query(_WORDS + f' SELECT item_id, position, lower(raw) AS term, start, "end" FROM u WHERE lower(raw) NOT IN ({_STOP})')
def analyze_standard(spark, d):
    return _analyzed(spark, d, "standard")


@query(_WORDS + f' SELECT item_id, position, {_FOLDED} AS term, start, "end" FROM u WHERE {_FOLDED} NOT IN ({_STOP})')
def analyze_english(spark, d):
    return _analyzed(spark, d, "english")


@query(_WORDS + f' SELECT item_id, position, {_FOLDED} AS term, start, "end" FROM u')
def analyze_multilingual(spark, d):
    return _analyzed(spark, d, "multilingual")


@query(_WORDS + f' SELECT item_id, position, {_FOLDED} AS term, start, "end" FROM u WHERE {_FOLDED} NOT IN ({_STOP})')
def analyze_search(spark, d):
    return _analyzed(spark, d, "search")


@query(r"SELECT conv_id || '-' || turn AS item_id, array_to_string(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), '|') AS words FROM conversations")
def analyze_fast(spark, d):
    return _said(spark, d).select("item_id", F.array_join(analysis.fast(F.col("text")), "|").alias("words"))


@query("SELECT doc_id, replace(strip_accents(text), 'ß', 'ss') AS folded FROM documents")
def ascii_fold(spark, d):
    return _documents(spark, d).select("doc_id", analysis.fold(F.col("text")).alias("folded"))


@query(_SPACED + """, s(w, term, i) AS (VALUES ('the', 'the', 0), ('the', 'that', 0), ('of', 'out', 0), ('of', 'of', 1))
SELECT item_id, position + coalesce(s.i, 0) AS position, coalesce(term, lower(raw)) AS term, start FROM u LEFT JOIN s ON lower(raw) = s.w""")
def synonyms(spark, d):
    names = analysis.read_synonyms(["# words", "the => the, that", "of, out of"])
    tokens = analysis.synonyms(analysis.ANALYZERS["simple"](F.col("text")), names)
    return _said(spark, d).select("item_id", F.explode(tokens).alias("t")).select("item_id", "t.position", F.col("t.text").alias("term"), F.col("t.start").alias("start"))


# --- JSON and column values --------------------------------------------------------------------------------------------


@query("SELECT event_id, 'k' AS field, 'long' AS role, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(spark, d):
    return readers.flatten_fields(table(spark, d, "events"), "props", keep=("event_id",))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_id::VARCHAR AS _id FROM events")
def json_columns(spark, d):
    return readers.parse_json(table(spark, d, "events").select("event_id", "props"), "props", "k long", id_column="event_id")


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS ord FROM (SELECT DISTINCT p_brand FROM part)")
def sorted_ordinals(spark, d):
    return columns.ordinals(table(spark, d, "part"), "p_brand")


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ' ') AS flags FROM lineitem GROUP BY l_orderkey")
def sorted_set(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("v"))
    return rows.select("l_orderkey", F.array_join(columns.sorted_set(F.col("v")), " ").alias("flags"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), ' ') AS parts, count(l_partkey)::INTEGER AS n FROM lineitem GROUP BY l_orderkey")
def sorted_numeric(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("v"))
    v = columns.sorted_numeric(F.col("v"))
    return rows.select("l_orderkey", F.array_join(v.cast("array<string>"), " ").alias("parts"), F.size(v).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, p_size::DOUBLE AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def bulk_get(spark, d):
    ids = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return columns.bulk_get(table(spark, d, "part"), "p_partkey", "p_size", ids).select("l_orderkey", "l_linenumber", "p_partkey", "value")


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 3 <> 0")
def mask_filter(spark, d):
    return columns.masked(table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") % 3).alias("mask")), "mask")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 40")
def column_cut(spark, d):
    return columns.cut(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 40, 25)


@query("SELECT l_orderkey, l_linenumber, sign(l_discount - l_tax)::INTEGER AS way FROM lineitem")
def column_compare(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", columns.compared(F.col("l_discount"), F.col("l_tax")).alias("way"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey BETWEEN 50 AND 400")
def range_count(spark, d):
    return columns.range_count(table(spark, d, "lineitem"), "l_partkey", 50, 400)


_GRAN = "WITH g AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1024 AS granule FROM orders)"


@query(_GRAN + " SELECT granule, min(o_custkey) AS low, max(o_custkey) AS high, count(*) AS rows FROM g GROUP BY granule")
def granule_minmax(spark, d):
    return columns.min_max(columns.with_granule(table(spark, d, "orders"), "o_orderkey", 1024), "o_custkey")


@query(_GRAN + ", m AS (SELECT granule, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS rows FROM g GROUP BY granule) SELECT granule, low, high, rows, (low >= 3000 AND high <= 9000) AS inside FROM m WHERE high >= 3000 AND low <= 9000")
def granule_prune(spark, d):
    return columns.may_hold(columns.min_max(columns.with_granule(table(spark, d, "orders"), "o_orderkey", 1024), "o_orderkey"), 3000, 9000)


@query("WITH u AS (SELECT p_partkey, coalesce(sum(strlen(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM part) SELECT (b // 4096)::BIGINT AS mark, min(p_partkey) AS first, count(*) AS rows FROM u GROUP BY 1")
def adaptive_marks(spark, d):
    return columns.adaptive_marks(table(spark, d, "part"), "p_partkey", F.octet_length("p_name"), 4096)


def _spots(value: str, n: int, hashes: int) -> str:
    return ", ".join(f"('0x' || substr(md5({value} || ':{i}'), 1, 8))::BIGINT % {n}" for i in range(hashes))


_BLOOM = f"""WITH bits AS (SELECT list_sort(list(DISTINCT b)) AS bits FROM (SELECT unnest([{_spots('p_brand', 256, 4)}]) AS b FROM part)),
probe AS (SELECT DISTINCT p_brand AS value, true AS there FROM part UNION ALL SELECT 'absent' || p_partkey, false FROM part)"""


@query(_BLOOM + f" SELECT there, count(*) AS n, count(*) FILTER (list_has_all(bits, [{_spots('value', 256, 4)}])) AS held FROM probe, bits GROUP BY there")
def bloom_members(spark, d):
    """All values that are there, and of others exactly those whose bits happen to be set."""
    part = table(spark, d, "part")
    probe = part.select(F.col("p_brand").alias("value"), F.lit(True).alias("there")).distinct().union(part.select(F.concat(F.lit("absent"), "p_partkey"), F.lit(False)))
    held = columns.bloom_may_hold(F.col("bits"), F.col("value"), 256, 4)
    return probe.crossJoin(F.broadcast(columns.bloom(part, "p_brand", 256, 4))).groupBy("there").agg(F.count("*").alias("n"), F.count_if(held).alias("held"))  # one row of bits


@query(f"""WITH one AS (SELECT DISTINCT unnest([{_spots('p_brand', 1024, 4)}]) AS b FROM part), other AS (SELECT DISTINCT unnest([{_spots('p_type', 1024, 4)}]) AS b FROM part)
SELECT (SELECT count(*) FROM (FROM one UNION FROM other))::INTEGER AS merged, round(pow((SELECT count(*) FROM one) / 1024.0::DOUBLE, 4), 9) AS false_positives""")
def bloom_merge(spark, d):
    part = table(spark, d, "part")
    a, b = (columns.bloom(part, c, 1024, 4).withColumnRenamed("bits", x) for c, x in (("p_brand", "a"), ("p_type", "b")))
    return a.crossJoin(b).select(F.size(columns.bloom_merge(F.col("a"), F.col("b"))).alias("merged"), F.round(columns.bloom_false_positives(F.col("a"), 1024, 4), 9).alias("false_positives"))  # one row each


@query(_GRAN.replace("1024", "256") + f""", k AS (SELECT granule, list(DISTINCT b) AS bits FROM (SELECT granule, unnest([{_spots('o_custkey', 4096, 4)}]) AS b FROM g) GROUP BY granule),
p AS (SELECT granule, list(DISTINCT b) AS bits FROM (SELECT granule, unnest([{_spots('o_orderpriority', 4096, 4)}]) AS b FROM g) GROUP BY granule)
SELECT granule FROM k JOIN p USING (granule) WHERE list_has_all(p.bits, [{_spots("'1-URGENT'", 4096, 4)}])
AND ({' OR '.join(f"list_has_all(k.bits, [{_spots(repr(str(v)), 4096, 4)}])" for v in (7, 77, 777, 100001))})""")
def granule_bloom(spark, d):
    """Granules in which o_custkey may be one of four and o_orderpriority may be one value."""
    g = columns.with_granule(table(spark, d, "orders"), "o_orderkey", 256)
    return columns.bloom_granules(g, {"o_custkey": [7, 77, 777, 100001], "o_orderpriority": ["1-URGENT"]}, 4096, 4)


@query(_GRAN.replace("1024", "256") + " SELECT granule FROM g GROUP BY granule HAVING count(DISTINCT o_custkey) > 225 OR bool_or(o_custkey IN (7, 77, 777))")
def granule_set(spark, d):
    """Granules by their distinct values; those with more than 225 are always read."""
    g = columns.with_granule(table(spark, d, "orders"), "o_orderkey", 256)
    return columns.set_granules(columns.set_index(g, "o_custkey", 225), [7, 77, 777])


_GRAMS = "WITH g AS (SELECT *, (row_number() OVER (ORDER BY p_partkey) - 1) // 16 AS granule FROM part), n AS (SELECT DISTINCT granule, unnest(list_transform(range(1, length(p_name) - 1), lambda i: p_name[i:i + 2])) AS gram FROM g)"


@query(_GRAMS + f", k AS (SELECT granule, list(DISTINCT b) AS bits FROM (SELECT granule, unnest([{_spots('gram', 512, 2)}]) AS b FROM n) GROUP BY granule) SELECT granule FROM k WHERE " + " AND ".join(f"list_has_all(bits, [{_spots(repr(x), 512, 2)}])" for x in ("t g", "ot ", " gi", "giz")))
def granule_ngram(spark, d):
    """Granules in which a name may hold a needle."""
    g = columns.with_granule(table(spark, d, "part"), "p_partkey", 16)
    return columns.ngram_granules(g, "p_name", "ot giz", 3, 512, 2)


@query("SELECT p_partkey, hex(encode(p_name)) AS value, strlen(p_name)::INTEGER AS bytes FROM part")
def binary_values(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("v"))
    return _written(spark, part, "zstd").select("p_partkey", F.hex("v").alias("value"), F.octet_length("v").alias("bytes"))


@query(_GRAN + """, m AS (SELECT granule AS mark, min(o_custkey) AS low, max(o_custkey) AS high, count(*) AS rows FROM g GROUP BY granule),
w AS (SELECT mark, mark - row_number() OVER (ORDER BY mark) AS i FROM m WHERE mark % 5 <> 2), r AS (SELECT min(mark) AS first, max(mark) + 1 AS "end" FROM w GROUP BY i)
SELECT first, "end", (SELECT count(*) FROM g WHERE granule >= first AND granule < "end") AS rows FROM r""")
def mark_ranges(spark, d):
    orders = table(spark, d, "orders")
    g = columns.with_granule(orders, "o_orderkey", 1024)
    ranges = columns.mark_ranges(columns.min_max(g, "o_custkey").where("granule % 5 <> 2").select(F.col("granule").alias("mark")))
    return ranges.select("first", "end", columns.rows_of_marks(F.col("first"), F.col("end"), F.lit(orders.count()), 1024).alias("rows"))


@query("WITH u AS (SELECT p_partkey, coalesce(sum(strlen(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) SELECT (b // 4096)::BIGINT AS mark, min(r)::BIGINT AS start, (max(r) + 1)::BIGINT AS \"end\" FROM u GROUP BY 1")
def adaptive_mark_rows(spark, d):
    return columns.mark_starts(columns.adaptive_marks(table(spark, d, "part"), "p_partkey", F.octet_length("p_name"), 4096)).select("mark", "start", "end")


@query("""WITH o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS ord FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem))
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT ord)), ' ') AS ords FROM lineitem JOIN o ON l_returnflag = v GROUP BY l_orderkey""")
def sorted_set_ordinals(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("v"))
    return columns.set_ordinals(rows, "l_orderkey", "v")[0].select("l_orderkey", F.array_join(F.col("ords").cast("array<string>"), " ").alias("ords"))


@query("""WITH s AS (SELECT p_brand, list(DISTINCT p_size ORDER BY p_size) AS a FROM part GROUP BY p_brand), o AS (SELECT list(DISTINCT p_size) AS b FROM part WHERE p_partkey % 10 = 0)
SELECT p_brand, len(a)::INTEGER AS own, len(list_distinct(a || b))::INTEGER AS "union", len(list_intersect(a, b))::INTEGER AS common, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INTEGER AS rest,
list_min(list_filter(a, lambda x: x >= 33))::BIGINT AS next, list_max(list_filter(a, lambda x: x <= 20))::BIGINT AS previous, NOT list_contains(a, 5) AS flipped FROM s, o""")
def bit_sets(spark, d):
    part = table(spark, d, "part")
    own = part.groupBy("p_brand").agg(bits.of(F.collect_set("p_size")).alias("a"))
    other = part.where("p_partkey % 10 = 0").agg(bits.of(F.collect_set("p_size")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return own.crossJoin(F.broadcast(other)).select(  # one row
        "p_brand", bits.cardinality(a).alias("own"), bits.cardinality(bits.union(a, b)).alias("union"), bits.cardinality(bits.intersection(a, b)).alias("common"), bits.cardinality(bits.difference(a, b)).alias("rest"),
        bits.next_set(a, F.lit(33)).alias("next"), bits.previous_set(a, F.lit(20)).alias("previous"), bits.get(bits.flip(a, F.lit(5)), F.lit(5)).alias("flipped"),
    )


@query("SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT (SELECT count(*) - 30 FROM part)) UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier WHERE s_suppkey <= (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 4)")
def column_changes(spark, d):
    """A column without its last 30 rows, then with 5 rows of another."""
    part, more = table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "supplier").select((F.lit(1000000) + F.col("s_suppkey")).alias("p_partkey"), F.col("s_name").alias("p_name"))
    return columns.insert_range(columns.pop_back(part, "p_partkey", 30), more, "p_partkey", 0, 5)


# --- sparse vectors ----------------------------------------------------------------------------------------------------

_QUERY = {0: 0.5, 3: 1.0, 7: 0.25, 11: 2.0, 20: 0.75}
_VALUES = ", ".join(f"({i}, {w}::DOUBLE)" for i, w in _QUERY.items())
_SPARSE = """WITH e AS (SELECT vec_id AS doc_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS i, unnest(embedding)::DOUBLE AS w FROM embeddings),
v AS (SELECT * FROM e WHERE w > 0.1)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), sv.from_dense(F.col("embedding"), 0.1).alias("v"))


@query(_SPARSE + f", q(i, x) AS (VALUES {_VALUES}), s AS (SELECT doc_id, sum(w * x) AS score FROM v JOIN q USING (i) GROUP BY doc_id) SELECT doc_id, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 15")
def sparse_dot_topk(spark, d):
    return shown(sparse.search(_vectors(spark, d), _QUERY, 15))


@query(_SPARSE + ", n AS (SELECT doc_id, sqrt(sum(w * w)) AS l2 FROM v GROUP BY doc_id), o AS (SELECT i, w FROM v WHERE doc_id = 0), d AS (SELECT v.doc_id, sum(v.w * o.w) AS dot FROM v JOIN o USING (i) GROUP BY v.doc_id) SELECT n.doc_id, round(coalesce(dot, 0) / (l2 * (SELECT l2 FROM n WHERE doc_id = 0)), 6) AS cosine FROM n LEFT JOIN d USING (doc_id)")
def sparse_cosine(spark, d):
    v = _vectors(spark, d).where(F.size("v") > 0)
    one = v.where("doc_id = 0").select(F.col("v").alias("o"))
    return v.crossJoin(F.broadcast(one)).select("doc_id", F.round(sv.cosine(F.col("v"), F.col("o")), 6).alias("cosine"))


@query(_SPARSE + " SELECT doc_id, round(sqrt(sum(w * w)), 6) AS l2, round(sum(abs(w)), 6) AS l1, round(sum(w), 6) AS total, count(*)::INTEGER AS entries FROM v GROUP BY doc_id")
def sparse_norms(spark, d):
    v = F.col("v")
    return _vectors(spark, d).where(F.size("v") > 0).select("doc_id", F.round(sv.norm(v), 6).alias("l2"), F.round(sv.l1(v), 6).alias("l1"), F.round(sv.total(v), 6).alias("total"), F.size(v).alias("entries"))


def _flat(df):
    return df.select("doc_id", F.explode("v").alias("e")).select("doc_id", "e.i", F.round("e.w", 6).alias("w"))


@query(_SPARSE + " SELECT doc_id, i, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(w) DESC, i) AS r FROM v) WHERE r <= 5")
def sparse_prune_topk(spark, d):
    return _flat(_vectors(spark, d).withColumn("v", sv.prune_top_k(F.col("v"), 5)))


@query(_SPARSE + ", c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY w DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER (PARTITION BY doc_id) AS every FROM v), t AS (SELECT doc_id, max(w) FILTER (upto >= 0.6 * every) AS least FROM c GROUP BY doc_id) SELECT doc_id, i, round(w, 6) AS w FROM v JOIN t USING (doc_id) WHERE w >= least")
def sparse_prune_mass(spark, d):
    return _flat(_vectors(spark, d).withColumn("v", sv.prune_mass(F.col("v"), 0.6)))


@query(_SPARSE + " SELECT doc_id, i, round(w, 6) AS w FROM v WHERE w >= 0.2")
def sparse_prune_threshold(spark, d):
    return _flat(_vectors(spark, d).withColumn("v", sv.prune_threshold(F.col("v"), F.lit(0.2))))


@query(_SPARSE + ", n AS (SELECT doc_id, sqrt(sum(w * w)) AS l2 FROM v GROUP BY doc_id) SELECT doc_id, i, round(w / l2, 6) AS w FROM v JOIN n USING (doc_id)")
def sparse_normalize(spark, d):
    return _flat(_vectors(spark, d).withColumn("v", sv.normalize(F.col("v"))))


_BINS = _SPARSE + f""", q(i, x) AS (VALUES {_VALUES}), n AS (SELECT count(*) AS every FROM v),
r AS (SELECT w, count(*) AS c, sum(count(*)) OVER (ORDER BY w) AS upto FROM v GROUP BY w),
b AS (SELECT w, c, least(floor((upto - 1) / greatest(every // 16, 1)), 15)::INTEGER AS bin FROM r, n),
bv AS (SELECT bin, sum(w * c) / sum(c) AS value FROM b GROUP BY bin),
own AS (SELECT doc_id, i, bin, value, value * x AS gain FROM v JOIN q USING (i) JOIN b USING (w) JOIN bv USING (bin)),
made AS (SELECT i, bin, any_value(gain) AS gain FROM own GROUP BY i, bin)"""


@query(_BINS + """, ch AS (SELECT *, coalesce(sum(gain) OVER (ORDER BY gain DESC, i, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(gain) OVER () AS every FROM made)
SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, sum(own.gain) AS score FROM own JOIN ch USING (i, bin) WHERE before < every * 0.3 GROUP BY doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 15""")
def sparse_quantized(spark, d):
    return shown(sparse.quantised(_vectors(spark, d), _QUERY, 15, n=16))


@query(_BINS + " SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, sum(own.gain) AS score FROM own JOIN (SELECT i, bin FROM made WHERE gain >= 0.5 * (SELECT max(gain) FROM made)) USING (i, bin) GROUP BY doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 15")
def sparse_quantized_ratio(spark, d):
    return shown(sparse.quantised(_vectors(spark, d), _QUERY, 15, n=16, mode="max_ratio", alpha=0.5))


@query(_BINS + " SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, sum(own.gain) AS score FROM own JOIN (SELECT i, bin FROM made ORDER BY gain DESC, i, bin LIMIT 12) USING (i, bin) GROUP BY doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 15")
def sparse_quantized_blocks(spark, d):
    return shown(sparse.quantised(_vectors(spark, d), _QUERY, 15, n=16, mode="top_k", blocks=12))


@query(_SPARSE + f""", q(i, x) AS (VALUES {_VALUES}), a AS (SELECT doc_id, sum(floor(least(greatest(w, 0), 3.0::DOUBLE) / 3.0::DOUBLE * 255) / 255 * 3.0::DOUBLE * x) AS rough, sum(w * x) AS score FROM v JOIN q USING (i) GROUP BY doc_id),
n AS (SELECT * FROM a WHERE rough > 0 ORDER BY round(rough, 6) DESC, doc_id LIMIT 50) SELECT doc_id, round(score, 4) AS score FROM n ORDER BY round(score, 6) DESC, doc_id LIMIT 10""")
def sparse_rerank(spark, d):
    return shown(sparse.reranked(_vectors(spark, d), _QUERY))


_MADE = "made AS (SELECT i, bin, any_value(value) AS value, floor(any_value(value) * any_value(x) * {scale})::BIGINT AS gain, any_value(value) * any_value(x) AS mass FROM own GROUP BY i, bin)"
_LEVELS = _SPARSE + f""", q(i, x) AS (VALUES {_VALUES}), o AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS r, count(*) OVER () AS every FROM v WHERE w > 0),
b AS (SELECT least(r // greatest(every // 16, 1), 15)::INTEGER AS bin, avg(w) AS value, max(w) AS high FROM o GROUP BY 1),
e2 AS (SELECT bin, value, coalesce(lag(high) OVER (ORDER BY bin), 0.0) AS lo, CASE WHEN lead(high) OVER (ORDER BY bin) IS NULL THEN high * 1.001 ELSE high END AS hi, max(high) OVER () AS largest FROM b),
lv AS (SELECT level, coalesce((SELECT min(bin) FROM e2 WHERE level / 255.0::DOUBLE * largest >= lo AND level / 255.0::DOUBLE * largest < hi), 0) AS bin FROM range(256) g(level)),
own AS (SELECT v.doc_id, v.i, lv.bin, b.value, q.x FROM v JOIN q USING (i) JOIN lv ON lv.level = floor(least(255.0, w / 3.0::DOUBLE * 255.0)) JOIN b ON b.bin = lv.bin WHERE w > 0),
{_MADE.format(scale='1000.0::DOUBLE')}, ch AS (SELECT *, coalesce(sum(mass) OVER (ORDER BY gain DESC, i, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(mass) OVER () AS every FROM made)"""


@query(_LEVELS + " SELECT doc_id, sum(gain)::BIGINT AS score FROM own JOIN ch USING (i, bin) WHERE before < every * 0.6 GROUP BY doc_id HAVING sum(gain) > 0 ORDER BY 2 DESC, 1 LIMIT 15")
def sparse_levels(spark, d):
    return sparse.quantised_levels(_vectors(spark, d), _QUERY, 15, n=16, alpha=0.6)


_HEAVY = {i: 40.0 * w for i, w in _QUERY.items()}


@query(_SPARSE + f""", q(i, x) AS (VALUES {', '.join(f"({i}, {w}::DOUBLE)" for i, w in _HEAVY.items())}),
own AS (SELECT doc_id, i, floor(least(greatest(w, 0), 3.0::DOUBLE) / 3.0::DOUBLE * 255)::INTEGER AS bin, floor(least(greatest(w, 0), 3.0::DOUBLE) / 3.0::DOUBLE * 255) / 255.0::DOUBLE * 3.0::DOUBLE AS value, x FROM v JOIN q USING (i)),
{_MADE.format(scale='1.0::DOUBLE')}, ch AS (SELECT *, coalesce(sum(gain) OVER (ORDER BY gain DESC, i, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(gain) OVER () AS every FROM made),
n AS (SELECT doc_id, sum(gain) AS rough FROM own JOIN ch USING (i, bin) WHERE before < every * 0.5 GROUP BY doc_id HAVING sum(gain) > 0 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT doc_id, round(sum(w * x), 4) AS score FROM n JOIN v USING (doc_id) JOIN q USING (i) GROUP BY doc_id HAVING sum(w * x) > 0 ORDER BY round(sum(w * x), 6) DESC, doc_id LIMIT 10""")
def sparse_block_max(spark, d):
    return shown(sparse.block_max(_vectors(spark, d), _HEAVY, 10, alpha=0.5))


# --- over an index: postings, versions, deletes -----------------------------------------------------------------------

_built: dict[tuple[str, str], index.Index] = {}


def _place(spark) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex[:8]}"


def _index(spark, d) -> index.Snapshot:
    """An index of documents in three segments, built once a session and input."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        docs, ix = _documents(spark, d), index.Index(spark, _place(spark))
        for i in range(3):
            ix.add(docs.where(F.pmod("doc_id", F.lit(3)) == i))
        ix.commit()
        _built[key] = ix
    return _built[key].open()


@query(bm25_sql(["license"], page_sql("f_license > 0", "s_license", 20)))
def index_term(spark, d):
    return shown(_index(spark, d).search(Term("text", "license"), 20))


@query(bm25_sql(["the", "license"], page_sql("f_the > 0 AND f_license > 0", "s_the + s_license")))
def index_and(spark, d):
    return shown(_index(spark, d).search(Bool(must=(THE, Term("text", "license"))), 10))


@query(bm25_sql(["the", "of", "this"], page_sql("f_the + f_of + f_this > 0", "s_the + s_of + s_this")))
def index_or(spark, d):
    return shown(_index(spark, d).search(Bool(should=(THE, OF, THIS)), 10))


@query(bm25_sql(["the", "license"], page_sql("f_the > 0 AND f_license = 0", "s_the")))
def index_not(spark, d):
    return shown(_index(spark, d).search(Bool(must=(THE,), must_not=(Term("text", "license"),)), 10))


@query(bm25_sql(["the"], page_sql("f_the > 0 AND n_chars BETWEEN 500 AND 3000", "s_the")))
def index_filter(spark, d):
    return shown(_index(spark, d).search(Bool(must=(THE,), filter=(Range("n_chars", 500, 3000),)), 10))


@query(bm25_sql(["the", "of", "with", "this"], page_sql("(f_the > 0)::INT + (f_of > 0)::INT + (f_with > 0)::INT + (f_this > 0)::INT >= 3", "s_the + s_of + s_with + s_this")))
def index_min_should(spark, d):
    return shown(_index(spark, d).search(Bool(should=(THE, OF, WITH, THIS), min_should=3), 10))


@query(bm25_sql([], page_sql("f_gpl > 0", "s_gpl"), phrases={"gpl": (["general", "public", "license"], [0, 1, 2])}))
def index_phrase(spark, d):
    return shown(_index(spark, d).search(Phrase("text", ("general", "public", "license")), 10))


@query(bm25_sql([], page_sql("f_gap > 0", "s_gap"), phrases={"gap": (["the", "of"], [0, 2])}))
def index_phrase_gap(spark, d):
    return shown(_index(spark, d).search(Phrase("text", ("the", "of"), (0, 2)), 10))


@query(bm25_sql(["the"], page_sql("f_the > 0", "s_the", 10, 10)))
def index_page2(spark, d):
    return shown(_index(spark, d).search(THE, 10, start=10))


@query(f"WITH {TOK} SELECT 'license' AS term, count(*) AS hits FROM tok WHERE list_contains(t, 'license')")
def index_count(spark, d):
    return spark.createDataFrame([("license", _index(spark, d).count(Term("text", "license")))], "term string, hits long")


@query(f"WITH {TOK} SELECT doc_id, lang, source, n_chars FROM tok WHERE list_contains(t, 'of') AND list_contains(t, 'license')")
def index_fetch(spark, d):
    seen = _index(spark, d)
    return seen.match(Bool(must=(OF, Term("text", "license")))).select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'licen.e.*'))) > 0 UNION SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: levenshtein(x, 'public') <= 1)) > 0")
def index_wildcard_fuzzy(spark, d):
    return _index(spark, d).match(Bool(should=(Wildcard("text", "licen?e*"), Fuzzy("text", "public", 1)))).select("doc_id")


@query(_POST + " SELECT term, count(*) AS df, sum(freq)::BIGINT AS ttf FROM po GROUP BY term")
def index_terms(spark, d):
    return _index(spark, d).terms("text").drop("field")


@query(_POST + " SELECT term, count(*) AS df, sum(freq)::BIGINT AS ttf FROM po WHERE term > 'theory' GROUP BY term ORDER BY term LIMIT 12")
def terms_next(spark, d):
    return index.terms_after(_index(spark, d).terms("text"), "text", "theory", 12).drop("field")


@query(_POST + " SELECT term, count(*) AS df, sum(freq)::BIGINT AS ttf FROM po WHERE term = 'license' GROUP BY term")
def terms_seek_exact(spark, d):
    return index.seek_exact(_index(spark, d).terms("text", ["license"]), "text", "license").drop("field")


def _without(name: str, word: str) -> str:
    return f"documents_{name} AS (SELECT * FROM documents WHERE NOT list_contains(coalesce(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}'']*'), []::VARCHAR[]), '{word}'))"


@query(bm25_sql(["the"], page_sql("f_the > 0", "s_the", 15)).replace(TOK, _without("left", "license") + ", " + TOK.replace("FROM documents", "FROM documents_left")))
def index_after_delete(spark, d):
    """Scores after a delete are those of the documents that are left."""
    ix = index.Index(spark, _place(spark))
    ix.add(_documents(spark, d)).commit()
    ix.delete(Term("text", "license")).commit()
    return shown(ix.open().search(THE, 15))


def _order_index(spark, d, parts: int = 3):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    ix = index.Index(spark, _place(spark), text=(), key="o_orderkey")
    for i in range(parts):
        ix.add(orders.where(F.pmod("o_orderkey", F.lit(parts)) == i))
    ix.commit()
    return ix


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def delete_by_term(spark, d):
    ix = _order_index(spark, d)
    ix.delete(Term("o_orderstatus", "P")).commit()
    return ix.open().docs.select(F.col("doc_id").alias("o_orderkey"), "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_by_term(spark, d):
    ix = _order_index(spark, d)
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), "o_totalprice")
    ix.update(Term("o_orderstatus", "P"), new).commit()
    return ix.open().docs.select(F.col("doc_id").alias("o_orderkey"), "o_orderstatus")


@query("""SELECT 'deleted' AS state, 3::BIGINT AS segments, count(*) AS max_doc, count(*) FILTER (o_orderstatus <> 'P') AS num_docs FROM orders
UNION ALL SELECT 'merged', 1, count(*), count(*) FROM orders WHERE o_orderstatus <> 'P'""")
def compact_stats(spark, d):
    ix = _order_index(spark, d)
    ix.delete(Term("o_orderstatus", "P")).commit()
    told = []
    for state in ("deleted", "merged"):
        seen = ix.open()
        told.append((state, len(seen.version.segments), seen.max_doc(), seen.num_docs()))
        ix.compact()
    return spark.createDataFrame(told, "state string, segments long, max_doc long, num_docs long")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def merge_to_two(spark, d):
    ix = _order_index(spark, d, 4)
    ix.delete(Term("o_orderstatus", "P")).commit()
    ix.compact(2)
    return ix.open().stored.select(F.col("doc_id").alias("o_orderkey"), "o_orderstatus")


# --- readers, writers and small values --------------------------------------------------------------------------------


def _written(spark, df, codec):
    path = f"{shared_folder(spark)}/codec-{uuid.uuid4().hex[:8]}"
    readers.write(df, path, codec)
    return spark.read.parquet(path)


@query("SELECT codec, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, (VALUES ('none'), ('lz4'), ('zstd'), ('snappy')) c(codec) GROUP BY codec")
def codec_round_trip(spark, d):
    """Columns written with each codec, by name or number, and read again."""
    orders = table(spark, d, "orders")
    every = [_written(spark, orders, code).select("*", F.lit(name).alias("codec")) for name, code in (("none", 0x02), ("lz4", 0x82), ("zstd", 0x90), ("snappy", "snappy"))]
    return reduce(DataFrame.union, every).groupBy("codec").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("SELECT event_id, user_id, event_type FROM events")
def log_round_trip(spark, d):
    """Tab-separated rows of 62 columns, three of them wanted."""
    events, path = table(spark, d, "events"), f"{shared_folder(spark)}/log-{uuid.uuid4().hex[:8]}"
    known = {3: "event_id", 17: "user_id", 60: "event_type"}
    events.select(F.concat_ws("\t", *[F.col(known[i]).cast("string") if i in known else F.lit("x") for i in range(62)])).write.text(path)
    return readers.read_log(spark, path, {"event_id": (3, "long"), "user_id": (17, "long"), "event_type": (60, "string")})


@query(r"SELECT item_id AS doc_id, 'item ' || item_id AS title, trim(text, ' ') AS body FROM benchmark")
def news_round_trip(spark, d):
    path = f"{shared_folder(spark)}/news-{uuid.uuid4().hex[:8]}"
    one = F.concat(F.lit('<REUTERS NEWID="'), F.col("item_id").cast("string"), F.lit('">\n<TITLE>item '), F.col("item_id").cast("string"), F.lit("</TITLE>\n<BODY>"), F.col("text"), F.lit("</BODY>\n</REUTERS>"))
    table(spark, d, "benchmark").select(one).repartition(3).write.text(path)
    return readers.read_news(spark, path)


@query("SELECT p_partkey, p_size, CAST(p_partkey % 2 = 0 AS VARCHAR) AS even, p_brand AS \"made.brand\" FROM part")
def json_array(spark, d):
    """Arrays of nested objects, one a brand, back to a row an object."""
    part = table(spark, d, "part")
    o = F.struct("p_partkey", "p_size", (F.col("p_partkey") % 2 == 0).alias("even"), F.struct(F.col("p_brand").alias("brand")).alias("made"))
    arrays = part.groupBy("p_brand").agg(F.to_json(F.collect_list(o)).alias("a"))
    return readers.parse_json_array(arrays, "a", "p_partkey: bigint, p_size: bigint, even: boolean, made: struct<brand: string>").withColumn("even", F.col("even").cast("string"))


@query("""SELECT p_partkey AS id, field, role, value FROM part, (VALUES ('size', 'long'), ('made.brand', 'text'), ('tags', 'text'), ('flag', 'keyword')) f(field, role),
LATERAL (SELECT unnest(CASE field WHEN 'size' THEN [p_size::VARCHAR] WHEN 'made.brand' THEN [p_brand] WHEN 'tags' THEN [p_type, p_name] ELSE [(p_size > 20)::VARCHAR] END) AS value)""")
def json_nested(spark, d):
    """Objects, arrays and booleans of JSON with unknown fields."""
    o = F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("made"), F.array("p_type", "p_name").alias("tags"), (F.col("p_size") > 20).alias("flag"))
    return readers.flatten_fields(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(o).alias("j")), "j", keep=("id",))


@query(bm25_sql(["license"], "SELECT doc_id, round(s_license, 4) AS score, lang, source FROM s WHERE f_license > 0 ORDER BY round(s_license, 6) DESC, doc_id LIMIT 20"))
def stored_fetch(spark, d):
    seen = _index(spark, d)
    return seen.fetch(seen.search(Term("text", "license"), 20)).select("doc_id", F.round("score", 4).alias("score"), "lang", "source")


@query(bm25_sql(["the", "of"], page_sql("f_the + f_of > 0", "3.0 * s_the + s_of", 15)))
def boosted(spark, d):
    return shown(corpus(spark, d).search(Bool(should=(Boost(THE, 3.0), OF)), 15))


@query(_SPARSE + " SELECT doc_id, round(coalesce(max(w) FILTER (i = 3), 0), 6) AS w3, count(*) FILTER (i = 7) > 0 AS has7 FROM v GROUP BY doc_id")
def sparse_get(spark, d):
    v = F.col("v")
    return _vectors(spark, d).where(F.size("v") > 0).select("doc_id", F.round(sv.get(v, F.lit(3)), 6).alias("w3"), sv.contains(v, F.lit(7)).alias("has7"))


@query(_SPARSE + " SELECT doc_id, i, round(w, 6) AS w FROM v WHERE doc_id = 5")
def sparse_forward(spark, d):
    return _flat(sparse.forward(_vectors(spark, d), 5))


@query("SELECT count(*) AS n, sum(o_totalprice) > 0 AS priced, max(o_custkey) AS high FROM orders")
def observed_metrics(spark, d):
    """Counters that are filled while something else runs."""
    df, seen = search.observed(table(spark, d, "orders"), f"orders-{uuid.uuid4().hex[:8]}", n=F.count(F.lit(1)), priced=F.sum("o_totalprice") > 0, high=F.max("o_custkey"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["priced"], seen.get["high"])], "n long, priced boolean, high long")


_STRICT = r"CASE WHEN strlen(text) = length(text) THEN regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}'']*') ELSE list_filter(regexp_extract_all(lower(text), '(?:[\p{L}\p{M}](?:[''’.:·]\p{L})+|\p{N}(?:[''’.,;]\p{N})+|[\p{L}\p{N}\p{M}_])+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) END"


@query(f"SELECT doc_id, array_to_string({_STRICT}, ' ') AS terms FROM documents WHERE text IS NOT NULL")
def strict_terms(spark, d):
    """Index terms with the word rules for texts that are not ASCII."""
    return _documents(spark, d).where("text is not null").select("doc_id", F.array_join(analysis.index_terms_strict(F.col("text")), " ").alias("terms"))


# --- lifecycle ---------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_orderkey AS segment, ['HOT', 'WARM', 'COLD', 'FROZEN'][o_custkey % 4 + 1] AS tier, (o_orderkey % 500) * 86400 AS age, (o_totalprice * 400000)::BIGINT AS bytes, o_custkey % 20 AS accesses FROM orders)
SELECT segment, tier, target FROM (SELECT *, CASE WHEN tier = 'HOT' AND (age >= 604800 OR bytes >= 53687091200) THEN 'WARM' WHEN tier = 'WARM' AND (age >= 2592000 OR accesses < 10) THEN 'COLD' WHEN tier = 'COLD' AND age >= 31536000 THEN 'FROZEN' END AS target FROM s) WHERE target IS NOT NULL""")
def tier_rules(spark, d):
    o = table(spark, d, "orders")
    tier = F.element_at(F.array(*map(F.lit, ("HOT", "WARM", "COLD", "FROZEN"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    s = o.select(F.col("o_orderkey").alias("segment"), tier.alias("tier"), ((F.col("o_orderkey") % 500) * 86400).alias("age"), F.round(F.col("o_totalprice") * 400000).cast("long").alias("bytes"), (F.col("o_custkey") % 20).alias("accesses"))
    return lifecycle.migrations(s).select("segment", "tier", "target")
